"""Attributes as known at event time: events and attribute changes in one order, last known values carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from okrug.session import HOT_SHARE, written

#: Length of a slice, and the parts of one that holds too many rows.
DAY_US, FINER = 86_400_000_000, 1024


def last_known(events: DataFrame, changes: DataFrame, keys: list[str], time: str, event_id: str, change_id: str, order: list[str], slice_us: int = DAY_US) -> DataFrame:
    """(event_id, change_id): for each event the last change of its keys that was available at its time.

    `time` BIGINT is the instant of an event, or that from which a change is known; a change at the very instant of an
    event is known to it. Of changes at one instant the greatest by `order`, then by `change_id`, stands. Events without a
    known change, and rows with a null key or time, give no row. Repeated events each give their row. Empty inputs give an
    empty result; other columns are ignored.

    Changes at one instant are reduced to one before the shuffle. Keys that hold one row in 1024 or more (at most 1024 keys,
    so the list can be broadcast) are cut into slices of `slice_us`, and slices that hold as many rows into FINER parts; the last change of each slice, one row a slice, is carried
    into the following slices, so that no task sorts more of a hot key than one slice.
    """
    here = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    k = [f"k{i}" for i in range(len(keys))]
    sort = F.struct(*[F.col(x).alias(f"o{i}") for i, x in enumerate(order)], F.col(change_id).alias("id"))
    ok = F.lit(True)
    for x in [*keys, time]:
        ok = ok & F.col(x).isNotNull()
    single = changes.where(ok).select(*here, F.col(time).alias("t"), sort.alias("o")).groupBy(*k, "t").agg(F.max("o").alias("o")).select(*k, "t", F.lit(0).alias("priority"), F.lit(None).cast(dict(events.dtypes)[event_id]).alias("event"), F.col("o.id").alias("change"))
    asked = events.where(ok).select(*here, F.col(time).alias("t"), F.lit(1).alias("priority"), F.col(event_id).alias("event"), F.lit(None).cast(dict(changes.dtypes)[change_id]).alias("change"))
    line = written(single.unionByName(asked), "as-of-line")
    counts = line.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    total = line.count()
    hot = written(counts.where(F.col("n") * HOT_SHARE >= max(total, HOT_SHARE)).select(*k, F.lit(True).alias("hot")), "as-of-hot")
    line = line.join(F.broadcast(hot), k, "left").withColumn("slice", F.when(F.col("hot"), F.floor(F.col("t") / slice_us)).otherwise(0))
    # slices that are hot themselves, at most 1024 again, are cut into finer ones
    full = line.where("hot").groupBy(*k, "slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE >= max(total, HOT_SHARE))
    full = written(full.select(*k, "slice", F.lit(True).alias("full")), "as-of-full-slices")
    part = F.when(F.col("full"), F.floor(F.pmod(F.col("t"), F.lit(slice_us)) * FINER / slice_us)).otherwise(0)
    line = line.join(F.broadcast(full), [*k, "slice"], "left").withColumn("slice", F.col("slice") * FINER + part).drop("hot", "full")
    # one row a slice of a hot key: its last change, carried into later slices as a change before everything else
    last = F.max_by("change", F.when(F.col("change").isNotNull(), F.col("t"))).alias("last")
    slices = line.join(F.broadcast(hot), k, "left_semi").groupBy(*k, "slice").agg(last)
    before = Window.partitionBy(*k).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("change", F.last("last", ignorenulls=True).over(before)).where(F.col("change").isNotNull())
    carried = carried.select(*k, F.lit(None).cast("bigint").alias("t"), F.lit(-1).alias("priority"), F.lit(None).cast(dict(events.dtypes)[event_id]).alias("event"), "change", "slice")
    span = Window.partitionBy(*k, "slice").orderBy(F.col("t").asc_nulls_first(), "priority").rowsBetween(Window.unboundedPreceding, 0)
    out = line.unionByName(carried).withColumn("known", F.last("change", ignorenulls=True).over(span))
    return out.where((F.col("priority") == 1) & F.col("known").isNotNull()).select(F.col("event").alias("event_id"), F.col("known").alias("change_id"))


def in_force(events: DataFrame, changes: DataFrame, time: str, version: str, target: str) -> DataFrame:
    """`events` with `target`: the greatest `version` among all changes known at the event's time, null where none is.

    That is a step function of time. It has at most as many steps as there are versions, which are counted and must be few
    (such as snapshots of a register); the steps go into the plan as one array.
    """
    firsts = changes.where(F.col(time).isNotNull() & F.col(version).isNotNull()).groupBy(version).agg(F.min(time).alias("t"))
    if firsts.count() > 10_000:
        raise ValueError("too many versions for a step function")
    steps, top = [], None
    for row in sorted(firsts.collect(), key=lambda r: (r["t"], r[version])):
        if top is None or row[version] > top:
            top = row[version]
            steps.append((row["t"], top))
    kind = dict(changes.dtypes)[version]
    if not steps:
        return events.withColumn(target, F.lit(None).cast(kind))
    array = F.array(*[F.struct(F.lit(t).cast("bigint").alias("t"), F.lit(v).cast(kind).alias("v")) for t, v in steps])
    return events.withColumn(target, F.try_element_at(F.filter(array, lambda s: s.t <= F.col(time)), F.lit(-1)).v)
