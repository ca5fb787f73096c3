"""Panels of entity and period: grouped measures, shares, windows, ranks and runs, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from okrug.operators.hotjoin import join_dictionary
from okrug.session import written


def period(date: Column | str, kind: str) -> Column:
    """Year (2024), quarter (2024Q1) or month (2024-01) of a date as text."""
    d = F.col(date) if isinstance(date, str) else date
    if kind == "Q":
        return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    return F.date_format(d, {"M": "yyyy-MM", "Y": "yyyy"}[kind])


def masked_sums(df: DataFrame, keys: list[str], amount: str, masks: dict[str, Column], count: str | None = None) -> DataFrame:
    """Per key the sum of `amount` under each condition, and the rows as `count` if that is named; a sum without any row is 0, a null condition is false."""
    rows = [F.count(F.lit(1)).alias(count)] if count else []
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.coalesce(cond, F.lit(False)), F.col(amount)).otherwise(0)).alias(name) for name, cond in masks.items()], *rows)


def ratio(top: Column, bottom: Column) -> Column:
    """Null instead of a division by zero."""
    return F.try_divide(top, F.nullif(bottom, F.lit(0)))


def group_share(df: DataFrame, group: list[str], value: str, target: str) -> DataFrame:
    """`target` = value / total of its group, 0 where the total isn't positive."""
    total = F.sum(value).over(Window.partitionBy(*group))
    return df.withColumn(target, F.when(total > 0, F.col(value) / total).otherwise(0.0))


def shares_with_rest(df: DataFrame, total: str, parts: list[str], rest: str = "other") -> DataFrame:
    """Shares of the parts in the total, and 1 minus their sum."""
    out = df.select("*", *[ratio(F.col(p), F.col(total)).alias(f"sh_{p}") for p in parts])
    return out.withColumn(f"sh_{rest}", F.lit(1.0) - sum((F.col(f"sh_{p}") for p in parts[1:]), F.col(f"sh_{parts[0]}")))


def rolling_mean(df: DataFrame, entity: str, order: str, value: str, rows: int, target: str) -> DataFrame:
    """Mean of the last `rows` rows of an entity, fewer at its start."""
    return df.withColumn(target, F.avg(value).over(Window.partitionBy(entity).orderBy(order).rowsBetween(1 - rows, 0)))


def difference(df: DataFrame, entity: str, order: str, value: str, target: str) -> DataFrame:
    """Value minus the value one row before."""
    return df.withColumn(target, F.col(value) - F.lag(value).over(Window.partitionBy(entity).orderBy(order)))


def demeaned(df: DataFrame, by: str, value: str | Column, target: str) -> DataFrame:
    """Value minus the mean of its cross-section."""
    v = F.col(value) if isinstance(value, str) else value
    return df.withColumn(target, v - F.avg(v).over(Window.partitionBy(by)))


def zscores(df: DataFrame, by: str, value: str, target: str) -> DataFrame:
    """Population z-score within a group; 1e-12 keeps constant series finite."""
    w = Window.partitionBy(by)
    return df.withColumn(target, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-12))


def rank_percent(df: DataFrame, by: list[str], value: str, target: str, descending: bool = False) -> DataFrame:
    """Average rank among the non-null values of a group, in percent; null stays null."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    known = F.col(value).isNotNull()
    rank = F.rank().over(Window.partitionBy(*by, known).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, F.col(value)))
    n = F.count(value).over(Window.partitionBy(*by))
    return df.withColumn(target, F.when(known, (rank + (ties - 1) / 2) / n * 100))


def average_rank(df: DataFrame, by: list[str], value: str, target: str) -> DataFrame:
    """Average rank of the non-null values of a group."""
    known = F.col(value).isNotNull()
    rank = F.rank().over(Window.partitionBy(*by, known).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, F.col(value)))
    return df.withColumn(target, F.when(known, rank + (ties - 1) / 2))


def smaller_values(df: DataFrame, value: str, cuts: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, n, below, total): each distinct non-null value of a group, its rows, the group's rows with smaller values, and all rows of the group.

    Ranks without a window over a whole group: distinct values are dealt to ranges by approximate quantiles of all (equal
    values share a range, so the result is exact), the ranges of a group are counted, and running sums stay within a range.
    """
    values = written(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), "values")
    edges = sorted(set(values.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [k / cuts for k in range(1, cuts)], 0.001)))
    dealt = values.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(value).cast("double"))) if edges else F.lit(0))
    whole = Window.partitionBy(*by)  # over at most `cuts` rows a group
    sums = dealt.groupBy(*by, "__range").agg(F.sum("n").alias("__sum"))
    sums = sums.select(*by, "__range", (F.sum("__sum").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"), F.sum("__sum").over(whole).alias("total"))
    w = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("__inside", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return inside.join(sums, [*by, "__range"]).select(*by, value, "n", (F.col("__inside") + F.col("__before")).alias("below"), "total")


def wide_rank(df: DataFrame, by: list[str], value: str, target: str, percent: bool = False) -> DataFrame:
    """As average_rank() or rank_percent(), for groups of any size: no task sorts more of a group than one range of its distinct values; rows with a null group have no rank.

    Values that many rows share are joined back by broadcast, as hot keys are.
    """
    ranks = smaller_values(df, value, by=tuple(by))
    rank = F.col("below") + (F.col("n") + 1) / 2
    known = written(ranks.select(*by, value, (rank / F.col("total") * 100 if percent else rank).alias(target), F.col("n").alias("__n")), "ranks")
    return join_dictionary(df.drop(target), known, [*by, value])


def wide_quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """As quartiles(), for groups of any number of distinct values: exact, interpolated, from ranks by ranges."""
    v = written(smaller_values(df, value, by=tuple(by)), "ranked-values")
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(value)))
    picked = {}
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        h = (F.col("total") - 1) * q
        picked |= {f"__{name}_lo": at(F.floor(h)), f"__{name}_hi": at(F.ceil(h)), f"__{name}_part": F.max(h - F.floor(h))}
    g = v.groupBy(*by).agg(F.max("total").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), *[c.alias(k) for k, c in picked.items()])
    between = lambda name: (F.col(f"__{name}_lo") + (F.col(f"__{name}_hi") - F.col(f"__{name}_lo")) * F.col(f"__{name}_part")).alias(name)
    return g.select(*by, "n", "min", between("q1"), between("median"), between("q3"), "max")


def nearest_value(points: DataFrame, anchors: DataFrame, by: str, value: str, key: str, anchor: str) -> DataFrame:
    """(key, anchor, dist): for each point the anchor of the same `by` whose value is nearest, ties to the lesser anchor; one sorted pass, no pairs."""
    p = points.select(by, F.col(value).alias("v"), F.col(key).alias("k"), F.lit(None).cast(dict(anchors.dtypes)[anchor]).alias("a"))
    a = anchors.select(by, F.col(value).alias("v"), F.lit(None).cast(dict(points.dtypes)[key]).alias("k"), F.col(anchor).alias("a"))
    w = Window.partitionBy(by).orderBy("v")
    down = F.max(F.when(F.col("a").isNotNull(), F.struct("v", (-F.col("a")).alias("a")))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    up = F.min(F.when(F.col("a").isNotNull(), F.struct("v", "a"))).over(w.rangeBetween(0, Window.unboundedFollowing))
    both = p.unionByName(a).withColumns({"__down": down, "__up": up}).where("k IS NOT NULL")
    choice = F.array_min(F.array_compact(F.array(F.when(F.col("__down").isNotNull(), F.struct((F.col("v") - F.col("__down.v")).alias("d"), (-F.col("__down.a")).alias("a"))), F.when(F.col("__up").isNotNull(), F.struct((F.col("__up.v") - F.col("v")).alias("d"), F.col("__up.a").alias("a"))))))
    return both.withColumn("__m", choice).where("__m IS NOT NULL").select(F.col("k").alias(key), F.col("__m.a").alias(anchor), F.col("__m.d").alias("dist"))


def false_discovery(df: DataFrame, by: list[str], p: str, target: str) -> DataFrame:
    """Benjamini-Hochberg q: the least p n / rank from this rank on; ties share it, null p stays null."""
    known = df.where(F.col(p).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(p))
    raw = known.withColumn("__raw", F.col(p) * n / at)
    after = Window.partitionBy(*by).orderBy(p).rangeBetween(0, Window.unboundedFollowing)
    q = raw.withColumn(target, F.least(F.lit(1.0), F.min("__raw").over(after))).drop("__raw")
    return q.unionByName(df.where(F.col(p).isNull()).withColumn(target, F.lit(None).cast("double")))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by a total order."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__at = 1").drop("__at")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per key, with their place `rank`; Spark drops rows beyond k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def switches(df: DataFrame, entity: str, order: str, label: str) -> DataFrame:
    """(entity, switches): changes of the label between neighbouring rows."""
    before = F.lag(label).over(Window.partitionBy(entity).orderBy(order))
    return df.withColumn("__c", (before != F.col(label)).cast("int")).groupBy(entity).agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("switches"))


def transitions(df: DataFrame, entity: str, order: str, label: str) -> DataFrame:
    """(from_label, to_label, n) over neighbouring rows of an entity."""
    after = F.lead(label).over(Window.partitionBy(entity).orderBy(order))
    return df.select(F.col(label).alias("from_label"), after.alias("to_label")).where("to_label IS NOT NULL").groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame, entity: str, ordinal: str) -> DataFrame:
    """(entity, first, last, length): maximal runs of consecutive ordinals."""
    island = F.col(ordinal) - F.row_number().over(Window.partitionBy(entity).orderBy(ordinal))
    return df.withColumn("__i", island).groupBy(entity, "__i").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count(F.lit(1)).alias("length")).drop("__i")


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Five-number summary with exact, interpolated quantiles."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max")).select(*keys, "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def year_on_year(df: DataFrame, entity: str, year: str, value: str) -> DataFrame:
    """`delta` and `growth` against the year before, if there is one."""
    was = df.select(F.col(entity), (F.col(year) + 1).alias(year), F.col(value).alias("before"))
    return df.join(was, [entity, year], "left").withColumns({"delta": F.col(value) - F.col("before"), "growth": ratio(F.col(value), F.col("before")) - 1})


def prefixed(df: DataFrame, prefix: str, replacement: str = "") -> DataFrame:
    """The columns whose names begin with `prefix`, which is replaced."""
    return df.select(*[F.col(c).alias(replacement + c[len(prefix) :]) for c in df.columns if c.startswith(prefix)])


def money_text(cents: Column) -> Column:
    """Hundredths of a non-negative sum as text: thousands parted by blanks, a decimal comma and two digits."""
    whole = F.translate(F.format_number(F.call_function("div", cents, F.lit(100)), 0), ",", " ")
    return F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def signed_text(value: Column, unit: int = 1) -> Column:
    """A whole number of units with its sign, none for 0; what is less than a unit is dropped."""
    sign = F.when(value > 0, "+").when(value < 0, "-").otherwise("")
    return F.concat(sign, F.translate(F.format_number(F.call_function("div", F.abs(value), F.lit(unit)), 0), ",", " "))


def paged(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """`page` from 1, of so many rows each, by a total order; for lists that are shown, as one task numbers them."""
    return df.withColumn("page", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / rows).cast("int") + 1)


def shared_domain(df: DataFrame, value: str, ticks: int) -> DataFrame:
    """(lo, hi, step) of all series together; the step is 1, 2 or 5 times a power of ten and gives about `ticks` ticks. Null for no values, step null for equal ones."""
    raw = (F.col("hi") - F.col("lo")) / ticks
    d = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn("raw", F.when(raw > 0, raw))
    p = F.pow(F.lit(10.0), F.floor(F.log10("raw")))
    step = F.when(F.col("raw") <= p, p).when(F.col("raw") <= 2 * p, 2 * p).when(F.col("raw") <= 5 * p, 5 * p).otherwise(10 * p)
    return d.select("lo", "hi", F.when(F.col("raw").isNotNull(), step).alias("step"))


def index_parts(metrics: DataFrame, entity: str, indices: dict[str, dict[str, int]]) -> DataFrame:
    """(index, entity, metric, value, pct): for each index, which maps metrics to their sense (1 or -1), its metrics' percent ranks among the entities that have them.

    `metrics` is (entity, metric, value). The definitions are a few settings and are sent out.
    """
    spark = metrics.sparkSession
    rows = [(i, m, s) for i, parts in indices.items() for m, s in parts.items()]
    wanted = F.broadcast(spark.createDataFrame(rows, "index string, metric string, sense int"))
    x = metrics.select(entity, "metric", "value").join(wanted, "metric").withColumn("__v", F.col("value") * F.col("sense"))
    return rank_percent(x, ["index", "metric"], "__v", "pct").select("index", entity, "metric", "value", "pct")


def composed_indices(metrics: DataFrame, entity: str, indices: dict[str, dict[str, int]]) -> DataFrame:
    """(index, entity, score): the mean of the percent ranks that index_parts() gives; a missing metric is left out of the mean."""
    return index_parts(metrics, entity, indices).groupBy("index", entity).agg(F.avg("pct").alias("score"))


def by_presets(df: DataFrame, key: str, presets: dict[str, tuple[tuple[str, str, float], ...]]) -> DataFrame:
    """(preset, key) of the rows that fulfil all conditions (column, >= or <=, percentile) of a preset; percentiles are shares of smaller values among the others, in percent.

    A missing value passes no condition. Presets are a few settings.
    """
    ranked = df
    for c in sorted({c for conditions in presets.values() for c, _, _ in conditions}):
        share = smaller_values(df, c).select(F.col(c).alias("__v"), F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1) * 100).otherwise(0.0).alias(f"__{c}"), F.col("n").alias("__n"))
        ranked = join_dictionary(ranked.withColumn("__v", F.col(c)), written(share, "percentiles"), ["__v"]).drop("__v")
    held = []
    for name, conditions in presets.items():
        whole = F.lit(True)
        for c, op, at in conditions:
            whole = whole & F.coalesce(F.col(f"__{c}") >= at if op == ">=" else F.col(f"__{c}") <= at, F.lit(False))
        held.append(F.when(whole, F.lit(name)))
    return ranked.select(F.explode(F.array_compact(F.array(*held))).alias("preset"), key)


def coverage(df: DataFrame, entity: str, ordinal: str, value: str) -> DataFrame:
    """(entity, covered, first, last, longest_gap, median, least, most): periods that an entity has, the longest run of missing ones between them, and its values' spread."""
    gap = F.col(ordinal) - F.lag(ordinal).over(Window.partitionBy(entity).orderBy(ordinal)) - 1
    g = df.withColumn("__gap", gap).groupBy(entity).agg(F.count(F.lit(1)).alias("covered"), F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.coalesce(F.max("__gap"), F.lit(0)).alias("longest_gap"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g
