"""What changed between consecutive full snapshots, by subtracting invertible Bloom lookup tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from okrug.functions.hashing import xxhash64
from okrug.session import discard, written

#: Keys that share a hash bucket on average, cells of a bucket's first table, and growth of a table whose peeling failed.
KEYS_A_BUCKET, FIRST_CELLS, GROWTH, ROUNDS = 1000, 384, 4, 4
PEELED = "pair int, bucket bigint, ok boolean, k bigint"


def _cells(states: DataFrame, cells: int) -> DataFrame:
    """One row per non-empty cell of each (pair, bucket): three cells an item, each in a third of its own."""
    third = cells // 3
    places = F.array(*[F.lit(j * third) + F.pmod(F.xxhash64("k", "d", F.lit(j).cast("bigint")), F.lit(third)) for j in range(3)])
    each = states.select("pair", "bucket", "side", "k", "d", F.xxhash64("k", "d").alias("c"), F.xxhash64("d", "k").alias("v"), F.explode(places).alias("cell"))
    sums = each.groupBy("pair", "bucket", "cell").agg(F.sum("side").alias("n"), *[F.bit_xor(x).alias(x) for x in "kdcv"])
    # what both snapshots hold has cancelled out
    return sums.where("n <> 0 OR k <> 0 OR d <> 0 OR c <> 0")


def _peel(cells: int):
    third = cells // 3

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        pair, bucket = int(pdf["pair"].iloc[0]), int(pdf["bucket"].iloc[0])
        at = pdf["cell"].to_numpy()
        n = np.zeros(cells, np.int64)
        sums = {x: np.zeros(cells, np.int64) for x in "kdcv"}
        n[at] = pdf["n"].to_numpy()
        for x in sums:
            sums[x][at] = pdf[x].to_numpy()
        whole = np.bitwise_xor.reduce(sums["v"][:third])
        out = [np.zeros((0, 2), np.int64)]
        for _ in range(cells):
            pure = np.flatnonzero((np.abs(n) == 1) & (xxhash64(sums["k"], sums["d"]) == sums["c"]))
            if not len(pure):
                break
            items = np.unique(np.stack([sums["k"][pure], sums["d"][pure], n[pure]], 1), axis=0)
            k, d, side = items.T
            for j in range(3):
                where = j * third + xxhash64(k, d, np.int64(j)) % third
                np.subtract.at(n, where, side)
                for x, value in (("k", k), ("d", d), ("c", xxhash64(k, d)), ("v", xxhash64(d, k))):
                    np.bitwise_xor.at(sums[x], where, value)
            out.append(items[:, :2])
        items = np.concatenate(out)
        empty = not n.any() and not any(x.any() for x in sums.values())
        # an independent digest of the bucket's difference must equal that of what was recovered
        seen = np.bitwise_xor.reduce(xxhash64(items[:, 1], items[:, 0])) if len(items) else 0
        if not empty or seen != whole:
            return pd.DataFrame({"pair": [pair], "bucket": [bucket], "ok": [False], "k": [0]})
        return pd.DataFrame({"pair": pair, "bucket": bucket, "ok": True, "k": np.unique(items[:, 0])})

    return peel


def snapshot_changes(rows: DataFrame, snapshot: str, key: str, value: str, order: list[str], differs: Column | None = None, first_cells: int = FIRST_CELLS, keys_a_bucket: int = KEYS_A_BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """(key, snapshot, change_kind): the keys added, removed or changed in `value` between each two consecutive snapshots.

    Of several rows of a key in a snapshot the greatest by `order` stands (nulls first); repeated rows therefore change
    nothing. `snapshot` must be sortable; the result names the later of the two. Rows without key or snapshot don't count,
    but a snapshot all of whose keys are null is still a (then empty) snapshot if its rows tell it. `differs` is a condition
    on `before` and `after` (default: null-safe inequality). A single snapshot, or an empty table, gives no rows.

    Each (pair of snapshots, hash bucket of keys) has an invertible Bloom lookup table of key hashes and row digests; as sums
    and XORs are associative, they are pre-aggregated before the shuffle, and a hot bucket cannot arise. Buckets whose table
    doesn't peel are built again, larger; what still fails after `rounds` is compared exactly. Recovered keys are verified
    by a digest and classified against the states themselves, so that the result is exact.
    """
    base = rows.select(F.col(snapshot).alias("snap"), F.col(key).alias("key"), F.col(value).alias("value"), *[F.col(x).alias(f"o{i}") for i, x in enumerate(order)])
    base = written(base.where(F.col("snap").isNotNull()), "snapshot-rows")
    # one row a snapshot: as many as there are snapshots, not rows
    ordinals = written(base.select("snap").distinct().withColumn("s", F.row_number().over(Window.orderBy("snap"))), "snapshots")
    n = ordinals.count()
    if n > 100_000:
        raise ValueError("more snapshots than can be broadcast")
    best = F.max_by("value", F.struct(*[f"o{i}" for i in range(len(order))])).alias("value")
    states = base.where(F.col("key").isNotNull()).groupBy("snap", "key").agg(best)
    states = states.join(F.broadcast(ordinals), "snap").select("s", "key", "value", F.xxhash64("key").alias("k"), F.xxhash64("key", F.coalesce(F.col("value").cast("string"), F.lit("\0")), F.lit(7)).alias("d"))
    states = written(states, "snapshot-states")
    discard(base)
    total = states.count()
    buckets = max(1, -(-total // (keys_a_bucket * max(n, 1))))
    sides = F.filter(F.array(F.struct(F.col("s").alias("pair"), F.lit(1).alias("side")), F.struct((F.col("s") + 1).alias("pair"), F.lit(-1).alias("side"))), lambda x: x.pair.between(2, n))
    items = states.select("key", "value", "k", "d", F.pmod("k", F.lit(buckets)).alias("bucket"), F.explode(sides).alias("x")).select("key", "value", "k", "d", "bucket", "x.pair", "x.side")
    found, todo, cells = [], items, first_cells // 3 * 3
    failed = None
    for _ in range(rounds):
        done = written(_cells(todo, cells).groupBy("pair", "bucket").applyInPandas(_peel(cells), PEELED), "peeled")
        found.append(done.where("ok").select("pair", "k"))
        failed = done.where("NOT ok").select("pair", "bucket")
        if failed.isEmpty():
            failed = None
            break
        todo, cells = items.join(failed, ["pair", "bucket"], "left_semi"), cells * GROWTH
    keys = reduce(DataFrame.unionByName, found)
    candidates = items.join(keys, ["pair", "k"], "left_semi")
    if failed is not None:
        candidates = candidates.unionByName(items.join(failed, ["pair", "bucket"], "left_semi"))
    after, before = F.col("side") == 1, F.col("side") == -1
    both = candidates.groupBy("pair", "key").agg(
        F.max(after.cast("int")).alias("now"), F.max(before.cast("int")).alias("was"), F.max(F.when(after, F.col("value"))).alias("after"), F.max(F.when(before, F.col("value"))).alias("before")
    )
    differs = ~F.col("before").eqNullSafe(F.col("after")) if differs is None else differs
    kind = F.when(F.col("was") == 0, "added").when(F.col("now") == 0, "removed").when(differs, "changed")
    named = both.withColumn("change_kind", kind).where(F.col("change_kind").isNotNull())
    return named.join(F.broadcast(ordinals), F.col("pair") == F.col("s")).select("key", F.col("snap").alias("snapshot"), "change_kind")
