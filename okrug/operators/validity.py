"""Validity of clusterings, agreement between them, and resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from okrug.session import written


def squared(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(points: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, c, n): mean vectors, from sums by place, so that no group is gathered."""
    flat = points.select(label, F.posexplode(vector).alias("at", "x")).groupBy(label, "at").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return flat.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s.m).alias("c"), F.max("n").alias("n"))


#: Clusters at most; their centres may then be broadcast.
MOST_CLUSTERS = 10_000


def few(centres: DataFrame) -> DataFrame:
    """The centres, written once and marked for broadcast; raises if they are many."""
    c = written(centres, "centres")
    if c.count() > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    return F.broadcast(c)


def block_pairs(points: DataFrame, blocks: int) -> DataFrame:
    """`points` (with a column id) dealt to blocks; each pair (b, other) of blocks gets the rows of b as `left` and those of other as not `left`."""
    p = points.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    # both roles of a row as one column of structs: a co-group of a table with itself would confuse its columns
    n = F.lit(blocks - 1)
    role = lambda mine, other, left: F.struct(mine.cast("int").alias("b"), other.cast("int").alias("other"), F.lit(left).alias("left"))
    roles = F.transform(F.sequence(F.lit(0), n), lambda k: role(F.col("__b"), k, True)), F.transform(F.sequence(F.lit(0), n), lambda k: role(k, F.col("__b"), False))
    return p.withColumn("x", F.explode(F.concat(*roles))).select("x.*", *points.columns)


def nearest_rows(points: DataFrame, key: str, group: str, vector: str, k: int, rows_a_block: int = 2000) -> DataFrame:
    """(key, analog, dist, rank): the k nearest other rows of the same group, exactly; ties go to the lesser key.

    Rows meet in blocks of bounded size, and each block pair keeps only k candidates a row, so that no pairs leave a task.
    """
    blocks = max(8, -(-points.count() // rows_a_block))
    kind = dict(points.dtypes)[key]
    p = points.select(F.col(key).alias("id"), F.col(group).alias("lab"), F.col(vector).cast("array<double>").alias("v"))

    def near(batch: pd.DataFrame) -> pd.DataFrame:
        left, right = batch[batch["left"]], batch[~batch["left"]].sort_values("id")
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "analog": [], "dist": []})
        x, y = np.stack(left["v"]), np.stack(right["v"])
        other = (left["lab"].to_numpy()[:, None] == right["lab"].to_numpy()[None]) & (left["id"].to_numpy()[:, None] != right["id"].to_numpy()[None])
        out = []
        for i, (own, v) in enumerate(zip(left["id"], x)):
            at = np.flatnonzero(other[i])
            d = np.sqrt(((y[at] - v) ** 2).sum(1))
            for j in np.argsort(d, kind="stable")[:k]:
                out.append((own, right["id"].iloc[at[j]], float(d[j])))
        return pd.DataFrame(out, columns=["id", "analog", "dist"])

    some = block_pairs(p, blocks).groupBy("b", "other").applyInPandas(near, f"id {kind}, analog {kind}, dist double")
    at = F.row_number().over(Window.partitionBy("id").orderBy("dist", "analog"))
    return some.withColumn("rank", at).where(F.col("rank") <= k).select(F.col("id").alias(key), "analog", "dist", "rank")


def silhouettes(points: DataFrame, key: str, label: str, vector: str, rows_a_block: int = 2000) -> DataFrame:
    """(key, label, s): exact Euclidean silhouettes, 0 for clusters of one.

    Rows are dealt to blocks of about `rows_a_block`; each block of rows meets each other block once, as arrays, so that the n^2
    distances are computed in numpy, in groups of bounded size, and only per-cluster sums leave a group.
    """
    blocks = max(8, -(-points.count() // rows_a_block))
    kind, lab = dict(points.dtypes)[key], dict(points.dtypes)[label]
    p = points.select(F.col(key).alias("id"), F.col(label).alias("lab"), F.col(vector).cast("array<double>").alias("v"))
    met = block_pairs(p, blocks)

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left"]], group[~group["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "lab": [], "g": [], "total": [], "n": []})
        x, y = np.stack(left["v"]), np.stack(right["v"])
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))
        d[left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None]] = 0
        names, at = np.unique(right["lab"], return_inverse=True)
        total, n = d @ np.eye(len(names))[at], np.bincount(at)
        k = len(names)
        return pd.DataFrame({"id": left["id"].to_numpy().repeat(k), "lab": left["lab"].to_numpy().repeat(k), "g": np.tile(names, len(left)), "total": total.ravel(), "n": np.tile(n, len(left))})

    part = met.groupBy("b", "other").applyInPandas(sums, f"id {kind}, lab {lab}, g {lab}, total double, n bigint")
    whole = part.groupBy("id", "lab", "g").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    own, other = F.col("g") == F.col("lab"), F.col("g") != F.col("lab")
    ab = whole.groupBy("id", "lab").agg(F.max(F.when(own, F.when(F.col("n") > 1, F.col("t") / (F.col("n") - 1)))).alias("a"), F.min(F.when(other, F.col("t") / F.col("n"))).alias("b"))
    return ab.select(F.col("id").alias(key), F.col("lab").alias(label), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("s"))


def calinski_harabasz(points: DataFrame, label: str, vector: str) -> DataFrame:
    """(ch): between / (k - 1) over within / (n - k); null for one cluster."""
    c = few(centroids(points, label, vector))
    whole = centroids(points.withColumn("__all", F.lit(0)), "__all", vector).select(F.col("c").alias("m"))
    between = c.join(F.broadcast(whole)).agg(F.sum(F.col("n") * squared("c", "m")).alias("b"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    within = points.join(F.broadcast(c.select(label, "c")), label).agg(F.sum(squared(F.col(vector).cast("array<double>"), "c")).alias("w"))
    return between.join(within).select(F.try_divide(F.col("b") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("w") / (F.col("n") - F.col("k"))).alias("ch"))


def davies_bouldin(points: DataFrame, label: str, vector: str) -> DataFrame:
    """(db): mean over clusters of the worst (scatter + scatter) / distance of centroids."""
    c = few(centroids(points, label, vector))
    s = points.join(F.broadcast(c.select(label, "c")), label).groupBy(label).agg(F.avg(F.sqrt(squared(F.col(vector).cast("array<double>"), "c"))).alias("s"))
    g = c.join(s, label)
    i, j = g.select(F.col(label).alias("i"), F.col("c").alias("ci"), F.col("s").alias("si")), g.select(F.col(label).alias("j"), F.col("c").alias("cj"), F.col("s").alias("sj"))
    worst = i.join(F.broadcast(j), F.col("i") != F.col("j")).groupBy("i").agg(F.max(F.try_divide(F.col("si") + F.col("sj"), F.sqrt(squared("ci", "cj")))).alias("r"))
    return worst.agg(F.avg("r").alias("db"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(q): Newman's modularity; `edges` has both directions, `labels` is (node, label)."""
    at = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l_{s}"))
    e = edges.join(at("src"), "src").join(at("dst"), "dst")
    total = e.agg(F.sum("w").alias("m2"))
    inside = e.where("l_src = l_dst").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    degrees = e.groupBy("l_src").agg(F.sum("w").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return total.join(inside).join(degrees).select((F.try_divide(F.col("inside"), F.col("m2")) - resolution * F.try_divide(F.col("dd"), F.col("m2") * F.col("m2"))).alias("q"))


def isolation(edges: DataFrame, labels: DataFrame, compat: bool = False) -> DataFrame:
    """(avi, avu) over clusters; `edges` has both directions, `labels` is (node, label).

    avi: mean share of a cluster's weight that stays inside. avu: sum over pairs of different clusters of the weight between them over
    all weight that leaves either, divided by the number of clusters; lower is better, and pairs without such weight are 0.
    With `compat`, avu is the mean of density inside over density inside plus density outside.
    """
    at = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l_{s}"))
    block = edges.join(at("src"), "src").join(at("dst"), "dst").groupBy(F.col("l_src").alias("a"), F.col("l_dst").alias("b")).agg(F.sum("w").alias("w"))
    inside = F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0))
    seen = block.groupBy("a").agg(F.sum("w").alias("all"), inside.alias("inside"))
    per = labels.groupBy(F.col("label").alias("a")).agg(F.count(F.lit(1)).alias("n")).join(seen, "a", "left").fillna(0.0).withColumn("out", F.col("all") - F.col("inside"))
    share = F.coalesce(F.try_divide(F.col("inside"), F.col("all")), F.lit(0.0))
    if compat:
        total = labels.agg(F.count(F.lit(1)).alias("total"))
        d_in = F.coalesce(F.try_divide(F.col("inside"), F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))), F.lit(0.0))
        d_out = F.coalesce(F.try_divide(F.col("out"), F.nullif(F.col("n") * (F.col("total") - F.col("n")), F.lit(0))), F.lit(0.0))
        return per.join(F.broadcast(total)).agg(F.avg(share).alias("avi"), F.avg(F.coalesce(F.try_divide(d_in, d_in + d_out), F.lit(0.0))).alias("avu"))
    ends = lambda s: per.select(F.col("a").alias(s), F.col("out").alias(f"out_{s}"))
    pair = block.where("a <> b").join(ends("a"), "a").join(ends("b"), "b")
    between = pair.agg(F.coalesce(F.sum(F.coalesce(F.try_divide(F.col("w"), F.col("out_a") + F.col("out_b") - F.col("w")), F.lit(0.0))), F.lit(0.0)).alias("u"))
    return per.agg(F.avg(share).alias("avi"), F.count(F.lit(1)).alias("k")).join(between).select("avi", F.try_divide(F.col("u"), F.col("k")).alias("avu"))


def s_dbw(points: DataFrame, label: str, vector: str) -> DataFrame:
    """(s_dbw): scatter within clusters over that of all points, plus density between pairs of clusters over that at their centres.

    Clusters are few: centres go out by broadcast, each point meets the pairs of its own cluster.
    """
    p = points.select(F.col(label).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    flat = p.select("g", F.posexplode("v").alias("at", "x"))
    norm = lambda df, keys: df.groupBy(*keys, "at").agg(F.var_pop("x").alias("s")).groupBy(*keys).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("sig"))
    sig, whole = norm(flat, ["g"]), norm(flat, []).select(F.col("sig").alias("all"))
    parts = sig.agg(F.avg("sig").alias("mean"), (F.sqrt(F.sum("sig")) / F.count(F.lit(1))).alias("stdev"), F.count(F.lit(1)).alias("k"))
    c = few(centroids(p, "g", "v").select("g", "c"))
    # only the centres go out; each point meets the others than its own
    other = c.select(F.col("g").alias("j"), F.col("c").alias("cj"))
    met = p.join(c, "g").join(F.broadcast(other), F.col("g") != F.col("j")).join(F.broadcast(parts.select("stdev")))
    near = lambda x: F.count_if(squared("v", x) <= F.col("stdev") * F.col("stdev"))
    middle = F.transform(F.zip_with("c", "cj", lambda x, y: x + y), lambda x: x / 2)
    by_pair = met.withColumn("u", middle).groupBy(F.least("g", "j").alias("i"), F.greatest("g", "j").alias("k"), "g").agg(near("u").alias("u"), near("c").alias("own"), near("cj").alias("far"))
    first = F.col("g") == F.col("i")
    d = by_pair.groupBy("i", "k").agg(F.sum("u").alias("u"), F.sum(F.when(first, F.col("own")).otherwise(F.col("far"))).alias("a"), F.sum(F.when(first, F.col("far")).otherwise(F.col("own"))).alias("b"))
    between = d.agg(F.avg(F.coalesce(F.try_divide(F.col("u"), F.nullif(F.greatest("a", "b"), F.lit(0))), F.lit(0.0))).alias("dens"))
    return parts.join(whole).join(between).select((F.col("mean") / (F.col("all") + 1e-12) + F.col("dens")).alias("s_dbw"))


def adjusted_rand_by(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, ari) of two labels of the same rows in each group of `by`; 1 where both are trivial in the same way."""
    two = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy(*by, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count(F.lit(1)).alias("n"))

    def margin(label: str, name: str) -> DataFrame:
        return cells.groupBy(*by, label).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias(name))

    j = cells.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("x"), F.sum("n").alias("all"))
    for label, name in (("__a", "r"), ("__b", "c")):
        j = j.join(margin(label, name), by) if by else j.crossJoin(margin(label, name))  # one row each
    e = F.try_divide(F.col("r") * F.col("c"), two(F.col("all")))
    return j.select(*by, F.coalesce(F.try_divide(F.col("x") - e, (F.col("r") + F.col("c")) / 2 - e), F.lit(1.0)).alias("ari"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(ari) of two labels of the same rows; 1 where both are trivial in the same way."""
    return adjusted_rand_by(pairs, [], a, b)


def permutation_z(spark, statistic, labels: np.ndarray, permutations: int = 40, seed: int = 0) -> DataFrame:
    """(observed, mean, sd, z, p): `statistic`(labels) against shuffled labels, each shuffle from a seed of its own; p = (b + 1) / (B + 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [float(statistic(np.random.default_rng([seed, int(i)]).permutation(labels))) for i in batch["id"]]})

    seen = float(statistic(labels))
    null = spark.range(permutations).repartition(min(permutations, 16)).mapInPandas(run, "value double")
    return null.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count_if(F.col("value") >= seen).alias("b")).select(F.lit(seen).alias("observed"), "mean", "sd", F.try_divide(F.lit(seen) - F.col("mean"), F.col("sd")).alias("z"), ((F.col("b") + 1) / (permutations + 1)).alias("p"))
