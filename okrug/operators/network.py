"""Layers of similarity between entities as edge lists (src, dst, w), and what is done with them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from okrug.session import written


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges and their reverses."""
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def unit(edges: DataFrame) -> DataFrame:
    """Negative weights clipped to 0, loops dropped, all divided by the greatest weight (unchanged where that is 0)."""
    clean = edges.where("src <> dst").withColumn("w", F.greatest("w", F.lit(0.0)))
    most = clean.agg(F.max("w").alias("m"))
    return clean.join(F.broadcast(most)).withColumn("w", F.when(F.col("m") > 0, F.col("w") / F.col("m")).otherwise(F.col("w"))).drop("m")


def knn(edges: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """The k heaviest edges of each node, kept in both directions; zero weights are no edges, ties go to the lesser neighbour.

    `edges` has both directions. k must be less than the number of nodes n, where that is given.
    """
    if k < 1 or (n is not None and k >= n):
        raise ValueError("k must be at least 1 and less than the number of nodes")
    best = edges.where("w > 0 AND src <> dst").withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.col("w").desc(), "dst"))).where(F.col("r") <= k)
    return symmetric(best).groupBy("src", "dst").agg(F.max("w").alias("w"))


def pairs_of(left: DataFrame, key: str, columns: list[str], on: str | None = None) -> DataFrame:
    """Pairs of different entities, i < j, that meet in `on` (a period); columns come as x_i and x_j."""
    shared = [on] if on else []
    take = lambda s: left.select(F.col(key).alias(s), *shared, *[F.col(c).alias(f"{c}_{s}") for c in columns])
    i, j = take("i"), take("j")
    return i.join(j, on).where("i < j") if on else i.join(j, F.col("i") < F.col("j"))


def correlation_from_sums(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson's r from sums; null for constant series."""
    return F.try_divide(n * xy - x * y, F.sqrt(F.nullif((n * xx - x * x) * (n * yy - y * y), F.lit(0.0))))


def comovement(series: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """(src, dst, w), src < dst: Pearson's r of two entities' series over the times both have, from one grouped pass of sums; undefined is 0."""
    p = pairs_of(series.where(F.col(value).isNotNull()), entity, [value], time)
    a, b = F.col(f"{value}_i"), F.col(f"{value}_j")
    s = p.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(b * b).alias("yy"), F.sum(a * b).alias("xy"))
    r = correlation_from_sums(*(F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    return s.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.coalesce(r, F.lit(0.0)).alias("w"))


def lead_lag(series: DataFrame, entity: str, ordinal: str, z: str, lags: int, length: int) -> DataFrame:
    """(src, dst, w, lag): for each ordered pair the greatest positive mean product of src's z at t and dst's z at t + lag, lag 1..lags; of equal ones the smaller lag."""
    shifted = series.select(F.col(entity).alias("dst"), F.col(ordinal).alias("t2"), F.col(z).alias("z2"))
    moved = shifted.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("t", F.col("t2") - F.col("lag"))
    met = series.select(F.col(entity).alias("src"), F.col(ordinal).alias("t"), F.col(z).alias("z1")).join(moved, "t").where("src <> dst")
    c = met.groupBy("src", "dst", "lag").agg((F.sum(F.col("z1") * F.col("z2")) / (F.lit(length) - F.first("lag"))).alias("w")).where("w > 0")
    return c.groupBy("src", "dst").agg(F.max(F.struct("w", (-F.col("lag")).alias("l"))).alias("m")).select("src", "dst", F.col("m.w").alias("w"), (-F.col("m.l")).alias("lag"))


def flow_layer(flows: DataFrame, least: float = 0.0) -> DataFrame:
    """Symmetric flow similarity: log(1 + 1000 (N + N')), N = flow / sqrt(out x in), margins of at least 1; `flows` is (src, dst, w)."""
    f = flows.where((F.col("src") != F.col("dst")) & (F.col("w") >= least))
    out = f.groupBy("src").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("o"))
    into = f.groupBy("dst").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("i"))
    n = f.join(out, "src").join(into, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("o") * F.col("i"))).alias("w"))
    both = symmetric(n).groupBy("src", "dst").agg(F.log1p(F.sum("w") * 1000).alias("w"))
    return unit(both)


def fuse(attribute: DataFrame, layers: dict[str, tuple[DataFrame, float]], alpha: float) -> DataFrame:
    """alpha x attribute layer + (1 - alpha) x unit of the weighted mean of the other layers; a missing edge weighs 0."""
    total = sum(w for _, w in layers.values())
    mean = reduce(DataFrame.unionByName, (layer.select("src", "dst", (F.col("w") * (w / total)).alias("w")) for layer, w in layers.values())).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    parts = attribute.select("src", "dst", (F.col("w") * alpha).alias("w")).unionByName(unit(mean).select("src", "dst", (F.col("w") * (1 - alpha)).alias("w")))
    return unit(parts.groupBy("src", "dst").agg(F.sum("w").alias("w")))


def gaussian(distances: DataFrame) -> DataFrame:
    """Distance to similarity: exp(-(d / median)^2); where the median is 0, equal entities are 1 and others 0."""
    sigma = distances.agg(F.median("w").alias("s"))
    d = distances.join(F.broadcast(sigma))
    return d.withColumn("w", F.when(F.col("s") > 0, F.exp(-F.pow(F.col("w") / F.col("s"), F.lit(2)))).otherwise((F.col("w") == 0).cast("double"))).drop("s")


def dtw(a: np.ndarray, b: np.ndarray, window: int) -> float:
    """Dynamic time warping with a Sakoe-Chiba band: root of the least sum of squared differences."""
    n, m = len(a), len(b)
    band = max(window, abs(n - m))
    row = np.full(m + 1, np.inf)
    row[0] = 0.0
    for i in range(1, n + 1):
        new = np.full(m + 1, np.inf)
        low, high = max(1, i - band), min(m, i + band)
        for j in range(low, high + 1):
            new[j] = (a[i - 1] - b[j - 1]) ** 2 + min(row[j], row[j - 1], new[j - 1])
        row = new
    return float(np.sqrt(row[m]))


def dtw_distances(series: DataFrame, entity: str, values: str, window: int) -> DataFrame:
    """(src, dst, w), src < dst: warping distances of z-normalised series (arrays); constant series are all zeros, so distances stay finite."""
    kind = dict(series.dtypes)[entity]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def z(v):
            v = np.asarray(v, float)
            s = v.std()
            return (v - v.mean()) / s if s > 0 else np.zeros_like(v)

        for batch in batches:
            yield pd.DataFrame({"src": batch["i"], "dst": batch["j"], "w": [dtw(z(a), z(b), window) for a, b in zip(batch["v_i"], batch["v_j"])]})

    p = pairs_of(series.select(entity, F.col(values).alias("v")), entity, ["v"])
    return p.repartition("i", "j").mapInPandas(run, f"src {kind}, dst {kind}, w double")


def cosine_layer(vectors: DataFrame, entity: str, values: str) -> DataFrame:
    """(src, dst, w), src < dst: (1 + cosine) / 2 of two attribute vectors."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    scaled = vectors.select(entity, norm.alias("n"), F.col(values).alias("v")).select(entity, F.transform("v", lambda x: x / F.col("n")).alias("v"))
    dot = F.aggregate(F.zip_with("v_i", "v_j", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs_of(scaled, entity, ["v"]).select(F.col("i").alias("src"), F.col("j").alias("dst"), ((dot + 1) / 2).alias("w"))


def road_distance(roads: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(src, dst, w) for all ordered pairs of `nodes` (node), a dimension: the least distance of one `type` in either direction, null where there is none."""
    own = roads.where(F.col("type") == kind).select("src", "dst", "w")
    least = symmetric(own).where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
    pairs = pairs_of(nodes.withColumnRenamed("node", "mo"), "mo", [])
    every = symmetric(pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(0.0).alias("w"))).drop("w")
    return every.join(least, ["src", "dst"], "left")


def leaders(edges: DataFrame) -> DataFrame:
    """(leader, follower, lead, lag) of lead_lag() edges: those stronger than the edge the other way round, which counts as 0 where it is missing."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back"))
    both = edges.join(back, ["src", "dst"], "left").withColumn("lead", F.col("w") - F.coalesce("back", F.lit(0.0)))
    return both.where("lead > 0").select(F.col("src").alias("leader"), F.col("dst").alias("follower"), "lead", "lag")


def shown_edges(edges: DataFrame, least: float, selected: list | None = None, direction: str = "both", most: int | None = None, log: bool = False) -> DataFrame:
    """Edges (src, dst, w) from the percentile `least` of all weights (or their logarithms) on, that leave (`out`), reach (`in`) or touch a selected node, the heaviest `most` of them with their `place`."""
    x = F.log10("w") if log else F.col("w")
    bound = edges.agg(F.percentile(x, F.lit(least)).alias("__least"))
    kept = edges.join(F.broadcast(bound)).where(x >= F.col("__least")).drop("__least")
    if selected is not None:
        out, into = F.col("src").isin(selected), F.col("dst").isin(selected)
        kept = kept.where({"out": out, "in": into, "both": out | into}[direction])
    order = [F.col("w").desc(), F.col("src"), F.col("dst")]
    if most is not None:  # what is numbered in one task is as short as what is shown
        kept = kept.orderBy(*order).limit(most)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def name_ratios(left: DataFrame, a: str, x: str, right: DataFrame, b: str, y: str, least: float, most: int = 10_000) -> DataFrame:
    """(a, b, ratio) of pairs of names whose ratio, 1 - edits / longer length, is `least` or more; lists of at most `most` names, the right one of which is sent out."""
    for df in (left, right):
        if df.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} names")
    longer = F.greatest(F.length(x), F.length(y))
    near = left.where(F.length(x) > 0).select(a, x).join(F.broadcast(right.where(F.length(y) > 0).select(b, y)), F.least(F.length(x), F.length(y)) >= least * longer)
    return near.withColumn("ratio", 1 - F.levenshtein(x, y) / longer).where(F.col("ratio") >= least).select(F.col(a).alias("a"), F.col(b).alias("b"), "ratio")


def greedy_pairs(scores: DataFrame) -> DataFrame:
    """(a, b, ratio): pairs one to one, the best first; ties go to the lesser a, then the lesser b.

    Pairs that are the best for both of their ends are taken, and their ends with them, until none is left: the same as taking one pair after the other, in few rounds.
    """
    left, out = written(scores, "pairs-left"), None
    while not left.isEmpty():
        best = F.struct(-F.col("ratio"), F.col("a"), F.col("b"))
        by_a = left.groupBy("a").agg(F.min(best).alias("m")).select("a", F.col("m.b").alias("b"))
        by_b = left.groupBy("b").agg(F.min(best).alias("m")).select(F.col("m.a").alias("a"), "b")
        taken = written(left.join(by_a, ["a", "b"], "left_semi").join(by_b, ["a", "b"], "left_semi"), "pairs-taken")
        out = taken if out is None else out.unionByName(taken)
        left = written(left.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"), "pairs-left")
    return out if out is not None else left
