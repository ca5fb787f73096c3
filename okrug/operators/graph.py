"""Measures of weighted graphs given as edge lists (src, dst, w)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from okrug.operators.kernels import MOST_NODES
from okrug.session import written


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int | None = None, every: int = 2, tolerance: float = 1e-8) -> DataFrame:
    """(node, rank); rank flows along edges by weight, that of nodes without a way out goes to all evenly.

    Without `rounds`, a fixed number of them, it ends when no more than `tolerance` is left of all nodes' errors together: a round shrinks
    the error by the damping, so that the changes of the last round tell it, and the number of rounds is bounded too.
    The state is written to the shared folder every few rounds, so that lineage stays short and survives lost executors.
    """
    e = written(edges.where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w")), "edges")
    out = e.groupBy("src").agg(F.sum("w").alias("o"))
    share = written(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("o")).alias("s")), "shares")
    nodes = written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    most = rounds if rounds is not None else max(1, math.ceil(math.log(tolerance / 2) / math.log(damping)))
    for k in range(most):
        before = rank
        given = rank.join(share, rank["node"] == share["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("s")).alias("in"))
        moved = given.agg(F.coalesce(F.sum("in"), F.lit(0.0)).alias("moved"))
        rank = nodes.join(given, nodes["node"] == given["dst"], "left").join(F.broadcast(moved)).select("node", ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + (1 - F.col("moved")) / n)).alias("rank"))
        if (k + 1) % every == 0:
            rank = written(rank, "ranks")
            if rounds is None:
                change = rank.join(before.withColumnRenamed("rank", "before"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0
                if change * damping / (1 - damping) <= tolerance:
                    break
    return rank


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, neighbours) of edges that have both directions."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("neighbours"))


def dense(edges: DataFrame, most: int = MOST_NODES) -> tuple[list, np.ndarray]:
    """Nodes and dense matrix of a graph whose size is checked first; for algorithms that only run on small graphs."""
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes")
    names = sorted(r[0] for r in nodes.collect())
    at, w = {v: i for i, v in enumerate(names)}, np.zeros((len(names), len(names)))
    for s, d, x in edges.select("src", "dst", "w").toLocalIterator():
        w[at[s], at[d]] = x
    return names, w
