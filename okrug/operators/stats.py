"""Tests of association: rank correlations, partial and lagged ones, Kruskal-Wallis; distribution tails over small result columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from okrug.operators.kernels import chi2_upper, t_two_sided
from okrug.operators.network import correlation_from_sums
from okrug.operators.panel import average_rank, false_discovery, wide_rank


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else chi2_upper(a, b) for a, b in zip(x, df)], dtype="float64")


def _sums(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    a, b = F.col(x), F.col(y)
    s = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
    return s.withColumn("r", correlation_from_sums(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))).select(*keys, "n", "r")


def spearman_pairs(long: DataFrame, entity: str, metric: str, value: str, least_n: int = 15, least_distinct: int = 3) -> DataFrame:
    """(x, y, n, rho, p, q): rank correlations of all pairs of metrics over entities that have both, for at least `least_n` entities and `least_distinct` values on each side.

    `long` is (entity, metric, value). Ranks are taken within each pair's common entities; metrics are few, entities many.
    """
    known = long.where(F.col(value).isNotNull()).select(entity, F.col(metric).alias("m"), F.col(value).alias("v"))
    x, y = known.select(entity, F.col("m").alias("x"), F.col("v").alias("vx")), known.select(entity, F.col("m").alias("y"), F.col("v").alias("vy"))
    both = x.join(y, entity).where("x < y")
    both = average_rank(average_rank(both, ["x", "y"], "vx", "rx"), ["x", "y"], "vy", "ry")
    rich = both.groupBy("x", "y").agg(F.countDistinct("vx").alias("dx"), F.countDistinct("vy").alias("dy")).where((F.col("dx") >= least_distinct) & (F.col("dy") >= least_distinct))
    rho = _sums(both, ["x", "y"], "rx", "ry").where(F.col("n") >= least_n).join(rich.select("x", "y"), ["x", "y"]).withColumnRenamed("r", "rho")
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return false_discovery(rho.withColumn("p", t_tail(t, (F.col("n") - 2).cast("double"))), [], "p", "q")


def partial_correlation(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """Correlation of x and y without z."""
    return F.try_divide(rxy - rxz * ryz, F.sqrt(F.nullif((1 - rxz * rxz) * (1 - ryz * ryz), F.lit(0.0))))


def lagged_correlation(series: DataFrame, entity: str, ordinal: str, x: str, y: str, lags: int, least_n: int = 10) -> DataFrame:
    """(entity, lag, r, n): Pearson's r of x at t and y at t + lag, for lags from -lags to lags."""
    a = series.select(entity, F.col(ordinal).alias("t"), F.col(x).alias("x")).where("x IS NOT NULL")
    b = series.select(entity, F.col(ordinal).alias("t2"), F.col(y).alias("y")).where("y IS NOT NULL")
    b = b.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("t", F.col("t2") - F.col("lag"))
    return _sums(a.join(b, [entity, "t"]), [entity, "lag"], "x", "y").where(F.col("n") >= least_n).where("r IS NOT NULL")


def kruskal_wallis(long: DataFrame, metric: str, group: str, value: str) -> DataFrame:
    """(metric, n, h, epsilon2, p, q): tie-corrected H over groups."""
    known = wide_rank(long.where(F.col(metric).isNotNull() & F.col(value).isNotNull() & F.col(group).isNotNull()), [metric], value, "__r")
    per = known.groupBy(metric, group).agg(F.sum("__r").alias("s"), F.count(F.lit(1)).alias("c"))
    h = per.groupBy(metric).agg(F.sum(F.col("s") * F.col("s") / F.col("c")).alias("ss"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("g"))
    ties = known.groupBy(metric, value).agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(metric).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)
    out = h.join(ties, metric).withColumn("h", F.try_divide(raw, 1 - F.col("ties") / (n * n * n - n)))
    out = out.withColumns({"epsilon2": F.try_divide(F.col("h") - F.col("g") + 1, n - F.col("g")), "p": chi2_tail("h", (F.col("g") - 1).cast("double"))})
    return false_discovery(out.select(metric, "n", "h", "epsilon2", "p"), [], "p", "q")


def nearest_centroid(points: DataFrame, centres: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label): the label of the nearest centre; `centres` is (label, c), one row a class."""
    from okrug.operators.validity import few, squared

    d = points.join(few(centres.select(F.col(label).alias("__label"), "c")))
    near = d.groupBy(key).agg(F.min(F.struct(squared(F.col(vector).cast("array<double>"), "c").alias("d"), "__label")).alias("m"))
    return near.select(key, F.col("m.__label").alias(label))


def without_derived(pairs: DataFrame, derived: DataFrame) -> DataFrame:
    """`pairs` (x, y, ...) without those of `derived` (a, b), in either order, of which one is computed from the other."""
    both = derived.select(F.col("a").alias("x"), F.col("b").alias("y")).union(derived.select("b", "a"))
    return pairs.join(both, ["x", "y"], "left_anti")
