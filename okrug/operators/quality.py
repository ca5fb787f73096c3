"""Checks of data as queries: each gives one row (check, bad, total), so that many can be unioned and none hides its figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from okrug.operators.panel import rank_percent


def rows_that(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """How many rows fulfil a condition that none should."""
    return df.agg(F.lit(name).alias("check"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"), F.count(F.lit(1)).alias("total"))


def repeated_keys(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """How many keys have more than one row."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.lit(name).alias("check"), F.count_if(F.col("n") > 1).alias("bad"), F.count(F.lit(1)).alias("total"))


def orphans(df: DataFrame, name: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """How many non-null keys have no parent row; keys are reduced to distinct ones with their counts first, so that no key is hot."""
    keys = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_key).alias("__k")).distinct().withColumn("hit", F.lit(True))
    j = keys.join(known, "__k", "left")
    return j.agg(F.lit(name).alias("check"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def conflicting(df: DataFrame, name: str, keys: list[str], payload: list[str]) -> DataFrame:
    """How many keys have more than one version of a payload."""
    v = df.groupBy(*keys).agg(F.countDistinct(F.xxhash64(*payload)).alias("v"))
    return v.agg(F.lit(name).alias("check"), F.count_if(F.col("v") > 1).alias("bad"), F.count(F.lit(1)).alias("total"))


def same_count(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows gained or lost between two frames."""
    a, b = left.agg(F.count(F.lit(1)).alias("a")), right.agg(F.count(F.lit(1)).alias("b"))
    return a.join(b).select(F.lit(name).alias("check"), F.abs(F.col("a") - F.col("b")).alias("bad"), F.col("a").alias("total"))


def asymmetric_edges(edges: DataFrame, name: str, tolerance: float = 1e-9) -> DataFrame:
    """Edges whose reverse is missing or weighs otherwise."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w2"))
    j = edges.join(back, ["src", "dst"], "left")
    return rows_that(j, name, F.col("w2").isNull() | (F.abs(F.col("w") - F.col("w2")) > tolerance))


def totals_hold(parts: DataFrame, totals: DataFrame, by: str, entity: str, value: str, published: str) -> DataFrame:
    """(by, parts, entities, holds): whether the parts of each group sum to its published total, a unit of rounding a part allowed; a group without parts fails.

    `parts` has one whole-number `value` an entity and group; more parts than entities tell that one was matched twice.
    """
    sums = parts.groupBy(by).agg(F.count(F.lit(1)).alias("parts"), F.count_distinct(entity).alias("entities"), F.sum(value).alias("__sum"))
    j = totals.join(sums, by, "left")
    holds = F.coalesce(F.abs(F.col("__sum") - F.col(published)) <= F.col("parts"), F.lit(False))
    return j.select(by, F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("entities", F.lit(0)).alias("entities"), holds.alias("holds"))


def parts_complete(df: DataFrame, part: str, ordinal: str) -> DataFrame:
    """(part, lines, last, complete): whether each part has every ordinal from 1 to its last exactly once."""
    g = df.groupBy(part).agg(F.count(F.lit(1)).alias("lines"), F.max(ordinal).alias("last"), F.count_distinct(ordinal).alias("__d"))
    return g.select(part, "lines", "last", ((F.col("__d") == F.col("last")) & (F.col("lines") == F.col("last"))).alias("complete"))


def percentiles_hold(df: DataFrame, by: list[str], value: str, stored: str) -> DataFrame:
    """(by, n, off): values whose stored percent rank is more than half a rank from the one computed again."""
    again = rank_percent(df, by, value, "__pct").join(df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by)
    return again.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col(stored) - F.col("__pct")) > F.lit(50.0) / F.col("__n")).alias("off"))


def missing_numbers(df: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """(number): the whole numbers from `first` to `last` that no row has."""
    return df.sparkSession.range(first, last + 1).withColumnRenamed("id", "number").join(df.select(F.col(column).cast("bigint").alias("number")).distinct(), "number", "left_anti")


def report(checks: list[DataFrame]) -> DataFrame:
    """All checks, with their verdicts."""
    return reduce(DataFrame.unionByName, checks).withColumn("verdict", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL"))
