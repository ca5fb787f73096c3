"""Taxpayer numbers (INN): digits, check digits and the normal form, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weights of the public check-digit rule.
WEIGHTS_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
WEIGHTS_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
WEIGHTS_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def _digit(text: Column, at: Column | int) -> Column:
    return F.ascii(F.substring(text, F.lit(at) if isinstance(at, int) else at, F.lit(1))) - F.lit(48)


def _control(text: Column, weights: tuple[int, ...]) -> Column:
    # a fold over constant (place, weight) pairs: written out term by term, the generated code would be too long to compile
    pairs = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(w).alias("w")) for k, w in enumerate(weights, 1)])
    return F.aggregate(pairs, F.lit(0), lambda total, x: total + _digit(text, x.at) * x.w) % 11 % 10


def inn_valid(text: Column) -> Column:
    """`text` should be a plain column, as it is read once a digit. True where it is 10 or 12 ASCII digits with right check digits; false otherwise, also for null."""
    ten = text.rlike("^[0-9]{10}$") & (_control(text, WEIGHTS_10) == _digit(text, 10))
    twelve = text.rlike("^[0-9]{12}$") & (_control(text, WEIGHTS_11) == _digit(text, 11)) & (_control(text, WEIGHTS_12) == _digit(text, 12))
    return F.coalesce(F.when(F.length(text) == 10, ten).when(F.length(text) == 12, twelve), F.lit(False))


def with_normal_inn(df: DataFrame, source: str, target: str) -> DataFrame:
    """Adds `target`: the digits of `source`, filled with leading zeros to 10, or null unless the check digits hold.

    A text without any digit has no INN. The steps are separate projections, so that the digits are extracted once a row.
    """
    digits, filled = f"__{target}_digits", f"__{target}_filled"
    # translate() would need every possible character; most values are plain digits and pass the cheap test
    plain = F.col(source).rlike("^[0-9]+$")
    df = df.withColumn(digits, F.when(plain, F.col(source)).otherwise(F.regexp_replace(F.col(source), "[^0-9]", "")))
    df = df.withColumn(filled, F.when(F.length(digits).between(1, 9), F.lpad(F.col(digits), 10, "0")).otherwise(F.col(digits)))
    return df.withColumn(target, F.when(inn_valid(F.col(filled)), F.col(filled))).drop(digits, filled)
