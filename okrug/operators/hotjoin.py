"""Joining rows to a dictionary of their distinct values, whatever share of the rows one value holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from okrug.session import HOT_SHARE


def join_dictionary(rows: DataFrame, dictionary: DataFrame, keys: list[str], count: str = "__n") -> DataFrame:
    """`rows` with the other columns of `dictionary`, null where it has no such key.

    `dictionary` has one row per distinct `keys` (never null) with its number of rows in `count`; it should be a written
    table. Keys that hold one row in 1024 or more, at most 1024 keys whatever the data, are joined by broadcast; the rest,
    none of which is hot, by a shuffle. Rows with a null key come out unjoined;
    columns of `rows` named as ones of the dictionary are replaced.
    """
    total = dictionary.agg(F.sum(count)).first()[0] or 0
    held = [x for x in dictionary.columns if x not in (*keys, count)]
    rows = rows.drop(*held, "__held")
    packed = dictionary.select(*keys, count, F.struct(*held).alias("__held"))
    hot = packed.where(F.col(count) * HOT_SHARE >= max(total, 1)).drop(count)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    at_hot = rows.join(F.broadcast(hot), keys, "left")
    done = at_hot.where(F.col("__held").isNotNull() | ~whole)
    cold = at_hot.where(F.col("__held").isNull() & whole).drop("__held").join(packed.drop(count), keys, "left")
    both = done.unionByName(cold)
    return both.select(*rows.columns, *[F.col(f"__held.{x}").alias(x) for x in held])
