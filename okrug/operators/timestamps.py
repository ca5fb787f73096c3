"""Mixed timestamp formats and zones: a dictionary of distinct values, parsed once each and joined back to the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from okrug.functions.timeparse import with_epoch
from okrug.session import HOT_SHARE, shared_dir, written

KEYS = ["__source", "__raw"]
#: Of the dictionary's schema and the layouts that were read when it was filled; another version is another table.
VERSION = 2
DICTIONARY = "__source string, __raw string, __zone string, __epoch bigint"
#: Stands for a null source, which is a key of its own; control characters are in no id.
NO_SOURCE = "\x01"


def dictionary_path(spark: SparkSession) -> str:
    """The dictionary that runs share: spark.okrug.timestampDictionary, or a table in the shared folder."""
    return spark.conf.get("spark.okrug.timestampDictionary", None) or f"{shared_dir(spark)}/okrug/timestamp-dictionary-v{VERSION}"


def _parts(spark: SparkSession, path: str) -> list[str]:
    """The complete parts of a dictionary. A run appends a part of its own, so that runs don't meet and one that dies leaves nothing that is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted(p for x in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p := x.getPath().toString(), "_SUCCESS")))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(__source, __raw, __zone, __epoch) of a dictionary, each value once even if several runs added it."""
    parts = _parts(spark, path)
    if not parts:
        return spark.createDataFrame([], DICTIONARY)
    held = spark.read.schema(DICTIONARY).parquet(*parts)
    return held if len(parts) == 1 else held.groupBy(*KEYS, "__zone").agg(F.max("__epoch").alias("__epoch"))


def normalise_timestamps(rows: DataFrame, raw: str, source: str, sources: DataFrame, target: str = "utc_epoch", dictionary: str | None = None) -> DataFrame:
    """`rows` with `target` BIGINT, the instant that the text `raw` means as whole seconds since 1970 UTC; null where unreadable.

    `sources` (source_id, time_zone) is a small dimension whose size is checked. Steps: the distinct (source, zone, text)
    with their counts are written once; those that the dictionary at `dictionary` (default: dictionary_path()) doesn't hold yet
    are parsed and appended, so that a later run parses new texts only; instants are joined back. Texts that hold one
    row in 1024 or more (at most 1024 texts, whatever the data) are joined by broadcast, so that no hot text, such as a
    common bare day, ever meets in one task; all others by a shuffle.

    Null and blank texts give null without entering the dictionary; an unknown or null source gives null unless the text
    itself tells its zone; repeated rows each keep their instant; an empty table gives an empty result. Other columns pass
    through unchanged; a column named as `target` is replaced.
    """
    spark = rows.sparkSession
    if sources.count() > 100_000:
        raise ValueError("sources is meant to be a small dimension")
    kept = [x for x in rows.columns if x != target]
    zones = sources.where(F.col("source_id").isNotNull()).groupBy(F.col("source_id").alias("__source")).agg(F.min("time_zone").alias("__zone"))
    keyed = rows.select(*kept, F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("__source"), F.when(F.trim(F.col(raw)) != "", F.col(raw)).alias("__raw"))
    counts = written(keyed.where(F.col("__raw").isNotNull()).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__n")), "timestamp-values")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    values = counts.join(F.broadcast(zones), "__source", "left")
    path = dictionary or dictionary_path(spark)
    held = read_dictionary(spark, path) if _parts(spark, path) else None
    fresh = values
    if held is not None:
        same = [values[k] == held[k] for k in KEYS] + [values["__zone"].eqNullSafe(held["__zone"])]
        fresh = values.join(held, same, "left_anti")
    part = f"{path}/{uuid.uuid4().hex}"
    with_epoch(fresh.select(*KEYS, "__zone"), "__raw", "__zone", "__epoch").write.parquet(part)
    known = added = spark.read.schema(DICTIONARY).parquet(part)
    if held is not None:  # of this run's values only, with the zone that their source has now
        known = values.join(held, same).select(values["__source"], values["__raw"], held["__epoch"])
        if added.isEmpty():
            at = spark._jvm.org.apache.hadoop.fs.Path(part)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        else:
            known = known.unionByName(added.select(*KEYS, "__epoch"))
    hot_keys = F.broadcast(counts.where(F.col("__n") * HOT_SHARE >= max(total, 1)).select(*KEYS))
    hot = known.join(hot_keys, KEYS, "left_semi").select(*KEYS, F.struct(F.col("__epoch")).alias("__hot"))
    at_hot = keyed.join(F.broadcast(hot), KEYS, "left")
    done = at_hot.where(F.col("__hot").isNotNull() | F.col("__raw").isNull()).select(*kept, F.col("__hot.__epoch").alias(target))
    cold = at_hot.where(F.col("__hot").isNull() & F.col("__raw").isNotNull()).drop("__hot")
    cold = cold.join(known.select(*KEYS, "__epoch"), KEYS, "left").select(*kept, F.col("__epoch").alias(target))
    return done.unionByName(cold)


def unread_timestamps(rows: DataFrame, raw: str, source: str, sources: DataFrame) -> DataFrame:
    """(source, raw, n): the non-blank texts that no layout or zone could be found for, with the number of their rows; a null source stays null."""
    read = normalise_timestamps(rows.select(F.col(raw).alias("raw"), F.col(source).alias("source")), "raw", "source", sources, target="__at")
    return read.where(F.col("__at").isNull() & (F.trim("raw") != "")).groupBy("source", "raw").agg(F.count(F.lit(1)).alias("n"))
