"""Sinks: tables, parquet, delimited parts, JSON documents and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Parquet that replaces what is there."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def create_table(df: DataFrame, path: str) -> int:
    """Parquet that must not exist yet; the rows that were written are counted as they pass and as they are read again, and another number raises. The number of rows."""
    passed = Observation()
    df.observe(passed, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(path)
    n = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if n != passed.get["n"]:
        raise RuntimeError(f"{n} rows in {path}, {passed.get['n']} were written")
    return n


def write_parts(df: DataFrame, path: str, rows_a_file: int = 50_000, delimiter: str = ";") -> None:
    """Delimited files of at most `rows_a_file` rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).option("header", True).option("sep", delimiter).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object a row, NaN as null."""
    kinds = dict(df.dtypes)
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
    clean.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, size, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
