"""Streaming forms of what batch queries do: windows with late data, duplicate suppression, incremental snapshots and running state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and window; events later than `late` are dropped, as the watermark bounds the state."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def smoothed(events: DataFrame, key: str, value: str, beta: float = 0.5) -> DataFrame:
    """(key, n, state): (1 - beta) x value + beta x state before, carried on from batch to batch for each key."""
    kind = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0.0)
        for frame in frames:
            for x in frame[value]:
                s, n = (float(x) if n == 0 else (1 - beta) * float(x) + beta * s), n + 1
        state.update((n, s))
        yield pd.DataFrame({key: [k[0]], "n": [n], "state": [s]})

    return events.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, state double", "n bigint, s double", "update", "NoTimeout")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """The parquet files below `path` as a stream that takes `files` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Reads what is there, batch by batch, and stops; the rows written to `path` so far, with the number `batch` of theirs.

    The checkpoint below `path` remembers what was read, so that a later run takes new files only. A batch is written to a folder of its own, which a batch that is
    tried again replaces, so that rows come once even if executors are lost.
    """
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")).start().awaitTermination()
    return stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
