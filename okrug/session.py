"""Session defaults, table access and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds at least one row in HOT_SHARE is treated as hot. At most HOT_SHARE keys can do
#: so, whatever the size of the data; that is the proven bound of every table of hot keys.
HOT_SHARE = 1024


def get_spark(app: str = "okrug", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects; a cluster brings its own."""
    parallel = os.cpu_count() if cores == "*" else int(cores)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parallel),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="okrug-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/okrug/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends here, and the rows survive lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._okrug_path = path
    return back


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """As written(), but hashed and sorted by `key`, so that later joins on it shuffle and sort the other side only."""
    spark = df.sparkSession
    path, name = fresh_path(spark, label), f"okrug_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    back = spark.table(name)
    back._okrug_path, back._okrug_table = path, name
    return back


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows, which are counted first, else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(*frames: DataFrame | None) -> None:
    """Deletes the tables behind frames of written() or bucketed(), which nothing may read any more."""
    for df in frames:
        path = getattr(df, "_okrug_path", None)
        if not path:
            continue
        spark = df.sparkSession
        if table := getattr(df, "_okrug_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
