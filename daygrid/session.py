"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Adaptive settings matter most: skewed join partitions are split at run time even
# when that costs one more shuffle. Aggregates over rows that a window has already
# sorted run as sort aggregates (several times faster for window features).
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "daygrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Unset, it becomes a folder beside the warehouse, which is shared as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return os.path.join(shared_folder(spark), spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that still read them end with them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(shared_folder(spark), spark.sparkContext.applicationId))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of re-running the
    upstream job) and, being Parquet, keeps column pruning and pushdown.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as a shuffle has, and no fewer than two a core.

    For rows that cost far more than their bytes show: without a number, adaptive execution
    would gather them into a few tasks by size.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def bounded(df: DataFrame, rows: int = 20_000, size: int = 4 << 20) -> DataFrame:
    """``df`` stored, and marked for broadcast if it is proven to be small.

    The proof is the stored table: its rows and its bytes on disk. Nothing is fetched to
    look at it; a larger result joins by shuffle.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "bounded")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    used = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return F.broadcast(stored) if used <= size and stored.count() <= rows else stored
