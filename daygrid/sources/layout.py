"""A stored layout of the series that windows, features and joins read without an exchange.

The table is bucketed by entity and sorted inside a bucket by entity, channel and day; bands
of days are its partitions. Whatever groups by entity, or by entity and channel, finds the
rows of a group in one bucket already, and a day window opens only the bands it overlaps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.operators.series import CHANNEL, DAY, ENTITY
from daygrid.session import fresh_path

BAND, BAND_DAYS = "band", 8


def _band(day, days: int):
    return F.floor(day / F.lit(days)).cast("int")


def store_series(series: DataFrame, buckets: int | None = None, days: int = BAND_DAYS, name: str | None = None) -> str:
    """Write ``series`` (one row per entity, channel and day) once; the name of its table.

    The files lie in the shared folder, one for each bucket and band that has rows. Rows
    without entity or day have no place in a series and are left out.
    """
    spark = series.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = name or f"series_{uuid.uuid4().hex}"
    placed = series.where(F.col(ENTITY).isNotNull() & F.col(DAY).isNotNull()).withColumn(BAND, _band(F.col(DAY), days))
    (placed.repartition(n, ENTITY).write.mode("errorifexists").option("path", fresh_path(spark, "series")).option("compression", "zstd")
     .partitionBy(BAND).bucketBy(n, ENTITY).sortBy(ENTITY, CHANNEL, DAY).saveAsTable(table))
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('band_days' = '{days}')")
    return table


def store_by_entity(df: DataFrame, table: str, name: str | None = None) -> str:
    """Write another table in the buckets of a stored series, so that joining both by entity
    moves neither."""
    spark = df.sparkSession
    n = _buckets(spark, table)
    own = name or f"by_entity_{uuid.uuid4().hex}"
    (df.repartition(n, ENTITY).write.mode("errorifexists").option("path", fresh_path(spark, "by-entity")).option("compression", "zstd")
     .bucketBy(n, ENTITY).sortBy(ENTITY).saveAsTable(own))
    return own


def _described(spark: SparkSession, table: str) -> dict[str, str]:
    return {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}


def _buckets(spark: SparkSession, table: str) -> int:
    return int(_described(spark, table)["Num Buckets"])


def _band_days(spark: SparkSession, table: str) -> int:
    found = spark.sql(f"SHOW TBLPROPERTIES {table} ('band_days')").first()
    return int(found["value"])


def stored_series(spark: SparkSession, table: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The stored series, or its days lo…hi read from their bands alone. Pass it on with
    ``clustered=True``: its rows are where a grouping by entity wants them."""
    days = _band_days(spark, table)
    out = spark.table(table)
    if lo is not None:
        out = out.where((F.col(BAND) >= lo // days) & (F.col(DAY) >= lo))
    if hi is not None:
        out = out.where((F.col(BAND) <= hi // days) & (F.col(DAY) <= hi))
    return out.drop(BAND)
