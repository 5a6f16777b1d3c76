"""The cohort model bound to the given tables, for Spark and as SQL text.

Both sides state the same definitions, missing values included: cells are made
null by a fixed predicate so that every operator meets nulls.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.operators import series as S
from daygrid.operators import splits
from daygrid.sources import layout

LO, HI = -15, 14
ORIGIN = date(2024, 1, 16)
CHANNELS_SQL = "SELECT DISTINCT channel FROM series"

SERIES = """
series AS (
  SELECT entity_id, day, channel,
         CASE WHEN (entity_id * 31 + (day + 15) * 7 + length(channel)) % 11 = 0 THEN NULL ELSE v END AS value
  FROM (SELECT user_id AS entity_id,
               CAST(date_diff('day', DATE '2024-01-16', CAST(ts AS DATE)) AS INTEGER) AS day,
               event_type AS channel, avg(value) AS v
        FROM events GROUP BY 1, 2, 3) AS raw_series)"""

STATIC = """
static AS (
  SELECT c_custkey AS entity_id,
         CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
         c_mktsegment AS segment, r_name AS region, n_name AS nation,
         CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(20 + (c_custkey * 13) % 70 AS INTEGER) END AS age,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST((c_custkey * 7) % 6 AS INTEGER) END AS crs,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST((c_custkey * 11 + 3) % 6 AS INTEGER) END AS icans,
         CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey)"""

FOLDS = """
folds AS (
  SELECT doc_id AS id, quality AS y, toxic,
         CAST(ntile(5) OVER (PARTITION BY quality ORDER BY md5(concat('42-', doc_id))) AS INTEGER) AS fold,
         CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(concat('42-', doc_id)))
                   <= round(count(*) OVER (PARTITION BY quality) * CAST(0.3 AS DOUBLE))
              THEN 'test' ELSE 'train' END AS split
  FROM labels)"""

SCORES = FOLDS + """,
scores AS (
  SELECT 'size' AS model, split, fold, id, y, lang,
         n_chars / (n_chars + CAST(1000 AS DOUBLE)) AS score
  FROM folds JOIN documents ON id = doc_id
  UNION ALL
  SELECT 'phase' AS model, split, fold, id, y, lang,
         (length(text) % 97) / CAST(97 AS DOUBLE) AS score
  FROM folds JOIN documents ON id = doc_id)"""


class Tables:
    """Lazy access to one directory of tables and to the bindings over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def series(self) -> DataFrame:
        return self._series(self.events)

    @cached_property
    def stored(self) -> str:
        """The series in its stored layout: the name of a table, written on first use."""
        return layout.store_series(self.series)

    def days(self, lo: int, hi: int) -> DataFrame:
        """The series of the days lo…hi, read by a range of ``ts`` that reaches the scan."""
        kind = self.events.schema["ts"].dataType.simpleString()
        start, end = (F.lit(str(ORIGIN + timedelta(days=d))).cast(kind) for d in (lo, hi + 1))
        return self._series(self.events.where((F.col("ts") >= start) & (F.col("ts") < end)))

    def _series(self, events: DataFrame) -> DataFrame:
        raw = events.select(
            F.col("user_id").alias("entity_id"),
            F.datediff(F.to_date("ts"), F.lit(ORIGIN)).alias("day"),
            F.col("event_type").alias("channel"), "value",
        )
        planted = (F.col("entity_id") * 31 + (F.col("day") + 15) * 7 + F.length("channel")) % 11 == 0
        return S.daily(raw).withColumn("value", F.when(~planted, F.col("value")))

    @cached_property
    def channels(self) -> list[str]:
        """All channels: the width of the wide tables."""
        return sorted(r[0] for r in self.events.select("event_type").distinct().collect() if r[0] is not None)

    @cached_property
    def static(self) -> DataFrame:
        c, k = self.customer, F.col("c_custkey")

        def gap(every: int, value):
            return F.when(k % every != 0, value)

        # nation and region are fixed dimensions of 25 and 5 rows; the join picks
        # its own strategy from their file sizes
        joined = c.join(self.nation, c["c_nationkey"] == F.col("n_nationkey"), "left").join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return joined.select(
            k.alias("entity_id"),
            gap(13, F.col("c_acctbal")).alias("acctbal"),
            F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("nation"),
            gap(19, (20 + (k * 13) % 70).cast("int")).alias("age"),
            gap(17, ((k * 7) % 6).cast("int")).alias("crs"),
            gap(5, ((k * 11 + 3) % 6).cast("int")).alias("icans"),
            F.when(k % 2 == 0, "male").otherwise("female").alias("sex"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """Labelled documents, one row per entity."""
        return self.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), "toxic")

    @cached_property
    def folds(self) -> DataFrame:
        return splits.assign(self.members, "id", "y", test_share=0.3, k=5, seed=42)

    @cached_property
    def size_scores(self) -> DataFrame:
        """The rows of one model of ``scores``, without reading any text."""
        docs = self.documents.select(F.col("doc_id").alias("id"), "lang", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))
        return self.folds.join(docs, "id").select(F.lit("size").alias("model"), "split", "fold", "id", "y", "lang", "score")

    @cached_property
    def scores(self) -> DataFrame:
        docs = self.documents.select(
            F.col("doc_id").alias("id"), "lang",
            F.array(
                F.struct(F.lit("size").alias("model"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score")),
                F.struct(F.lit("phase").alias("model"), ((F.length("text") % 97) / 97.0).alias("score")),
            ).alias("_m"),
        )
        joined = self.folds.join(docs, "id")
        return joined.select("split", "fold", "id", "y", "lang", F.inline("_m")).select(
            "model", "split", "fold", "id", "y", "lang", "score"
        )
