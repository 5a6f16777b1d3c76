"""Queries that write to the shared folder and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.operators import series as S
from daygrid.operators import splits
from daygrid.plans.bindings import FOLDS, SERIES, STATIC
from daygrid.plans.preprocess import validate_and_process
from daygrid.plans.registry import query
from daygrid.session import fresh_path
from daygrid.sources import readers, writers


@query("static_round_trip", "S1 S5", "SELECT entity_id, acctbal, segment, age FROM static", STATIC, "acctbal")
def static_round_trip(t):
    path = fresh_path(t.spark, "static")
    # written in another column order than declared below: binding is by name
    writers.write_table(t.static.select("age", "segment", "acctbal", "entity_id"), path)
    return readers.read_static(t.spark, path, "entity_id long, acctbal double, segment string, age int")


@query("raw_static_round_trip", "S2", """
SELECT CAST(entity_id AS VARCHAR) AS entity_id, coalesce(CAST(crs AS VARCHAR), '') AS crs, segment FROM static""", STATIC)
def raw_static_round_trip(t):
    path = fresh_path(t.spark, "raw")
    writers.write_table(t.static.select("entity_id", "crs", "segment"), path)
    return readers.read_static_raw(t.spark, path)


@query("series_files_round_trip", "S3", """
, wide AS (SELECT DISTINCT entity_id, day FROM series),
names AS (SELECT DISTINCT channel FROM series)
SELECT w.entity_id, w.day, n.channel, s.value FROM wide w CROSS JOIN names n
LEFT JOIN series s ON s.entity_id = w.entity_id AND s.day = w.day AND s.channel = n.channel""", SERIES, "value")
def series_files_round_trip(t):
    path = fresh_path(t.spark, "series")
    writers.write_series_files(S.to_wide(t.series, t.channels), path)
    return readers.read_series_dir(t.spark, path, "folder")


@query("gated_series", "V12 V2 V3 V4 S3", """
, inside AS (SELECT * FROM series WHERE day BETWEEN -3 AND 2),
passed AS (SELECT entity_id FROM inside GROUP BY 1 HAVING count(DISTINCT day) = 6),
names AS (SELECT DISTINCT channel FROM series)
SELECT w.entity_id, w.day, n.channel, i.value FROM (SELECT DISTINCT entity_id, day FROM inside) AS w
JOIN passed p ON p.entity_id = w.entity_id CROSS JOIN names n
LEFT JOIN inside i ON i.entity_id = w.entity_id AND i.day = w.day AND i.channel = n.channel""", SERIES, "value")
def gated_series(t):
    """Series files are validated; those with every day of the window pass the gate and are
    processed, the others are refused."""
    path = fresh_path(t.spark, "gated")
    writers.write_series_files(S.to_wide(t.days(-3, 2), t.channels), path)
    _, series = validate_and_process(t.spark, path, t.channels, -3, 2, entity="folder")
    return series


@query("stacked_files", "S4 U1", """
SELECT entity_id, segment, CAST(NULL AS VARCHAR) AS region FROM static WHERE sex = 'male'
UNION ALL SELECT entity_id, NULL, region FROM static WHERE sex = 'female'""", STATIC)
def stacked_files(t):
    one, two = fresh_path(t.spark, "one"), fresh_path(t.spark, "two")
    writers.write_table(t.static.where("sex = 'male'").select("entity_id", "segment"), one)
    writers.write_table(t.static.where("sex = 'female'").select("region", "entity_id"), two)
    stacked = readers.read_union(t.spark, [one, two])
    return stacked.select(F.col("entity_id").cast("long"), "segment", "region")


@query("partitioned_round_trip", "S6", """
SELECT x.entity_id, x.day, x.channel, x.value, s.region FROM series x JOIN static s ON s.entity_id = x.entity_id
WHERE s.region IN ('ASIA', 'EUROPE')""", SERIES + "," + STATIC, "value")
def partitioned_round_trip(t):
    path = fresh_path(t.spark, "parts")
    writers.write_partitioned(t.static, t.series, path, "region", ["ASIA", "EUROPE"])
    return t.spark.read.parquet(f"{path}/series").select("entity_id", "day", "channel", "value", "region")


@query("split_round_trip", "S7", "SELECT id, y, split FROM folds", FOLDS)
def split_round_trip(t):
    split = splits.stratified_split(t.members, "id", "y", 0.3, 42)
    path = fresh_path(t.spark, "split")
    writers.write_split(split, splits.split_metadata(split, "y", 42, 0.3), path)
    return t.spark.read.parquet(f"{path}/rows").select("id", "y", "split")


@query("folds_round_trip", "S7", "SELECT id, fold FROM folds", FOLDS)
def folds_round_trip(t):
    path = fresh_path(t.spark, "folds")
    writers.write_folds(splits.stratified_folds(t.members, "id", "y", 5, 42).select("id", "fold"), path)
    return t.spark.read.parquet(path).select("id", F.col("fold").cast("int"))


@query("report_round_trip", "S8", """SELECT segment, count(*) AS n FROM static GROUP BY 1""", STATIC)
def report_round_trip(t):
    path = fresh_path(t.spark, "report")
    writers.write_report({"segments": t.static.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))}, path)
    return t.spark.read.schema("segment string, n long").json(f"{path}/segments")
