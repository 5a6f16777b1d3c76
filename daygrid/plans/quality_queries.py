"""Queries for the data-quality checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daygrid.operators import quality as Q
from daygrid.operators import splits
from daygrid.plans.bindings import FOLDS, SERIES, STATIC
from daygrid.plans.registry import query

RAW = """
raw AS (SELECT event_id, user_id AS entity_id, event_type AS channel,
               CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 89 = 0 THEN 'NA'
                    ELSE CAST(value AS VARCHAR) END AS raw FROM events)"""
HEADERS = """
firsts AS (SELECT o_custkey AS file, o_orderpriority AS col, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
headers AS (SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS INTEGER) AS pos, col FROM firsts)"""
EXPECTED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


def raw_cells(t):
    k = F.col("event_id")
    text = F.when(k % 97 == 0, "bad").when(k % 89 == 0, "NA").otherwise(F.col("value").cast("string"))
    return t.events.select(
        "event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("channel"), text.alias("raw")
    )


def headers(t):
    firsts = t.orders.groupBy(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("column")).agg(
        F.min("o_orderkey").alias("k")
    )
    order = Window.partitionBy("file").orderBy("k")
    return firsts.select("file", (F.row_number().over(order) - 1).alias("pos"), "column")


def rule_rows(t):
    """Static rows as text with planted faults."""
    k = F.col("entity_id")
    return t.static.select(
        k.alias("ID"),
        F.when(k % 31 == 0, "old").otherwise((F.col("age") + 5).cast("string")).alias("Age"),
        F.col("sex").alias("Sex"),
        F.when(k % 37 == 0, "").otherwise(F.col("segment")).alias("Segment"),
        F.concat(F.col("crs").cast("string"), F.lit(".0")).alias("Grade"),
        F.when(k % 41 == 0, "soon").otherwise("2024/5/20 0:00").alias("Date"),
    )


RULES = (
    Q.Rule("Age", "integer", 0, 80),
    Q.Rule("Sex", "category", categories=("male",)),
    Q.Rule("Segment", "category", categories=("BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE")),
    Q.Rule("Grade", "number_category", categories=("NA", "0", "1", "2", "3", "4")),
    Q.Rule("Date", "date"),
)
RULE_ROWS = STATIC + """,
texts AS (SELECT entity_id AS "ID", CASE WHEN entity_id % 31 = 0 THEN 'old' ELSE CAST(age + 5 AS VARCHAR) END AS a, sex AS s,
                 CASE WHEN entity_id % 37 = 0 THEN '' ELSE segment END AS g, crs,
                 CASE WHEN entity_id % 41 = 0 THEN 'soon' ELSE '2024/5/20 0:00' END AS d FROM static),
issues AS (
  SELECT "ID" AS row_id, 'Age' AS "column", a AS value, CASE WHEN a = 'old' THEN 'type_error' ELSE 'range_error' END AS issue
  FROM texts WHERE a = 'old' OR TRY_CAST(a AS INTEGER) > 80
  UNION ALL SELECT "ID", 'Sex', s, 'categorical_error' FROM texts WHERE s = 'female'
  UNION ALL SELECT "ID", 'Segment', g, 'categorical_error' FROM texts WHERE g NOT IN ('', 'BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')
  UNION ALL SELECT "ID", 'Grade', concat(crs, '.0'), 'categorical_error' FROM texts WHERE crs = 5
  UNION ALL SELECT "ID", 'Date', d, 'date_format_error' FROM texts WHERE d = 'soon')"""


@query("bad_cells", "V1", "SELECT * FROM raw WHERE raw = 'bad'", RAW)
def bad_cells(t):
    return Q.check_cells(raw_cells(t))


@query("column_check", "V2", """
, expected AS (SELECT * FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '5-LOW')) AS v(place, col)),
missing AS (SELECT f.file, 'missing_column' AS kind, 'error' AS severity, e.col
            FROM (SELECT DISTINCT file FROM headers) AS f CROSS JOIN expected e
            WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.file = f.file AND h.col = e.col)),
extra AS (SELECT file, 'extra_column', 'warning', col FROM headers WHERE col NOT IN (SELECT col FROM expected)),
moved AS (SELECT h.file, 'wrong_order', 'warning', CAST(NULL AS VARCHAR) FROM headers h LEFT JOIN expected e ON e.col = h.col
          GROUP BY 1 HAVING count(*) = 4 AND count(e.col) = 4 AND count(*) FILTER (WHERE h.pos <> e.place) > 0)
SELECT file, kind, severity, col AS "column" FROM missing UNION ALL SELECT * FROM extra UNION ALL SELECT * FROM moved""", HEADERS)
def column_check(t):
    return Q.check_columns(headers(t), EXPECTED)


@query("count_check", "V3", """
, files AS (SELECT o_custkey AS file, count(DISTINCT o_orderpriority) AS c, count(*) AS r FROM orders GROUP BY 1)
SELECT * FROM (
  SELECT file, 'column_count' AS rule, 'error' AS severity, CAST(5 AS BIGINT) AS expected, c AS actual FROM files
  UNION ALL SELECT file, 'data_rows', 'error', 12, r FROM files
  UNION ALL SELECT file, 'rows_with_header', 'error', 14, r + 1 FROM files
  UNION ALL SELECT file, 'configured_rows', 'warning', 14, 13 FROM files) AS x WHERE expected <> actual""", "none AS (SELECT 1)")
def count_check(t):
    # distinct levels first, so one hot customer is spread by its partial aggregates
    levels = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    files = levels.groupBy(F.col("o_custkey").alias("file")).agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n_rows")
    )
    return Q.check_counts(files, 5, 1, 12, 14)


@query("entity_count_check", "V5", """
SELECT CAST(447 AS BIGINT) AS expected, count(DISTINCT user_id) AS actual, count(DISTINCT user_id) <> 447 AS warning FROM events""")
def entity_count_check(t):
    return Q.check_entity_count(t.events, 447, "user_id")


@query("rule_issues", "V6", "SELECT * FROM issues", RULE_ROWS)
def rule_issues(t):
    return Q.check_rules(rule_rows(t), RULES, "ID")


@query("id_continuity", "V7", """
, ids AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY o_custkey) AS place FROM orders)
SELECT 'bad_start' AS issue, CAST(1 AS BIGINT) AS expected, min(id) AS actual FROM ids HAVING min(id) <> 1
UNION ALL SELECT 'gap', place, id FROM ids WHERE place = (SELECT min(place) FROM ids WHERE id <> place)
UNION ALL SELECT 'duplicate', NULL, id FROM ids GROUP BY id HAVING count(*) > 1""", "none AS (SELECT 1)")
def id_continuity(t):
    return Q.check_id_continuity(t.orders, "o_custkey")


@query("issue_counts", "V8", """SELECT issue, "column", count(*) AS n FROM issues GROUP BY 1, 2""", RULE_ROWS)
def issue_counts(t):
    return Q.issue_counts(Q.check_rules(rule_rows(t), RULES, "ID"), ["issue", "column"])


@query("issue_examples", "V8 K4", """
SELECT row_id, "column", value, issue, CAST(example AS INTEGER) AS example FROM (
  SELECT *, row_number() OVER (PARTITION BY issue ORDER BY row_id, "column") AS example FROM issues) AS x
WHERE example <= 3""", RULE_ROWS)
def issue_examples(t):
    return Q.first_examples(Q.check_rules(rule_rows(t), RULES, "ID"), 3)


@query("file_verdicts", "V8 V12 U1", """
, bad AS (SELECT entity_id AS file, count(*) AS n FROM raw WHERE raw = 'bad' GROUP BY 1),
missing AS (SELECT entity_id AS file, count(*) AS n FROM raw WHERE raw = 'NA' GROUP BY 1)
SELECT f.file, coalesce(b.n, 0) AS n_errors, coalesce(m.n, 0) AS n_warnings, b.n IS NULL AS valid
FROM (SELECT DISTINCT entity_id AS file FROM raw) AS f LEFT JOIN bad b ON b.file = f.file LEFT JOIN missing m ON m.file = f.file""", RAW)
def file_verdicts(t):
    raw = raw_cells(t).withColumnRenamed("entity_id", "file")
    errors = Q.check_cells(raw).select("file", F.lit("error").alias("severity"))
    warnings = raw.where(F.col("raw") == "NA").select("file", F.lit("warning").alias("severity"))
    return Q.file_verdicts(raw, Q.union_findings(errors, warnings))


@query("partition_integrity", "V9 J5", """
, ids AS (SELECT DISTINCT entity_id FROM series)
SELECT CASE WHEN region IN ('ASIA', 'EUROPE', 'AFRICA') THEN region ELSE 'other' END AS region, count(*) AS n_entities,
       count(i.entity_id) AS n_with_series, count(*) - count(i.entity_id) AS n_without_series
FROM static s LEFT JOIN ids i ON i.entity_id = s.entity_id GROUP BY 1""", SERIES + "," + STATIC)
def partition_integrity(t):
    return Q.check_partition_integrity(t.static, t.series, "region", ["ASIA", "EUROPE", "AFRICA"])


@query("series_flags", "V9 J5", """
SELECT entity_id, region, EXISTS (SELECT 1 FROM events e WHERE e.user_id = static.entity_id) AS has_series FROM static""", STATIC)
def series_flags(t):
    ids = t.events.select(F.col("user_id").alias("entity_id"))
    return Q.with_series_flag(t.static.select("entity_id", "region"), ids)


@query("fold_check", "V10 U4", """
, n AS (SELECT count(*) AS n FROM folds)
SELECT fold, n - count(*) AS n_train, count(*) AS n_val, CAST(0 AS BIGINT) AS n_overlap, n AS n_ids, true AS ok
FROM folds, n GROUP BY fold, n""", FOLDS)
def fold_check(t):
    return Q.check_folds(splits.fold_roles(t.folds, "id", 5))
