"""Queries for recoding, labels and column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.functions import labels, recode
from daygrid.operators import columns as C
from daygrid.plans.bindings import FOLDS, SERIES, STATIC
from daygrid.plans.registry import query

SEGMENTS = {"BUILDING": "1", "AUTOMOBILE": "2", "MACHINERY": "3"}


@query("recoded_levels", "F1 F2", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'STANDARD' THEN 'S' END AS level,
       CASE WHEN p_type IS NULL THEN NULL WHEN contains(p_type, 'ALL') THEN 'ALL' ELSE 'B-NHL' END AS grp
FROM part""")
def recoded_levels(t):
    kind = F.col("p_type")
    return t.part.select(
        "p_partkey", recode.recode(kind, {"ECONOMY": "E", "STANDARD": "S"}).alias("level"),
        recode.disease_group(kind).alias("grp"),
    )


@query("count_levels", "F3 F4", """
, raw AS (SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'many'
                         ELSE CAST(p_size % 13 - 2 AS VARCHAR) END AS v FROM part)
SELECT p_partkey,
       CASE WHEN TRY_CAST(v AS DOUBLE) >= 2 THEN '2' ELSE v END AS extranodal,
       CASE WHEN TRY_CAST(v AS DOUBLE) > 3 THEN '4' ELSE v END AS therapy
FROM raw""", "none AS (SELECT 1)")
def count_levels(t):
    key = F.col("p_partkey")
    raw = F.when(key % 23 == 0, None).when(key % 29 == 0, "many").otherwise((F.col("p_size") % 13 - 2).cast("string"))
    return t.part.select(
        "p_partkey", recode.extranodal_level(raw).alias("extranodal"), recode.therapy_line_level(raw).alias("therapy")
    )


@query("integer_grades", "F5 P14 F12", """
, raw AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NA' WHEN c_custkey % 11 = 0 THEN 'unknown'
                        WHEN c_custkey % 13 = 0 THEN NULL ELSE concat(c_custkey % 6, '.5') END AS v FROM customer)
SELECT c_custkey, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v ELSE CAST(c_custkey % 6 AS VARCHAR) END AS grade,
       CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN CAST(c_custkey % 6 AS INTEGER) END AS nullable_int,
       CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN CAST(round_even(TRY_CAST(v AS DOUBLE), 0) AS INTEGER) END AS category,
       CAST(c_custkey % 6 AS VARCHAR) AS level
FROM raw""", "none AS (SELECT 1)")
def integer_grades(t):
    k = F.col("c_custkey")
    text = (
        F.when(k % 7 == 0, "NA").when(k % 11 == 0, "unknown").when(k % 13 == 0, None)
        .otherwise(F.concat((k % 6).cast("string"), F.lit(".5")))
    )
    raw = t.customer.select("c_custkey", text.alias("v"), text.alias("nullable_int"))
    return C.cast_nullable_int(raw, ["nullable_int"]).select(
        "c_custkey", recode.grade_to_int(F.col("v")).alias("grade"), "nullable_int",
        recode.grade_category(recode.number(F.col("v"))).alias("category"),
        recode.level_category((k % 6).cast("double")).alias("level"),
    )


@query("normalized_dates", "F6", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN 'pending' WHEN o_orderkey % 5 = 4 THEN NULL
                        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def normalized_dates(t):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/M/d"))
        .when(k == 2, F.date_format(d, "yyyy/M/d H:mm")).when(k == 3, "pending")
    )
    return t.orders.select("o_orderkey", recode.normalize_date(text).alias("day"))


@query("binarized_grades", "F7 F8", """
SELECT entity_id, CASE WHEN crs IS NULL THEN NULL WHEN crs > 2 THEN 1 ELSE 0 END AS crs_severe,
       CASE WHEN icans IS NULL THEN NULL WHEN icans > 1 THEN 1 ELSE 0 END AS icans_severe,
       CASE WHEN crs >= 2 THEN 1 WHEN crs IS NOT NULL THEN 0 END AS crs_target,
       CASE WHEN crs >= 3 THEN 1 WHEN crs IS NOT NULL THEN 0 END AS crs_high
FROM static""", STATIC)
def binarized_grades(t):
    out = labels.binarize(t.static, {"crs": 2, "icans": 1}, suffix="_severe")
    return out.select(
        "entity_id", "crs_severe", "icans_severe", recode.at_least(F.col("crs"), 2).alias("crs_target"),
        recode.at_least(F.col("crs"), 3).alias("crs_high"),
    )


@query("window_labels", "F9", """
, days AS (SELECT entity_id, day, CAST(floor(value) AS INTEGER) % 7 AS grade FROM series),
hits AS (SELECT entity_id, max(CASE WHEN day BETWEEN 3 AND 5 AND grade >= 6 THEN 1 ELSE 0 END) AS hit FROM days GROUP BY 1)
SELECT s.entity_id, CASE WHEN h.hit IS NOT NULL THEN h.hit WHEN s.crs IS NOT NULL THEN CAST(s.crs >= 6 - 3 AS INTEGER) * 0 + CAST(s.crs >= 6 AS INTEGER)
       WHEN s.icans IS NOT NULL THEN CAST(s.icans >= 6 AS INTEGER) ELSE 0 END AS label
FROM static s LEFT JOIN hits h ON h.entity_id = s.entity_id""", SERIES + "," + STATIC)
def window_labels(t):
    days = t.series.select("entity_id", "day", (F.floor("value").cast("int") % 7).alias("grade"))
    return labels.label_from_window(t.static, days, 3, 5, 6, static_fallbacks=("crs", "icans"))


@query("age_and_burden_bands", "F10 F11 F13", """
SELECT entity_id, CASE WHEN age < 65 THEN '< 65' WHEN age >= 65 THEN '>= 65' END AS age_group,
       CASE WHEN crs = 0 THEN 'none' WHEN crs * 20 <= 25 THEN 'low' WHEN crs * 20 <= 50 THEN 'medium'
            WHEN crs * 20 <= 75 THEN 'high' WHEN crs IS NOT NULL THEN 'very high' END AS band,
       CASE WHEN acctbal IS NULL THEN NULL ELSE greatest(0, least(1, acctbal / CAST(5000 AS DOUBLE))) END AS clipped
FROM static""", STATIC, "clipped")
def age_and_burden_bands(t):
    return t.static.select(
        "entity_id", recode.age_group(F.col("age")).alias("age_group"),
        recode.burden_band(F.col("crs") * 20).alias("band"),
        recode.clip(F.col("acctbal") / 5000.0).alias("clipped"),
    )


@query("display_texts", "F15", """
SELECT segment, format('{}/{}', count(crs), count(*)) AS ratio, printf('%.1f ± %.1f', avg(age), stddev_samp(age)) AS mean_sd,
       printf('%.1f (%.1f-%.1f)', CAST(min(age) AS DOUBLE), CAST(max(age) AS DOUBLE), CAST(max(age) AS DOUBLE)) AS span,
       printf('%d (%.1f%%)', count(crs), count(crs) * CAST(100 AS DOUBLE) / count(*)) AS share
FROM static GROUP BY 1""", STATIC)
def display_texts(t):
    n, k = F.count(F.lit(1)), F.count("crs")
    lo, hi = F.min("age").cast("double"), F.max("age").cast("double")
    return t.static.groupBy("segment").agg(
        recode.ratio_text(k, n).alias("ratio"),
        recode.mean_sd_text(F.avg("age"), F.stddev_samp("age")).alias("mean_sd"),
        recode.median_iqr_text(lo, hi, hi).alias("span"),
        recode.count_pct_text(k, n).alias("share"),
    )


@query("toxicity_targets", "F16", """
SELECT entity_id, CASE WHEN crs > 2 THEN 1 WHEN crs IS NOT NULL THEN 0 END AS crs_severe,
       CASE WHEN icans > 2 THEN 1 WHEN icans IS NOT NULL THEN 0 END AS icans_severe,
       CASE WHEN crs IS NULL AND icans IS NULL THEN NULL WHEN crs > 2 OR icans > 2 THEN 1 ELSE 0 END AS any_severe,
       greatest(crs, icans) AS max_grade,
       CASE WHEN crs IS NULL AND icans IS NULL THEN NULL
            ELSE CASE WHEN crs > 2 THEN 1 ELSE 0 END + CASE WHEN icans > 2 THEN 1 ELSE 0 END END AS n_severe
FROM static""", STATIC)
def toxicity_targets(t):
    return labels.toxicity_targets(t.static.select("entity_id", "crs", "icans"), ["crs", "icans"]).drop("crs", "icans")


@query("numeric_cells", "F14 P13", """
, raw AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 89 = 0 THEN 'NA'
                        ELSE CAST(value AS VARCHAR) END AS v, value FROM events)
SELECT event_id, v <> 'bad' AS numeric_or_missing, CASE WHEN v NOT IN ('bad', 'NA') THEN value END AS number
FROM raw""", "none AS (SELECT 1)", "number")
def numeric_cells(t):
    k = F.col("event_id")
    text = F.when(k % 97 == 0, "bad").when(k % 89 == 0, "NA").otherwise(F.col("value").cast("string"))
    raw = t.events.select("event_id", text.alias("number"), recode.is_numeric_or_missing(text).alias("numeric_or_missing"))
    return C.coerce_numeric(raw, ["number"])


@query("renamed_columns", "P1", """
SELECT c_custkey AS "ID", c_acctbal AS "BMDB", c_mktsegment AS "AAS", c_name AS "full_name" FROM customer""",
       doubles="BMDB")
def renamed_columns(t):
    named = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment", "c_name").toDF(
        "ID", "BM disease burden", "Ann Arbor stage", "full name"
    )
    return C.rename_columns(named, {"BM disease burden": "BMDB", "Ann Arbor stage": "AAS"})


@query("renumbered_channels", "P2 P3", """
, kept AS (SELECT c_custkey AS entity_id, n_name AS channel, c_acctbal AS value
           FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT IN ('NATION_3', 'NATION_7', 'NATION_12')),
names AS (SELECT channel, concat('NATION_', lpad(CAST(row_number() OVER (ORDER BY CAST(substr(channel, 8) AS INTEGER)) AS VARCHAR), 3, '0')) AS fresh
          FROM (SELECT DISTINCT channel FROM kept) AS d)
SELECT entity_id, fresh AS channel, value FROM kept JOIN names USING (channel)""", "none AS (SELECT 1)", "value")
def renumbered_channels(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    series = joined.select(
        F.col("c_custkey").alias("entity_id"), F.col("n_name").alias("channel"), F.col("c_acctbal").alias("value")
    )
    kept = C.drop_channels(series, ["NATION_3", "NATION_7", "NATION_12"])
    return C.rename_channels(kept, C.renumber_channels(kept, ["NATION_"])).select("entity_id", "channel", "value")


@query("constant_columns", "P4", """
SELECT 'l_quantity' AS "column", count(DISTINCT l_quantity) <= 1 AS is_constant FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) <= 1 FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) <= 1 FROM lineitem
UNION ALL SELECT 'same', true UNION ALL SELECT 'nothing', true""")
def constant_columns(t):
    rows = t.lineitem.select("l_quantity", "l_returnflag", "l_shipdate").withColumns(
        {"same": F.when(F.col("l_quantity") > 10, "x"), "nothing": F.lit(None).cast("int")}
    )
    return C.constant_flags(rows)


@query("constants_dropped", "P4", "SELECT p_partkey, p_size, p_brand FROM part")
def constants_dropped(t):
    rows = t.part.select("p_partkey", "p_size", "p_brand", F.lit(1).alias("one"))
    return C.ConstantColumnDropper().fit(rows).transform(rows)


@query("missing_report", "P5 A6", """
, n AS (SELECT count(*) AS n, count(acctbal) AS a, count(age) AS g, count(icans) AS i, count(segment) AS s FROM static)
SELECT "column", n - k AS missing_count, (n - k) * CAST(100 AS DOUBLE) / n AS missing_pct, n AS n_rows FROM (
  SELECT 'acctbal' AS "column", a AS k, n FROM n UNION ALL SELECT 'age', g, n FROM n
  UNION ALL SELECT 'icans', i, n FROM n UNION ALL SELECT 'segment', s, n FROM n) AS x""", STATIC, "missing_pct")
def missing_report(t):
    return C.filter_by_missing(t.static.select("entity_id", "acctbal", "age", "icans", "segment"),
                               exclude=["entity_id"], scope="static").report


@query("missing_filtered", "P5", "SELECT entity_id, acctbal, age, segment FROM static", STATIC, "acctbal")
def missing_filtered(t):
    rows = t.static.select("entity_id", "acctbal", "age", "icans", "segment")
    return C.filter_by_missing(rows, 15.0, scope="static").df


@query("aligned_columns", "P6 U2", """
, a AS (SELECT entity_id, acctbal, segment, age FROM static)
SELECT 'train' AS side, entity_id, segment FROM a""", STATIC)
def aligned_columns(t):
    train = t.static.select("entity_id", "acctbal", "segment", "age")
    test = t.static.select("entity_id", "segment", "acctbal", "age", "crs")
    done = C.align_columns(train, test, drop=["acctbal", "age", "crs", "nowhere"])
    return done.train.select(F.lit("train").alias("side"), *done.train.columns)


@query("selected_features", "P7 P8 P12", "SELECT age, acctbal, nation, sex FROM static", STATIC, "acctbal")
def selected_features(t):
    safe, _ = C.drop_leakage(t.static, ["entity_id"], words=())
    _, flagged = C.drop_leakage(t.static)
    numeric, _ = C.split_by_dtype(safe)
    wanted = [c for c in ("age", "acctbal", "nowhere") if c in numeric or c == "nowhere"]
    picked = C.select_features(safe, safe, wanted, minimum=4, exclude=[*C.LABEL_COLUMNS, "segment", "region", *flagged])
    return safe.select(*picked)


@query("required_columns", "P9", """
SELECT entity_id, crs IS NOT NULL AND icans IS NOT NULL AS kept,
       CASE WHEN crs IS NULL THEN 'crs' WHEN icans IS NULL THEN 'icans' END AS missing_column FROM static""", STATIC)
def required_columns(t):
    kept, dropped = C.require_not_null(t.static.select("entity_id", "crs", "icans"), ["crs", "icans"])
    good = kept.select("entity_id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("missing_column"))
    return good.unionByName(dropped.select("entity_id", F.lit(False).alias("kept"), "missing_column"))


@query("resolved_columns", "P15", "SELECT c_custkey AS entity_id, c_name AS first FROM customer")
def resolved_columns(t):
    rows = t.customer.select("c_name", "c_custkey")
    ident = C.resolve_column(rows, "C_CustKey")
    return rows.select(F.col(ident).alias("entity_id"), F.col(C.resolve_column(rows, "day", first=True)).alias("first"))


@query("prefixed_columns", "P16", "SELECT id, y AS s_y, toxic AS s_toxic FROM folds", FOLDS)
def prefixed_columns(t):
    return C.prefix_columns(t.members, "s_", keep=["id"])
