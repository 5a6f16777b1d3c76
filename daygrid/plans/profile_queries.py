"""Queries for profiles, cohort operations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.operators import cohort, profile
from daygrid.plans.bindings import FOLDS, SERIES, STATIC
from daygrid.plans.registry import query


@query("value_counts", "A1", """
SELECT variable, value, count(*) AS n, count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM static) AS pct FROM (
  SELECT 'segment' AS variable, segment AS value FROM static UNION ALL SELECT 'region', region FROM static
  UNION ALL SELECT 'crs', CAST(crs AS VARCHAR) FROM static) AS x
WHERE value IS NOT NULL GROUP BY 1, 2""", STATIC, "pct")
def value_counts(t):
    return profile.value_counts(t.static, ["segment", "region", "crs"])


@query("description", "A2", """
SELECT variable, count(value) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
       min(value) AS min, max(value) AS max FROM (
  SELECT 'acctbal' AS variable, acctbal AS value FROM static UNION ALL SELECT 'age', CAST(age AS DOUBLE) FROM static) AS x
GROUP BY 1""", STATIC, "mean median std min max")
def description(t):
    return profile.describe(t.static, ["acctbal", "age"])


@query("large_description", "A2", """
SELECT variable, count(value) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
       min(value) AS min, max(value) AS max FROM (
  SELECT 'l_extendedprice' AS variable, l_extendedprice AS value FROM lineitem
  UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) AS x
GROUP BY 1""", doubles="mean median std min max")
def large_description(t):
    return profile.describe(t.lineitem, ["l_extendedprice", "l_quantity", "l_discount"])


@query("ordered_distribution", "A3", """
SELECT crs, count(*) AS n FROM static WHERE crs IS NOT NULL GROUP BY 1 ORDER BY 1""", STATIC)
def ordered_distribution(t):
    return profile.ordered_distribution(t.static, "crs")


@query("event_rates", "A4", """
SELECT variable, count(value) AS n_valid, count(*) - count(value) AS n_missing, count(*) FILTER (WHERE value > 0) AS n_any,
       count(*) FILTER (WHERE value >= 3) AS n_severe,
       count(*) FILTER (WHERE value > 0) * CAST(100 AS DOUBLE) / count(value) AS any_rate,
       count(*) FILTER (WHERE value >= 3) * CAST(100 AS DOUBLE) / count(value) AS severe_rate FROM (
  SELECT 'crs' AS variable, crs AS value FROM static UNION ALL SELECT 'icans', icans FROM static) AS x
GROUP BY 1""", STATIC, "any_rate severe_rate")
def event_rates(t):
    return profile.event_rates(t.static, ["crs", "icans"])


@query("sex_ratio", "A5", """
SELECT count(*) FILTER (WHERE sex = 'male') AS n_first, count(*) FILTER (WHERE sex = 'female') AS n_second,
       count(*) FILTER (WHERE sex = 'male') / CAST(count(*) FILTER (WHERE sex = 'female') AS DOUBLE) AS ratio FROM static""",
       STATIC, "ratio")
def sex_ratio(t):
    return profile.level_ratio(t.static, "sex", "male", "female")


@query("missing_profile", "A6", """
, n AS (SELECT count(*) AS n, count(acctbal) AS a, count(age) AS g, count(crs) AS c FROM static)
SELECT "column", n - k AS missing_count, (n - k) * CAST(100 AS DOUBLE) / n AS missing_pct, n AS n_rows,
       concat(n - k, '/', n) AS ratio FROM (
  SELECT 'acctbal' AS "column", a AS k, n FROM n UNION ALL SELECT 'age', g, n FROM n UNION ALL SELECT 'crs', c, n FROM n) AS x""",
       STATIC, "missing_pct")
def missing_profile(t):
    return profile.missing_profile(t.static, ["acctbal", "age", "crs"])


@query("completeness", "A8", """
SELECT count(*) * 4 AS n_cells, count(*) * 4 - count(acctbal) - count(age) - count(crs) - count(icans) AS n_missing,
       (count(acctbal) + count(age) + count(crs) + count(icans)) * CAST(100 AS DOUBLE) / (count(*) * 4) AS completeness_pct
FROM static""", STATIC, "completeness_pct")
def completeness(t):
    return profile.completeness(t.static, ["acctbal", "age", "crs", "icans"])


@query("distinct_counts", "A9", """
SELECT 'l_partkey' AS variable, count(DISTINCT l_partkey) AS n_distinct, count(DISTINCT l_partkey) * CAST(100 AS DOUBLE) / count(*) AS pct FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), count(DISTINCT l_returnflag) * CAST(100 AS DOUBLE) / count(*) FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate), count(DISTINCT l_shipdate) * CAST(100 AS DOUBLE) / count(*) FROM lineitem""",
       doubles="pct")
def distinct_counts(t):
    return profile.distinct_counts(t.lineitem, ["l_partkey", "l_returnflag", "l_shipdate"])


@query("crosstab", "A21", """
, long AS (SELECT 'segment' AS variable, segment AS value, sex FROM static
           UNION ALL SELECT 'crs', CAST(crs AS VARCHAR), sex FROM static WHERE crs IS NOT NULL),
n AS (SELECT variable, count(*) AS n FROM long GROUP BY 1),
r AS (SELECT variable, value, count(*) AS k FROM long GROUP BY 1, 2),
c AS (SELECT variable, sex, count(*) AS k FROM long GROUP BY 1, 2),
o AS (SELECT variable, value, sex, count(*) AS k FROM long GROUP BY 1, 2, 3)
SELECT r.variable, r.value, c.sex, coalesce(o.k, 0) AS observed, r.k * c.k / CAST(n.n AS DOUBLE) AS expected
FROM r JOIN c ON c.variable = r.variable JOIN n ON n.variable = r.variable
LEFT JOIN o ON o.variable = r.variable AND o.value = r.value AND o.sex = c.sex""", STATIC, "expected")
def crosstab(t):
    return profile.crosstab(t.static, ["segment", "crs"], "sex")


@query("class_weight", "A22", """
SELECT fold, count(*) FILTER (WHERE y = 0) AS n_neg, count(*) FILTER (WHERE y = 1) AS n_pos,
       coalesce(count(*) FILTER (WHERE y = 0) / CAST(nullif(count(*) FILTER (WHERE y = 1), 0) AS DOUBLE), 1) AS pos_weight
FROM folds GROUP BY 1""", FOLDS, "pos_weight")
def class_weights(t):
    return profile.class_weight(t.folds, "y", ["fold"])


@query("histogram", "A23", """
, s AS (SELECT min(acctbal) AS lo, max(acctbal) AS hi,
               greatest(5, least(20, CAST(floor(sqrt(count(*))) AS INTEGER))) AS k FROM static WHERE acctbal IS NOT NULL),
w AS (SELECT lo, (hi - lo) / k AS width, k FROM s),
b AS (SELECT least(CAST(floor((acctbal - lo) / width) AS INTEGER), k - 1) AS bin, count(*) AS n
      FROM static, w WHERE acctbal IS NOT NULL GROUP BY 1)
SELECT 'acctbal' AS variable, g.bin, lo + g.bin * width AS lo, lo + g.bin * width + width AS hi, coalesce(b.n, 0) AS n
FROM w, (SELECT CAST(unnest(generate_series(0, 19)) AS INTEGER) AS bin) AS g LEFT JOIN b ON b.bin = g.bin WHERE g.bin < k""",
       STATIC, "lo hi")
def histogram(t):
    return profile.histogram(t.static, ["acctbal"])


@query("unit_histogram", "A23", """
, g AS (SELECT CAST(unnest(generate_series((SELECT min(crs) FROM static), (SELECT max(crs) FROM static))) AS INTEGER) AS v),
n AS (SELECT crs, count(*) AS n FROM static WHERE crs IS NOT NULL GROUP BY 1)
SELECT 'crs' AS variable, CAST(v - (SELECT min(crs) FROM static) AS INTEGER) AS bin, CAST(v AS DOUBLE) AS lo,
       CAST(v + 1 AS DOUBLE) AS hi, coalesce(n, 0) AS n FROM g LEFT JOIN n ON n.crs = g.v""", STATIC, "lo hi")
def unit_histogram(t):
    return profile.histogram(t.static, ["crs"], "unit")


@query("top_segments", "K1", """
SELECT nation, count(*) AS n FROM static GROUP BY 1 ORDER BY n DESC, nation LIMIT 5""", STATIC)
def top_segments(t):
    counts = t.static.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))
    return profile.top_n(counts, "n", 5, "nation")


@query("first_labels", "A20", """
SELECT o_custkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) AS x WHERE r = 1""")
def first_labels(t):
    return cohort.first_label(t.orders, "o_custkey", "o_orderstatus", "o_orderkey")


@query("dense_ids", "W2 J6", """
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) AS o_custkey FROM orders""")
def dense_ids(t):
    mapping = cohort.id_map(t.orders.select("o_custkey"), "o_custkey")
    return cohort.rekey(t.orders.select("o_orderkey", "o_custkey"), mapping, "o_custkey")


@query("mapped_series", "J6", """
, m AS (SELECT entity_id AS old_id, dense_rank() OVER (ORDER BY entity_id) AS new_id FROM static WHERE region = 'ASIA')
SELECT new_id AS entity_id, day, channel, value FROM series JOIN m ON m.old_id = series.entity_id""",
       SERIES + "," + STATIC, "value")
def mapped_series(t):
    asia = t.static.where(F.col("region") == "ASIA")
    return cohort.rekey(t.series, cohort.id_map(asia)).select("entity_id", "day", "channel", "value")


@query("static_with_features", "J1", """
SELECT s.entity_id, s.segment, x.n FROM static s
LEFT JOIN (SELECT entity_id, count(value) AS n FROM series GROUP BY 1) AS x ON x.entity_id = s.entity_id""",
       SERIES + "," + STATIC)
def static_with_features(t):
    n = t.series.groupBy("entity_id").agg(F.count("value").alias("n"))
    return cohort.left_features(t.static.select("entity_id", "segment"), n)


@query("only_with_both", "J2", """
SELECT s.entity_id, s.segment, x.n FROM static s
JOIN (SELECT entity_id, count(value) AS n FROM series GROUP BY 1) AS x ON x.entity_id = s.entity_id""",
       SERIES + "," + STATIC)
def only_with_both(t):
    n = t.series.groupBy("entity_id").agg(F.count("value").alias("n"))
    return cohort.with_both(t.static.select("entity_id", "segment"), n)


@query("semi_members", "J3", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT entity_id FROM static WHERE segment = 'BUILDING')""", STATIC)
def semi_members(t):
    ids = t.static.where(F.col("segment") == "BUILDING").select(F.col("entity_id").alias("o_custkey"))
    return cohort.only(t.orders.select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("anti_members", "J4", """
SELECT id, y FROM folds WHERE id NOT IN (SELECT id FROM folds WHERE fold = 1)""", FOLDS)
def anti_members(t):
    return cohort.excluding(t.members.select("id", "y"), t.folds.where("fold = 1"), "id")


@query("without_series", "J4 J5", """
SELECT entity_id, segment FROM static WHERE entity_id NOT IN (SELECT user_id FROM events)""", STATIC)
def without_series(t):
    return cohort.without_series(t.static.select("entity_id", "segment"), t.events.withColumnRenamed("user_id", "entity_id"))


@query("series_by_region", "S6", """
SELECT x.entity_id, x.day, x.channel, x.value, s.region FROM series x JOIN static s ON s.entity_id = x.entity_id""",
       SERIES + "," + STATIC, "value")
def series_by_region(t):
    return cohort.partition_series(t.static, t.series, "region")


@query("shared_keys", "U2 U4", """
, a AS (SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders),
b AS (SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders)
SELECT 'both' AS side, id FROM a UNION ALL SELECT 'customer only', id FROM b""", "none AS (SELECT 1)")
def shared_keys(t):
    left, right = t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id"))
    both = left.intersect(right).select(F.lit("both").alias("side"), "id")
    return both.unionByName(left.subtract(right).select(F.lit("customer only").alias("side"), "id"))


@query("importance_union", "U3 K2", """
, a AS (SELECT l_returnflag AS f0, 1 FROM lineitem WHERE false),
one AS (SELECT p_brand AS feature, avg(p_retailprice) AS importance FROM part GROUP BY 1),
two AS (SELECT p_brand AS feature, CAST(avg(p_size) AS DOUBLE) AS importance FROM part GROUP BY 1),
best AS (SELECT feature FROM (SELECT feature FROM one ORDER BY importance DESC, feature LIMIT 6) AS x
         UNION SELECT feature FROM (SELECT feature FROM two ORDER BY importance DESC, feature LIMIT 6) AS y)
SELECT b.feature, coalesce(one.importance, 0) AS price, coalesce(two.importance, 0) AS size,
       (coalesce(one.importance, 0) + coalesce(two.importance, 0)) / 2 AS mean_importance
FROM best b LEFT JOIN one ON one.feature = b.feature LEFT JOIN two ON two.feature = b.feature""", "none AS (SELECT 1)",
       "price size mean_importance")
def importance_union(t):
    p = t.part
    price = p.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    size = p.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("importance"))
    return cohort.features_union([("price", price), ("size", size)], 6)
