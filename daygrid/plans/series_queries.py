"""Queries over the day-indexed series."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.operators import profile, quality
from daygrid.operators import series as S
from daygrid.operators.columns import drop_unmeasured
from daygrid.operators.cohort import left_features
from daygrid.plans.bindings import HI, LO, SERIES, STATIC
from daygrid.plans.feature_table import feature_table, series_features
from daygrid.plans.registry import query
from daygrid.sources import layout

WINDOW = """
, w AS (SELECT * FROM series WHERE day BETWEEN -15 AND 2 AND value IS NOT NULL),
steps AS (SELECT *, (value + lag(value) OVER o) / 2 * (day - lag(day) OVER o) AS step
          FROM w WINDOW o AS (PARTITION BY entity_id, channel ORDER BY day)),
points AS (
  SELECT entity_id, channel, count(*) AS count, avg(value) AS mean, median(value) AS median,
         stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
         CASE WHEN count(*) >= 2 THEN regr_slope(value, day) END AS slope,
         sum(step) AS auc, arg_max(day, (value, -day)) AS time_to_peak, arg_max(value, day) AS last_value
  FROM steps GROUP BY 1, 2),
feats AS (SELECT p.entity_id, p.channel, coalesce(count, 0) AS count, mean, median, std, min, max, slope, auc, time_to_peak, last_value
          FROM (SELECT DISTINCT entity_id, channel FROM series WHERE day BETWEEN -15 AND 2) AS p
          LEFT JOIN points USING (entity_id, channel))"""


@query("daily_series", "S3", "SELECT * FROM series", SERIES, "value")
def daily_series(t):
    return t.series


@query("window_filter", "P10", "SELECT * FROM series WHERE day BETWEEN -3 AND 2", SERIES, "value")
def window_filter(t):
    return S.in_window(t.days(-3, 2), -3, 2)


@query("window_features", "A11 A12 A13 A14 A16 A17 W3", WINDOW + " SELECT * FROM feats", SERIES,
       "mean median std min max slope auc last_value")
def window_features(t):
    return S.window_features(t.days(-15, 2), -15, 2)


@query("window_features_sample_deviation", "A12 A16", WINDOW + """
SELECT p.entity_id, p.channel, count(w.value) AS count, stddev_samp(w.value) AS std,
       CASE WHEN count(w.value) >= 2 THEN arg_max(w.day, (w.value, -w.day)) FILTER (WHERE w.value IS NOT NULL) END AS time_to_peak
FROM (SELECT DISTINCT entity_id, channel FROM series WHERE day BETWEEN -15 AND 2) AS p
LEFT JOIN w ON w.entity_id = p.entity_id AND w.channel = p.channel GROUP BY 1, 2""", SERIES, "std")
def window_features_sample_deviation(t):
    f = S.window_features(t.days(-15, 2), -15, 2, ddof=1, peak_min_points=2)
    return f.select("entity_id", "channel", "count", "std", "time_to_peak")


@query("strict_slope", "A13", """
SELECT entity_id, channel,
       CASE WHEN count(value) = count(*) AND count(*) >= 2 THEN regr_slope(value, day) END AS slope
FROM series WHERE day BETWEEN -5 AND 2 GROUP BY 1, 2""", SERIES, "slope")
def strict_slope(t):
    return S.strict_slope(t.days(-5, 2), -5, 2)


CARRIED = """
, pairs AS (SELECT DISTINCT entity_id, channel FROM series WHERE day BETWEEN -15 AND 2),
grid AS (SELECT entity_id, channel, CAST(g.day AS INTEGER) AS day
         FROM pairs, (SELECT unnest(generate_series(-15, 2)) AS day) AS g),
filled AS (SELECT g.entity_id, g.channel, g.day,
                  coalesce(last_value(s.value IGNORE NULLS) OVER (
                    PARTITION BY g.entity_id, g.channel ORDER BY g.day
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v
           FROM grid g LEFT JOIN series s USING (entity_id, channel, day))"""


@query("carried_auc", "A15 J9", CARRIED + """
SELECT entity_id, channel, sum(step) AS auc FROM (
  SELECT entity_id, channel, (v + lag(v) OVER (PARTITION BY entity_id, channel ORDER BY day)) / 2 AS step
  FROM filled) AS s GROUP BY 1, 2""", SERIES, "auc")
def carried_auc(t):
    return S.carried_auc(t.days(-15, 2), -15, 2)


@query("densified_series", "J9", CARRIED + """
SELECT g.entity_id, g.channel, g.day, s.value FROM grid g LEFT JOIN series s USING (entity_id, channel, day)""",
       SERIES, "value")
def densified_series(t):
    return S.densify(t.days(-15, 2), -15, 2)


@query("forward_fill", "W1", """
SELECT entity_id, day, channel, value,
       last_value(value IGNORE NULLS) OVER (PARTITION BY entity_id, channel ORDER BY day
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
FROM series WHERE day BETWEEN -15 AND 0""", SERIES, "value filled")
def forward_fill(t):
    return S.forward_fill(t.days(-15, 0), -15, 0)


@query("measurement_intensity", "A18 P11", """
SELECT entity_id, count(value) AS total_nonmiss, count(DISTINCT CASE WHEN value IS NOT NULL THEN day END) AS days_with_any
FROM series WHERE day BETWEEN -15 AND 2 GROUP BY 1 HAVING count(value) > 0""", SERIES)
def measurement_intensity(t):
    return drop_unmeasured(S.intensity(t.days(-15, 2), -15, 2))


@query("measurement_intensity_of_100_days", "A18", """
SELECT entity_id, count(value) AS total_nonmiss, count(DISTINCT CASE WHEN value IS NOT NULL THEN day END) AS days_with_any
FROM series WHERE day BETWEEN -50 AND 49 GROUP BY 1""", SERIES)
def measurement_intensity_of_100_days(t):
    wide = series_features(t.days(-50, 49), t.channels, ["count"], -50, 49).select("entity_id", "total_nonmiss", "days_with_any")
    return wide.join(S.intensity(t.days(-50, 49), -50, 49), ["entity_id", "total_nonmiss", "days_with_any"])


@query("baseline_last_observation", "J7a W1", """
SELECT * FROM (
  SELECT entity_id, 0 - max(day) AS baseline_gap_days,
         max(CASE WHEN channel = 'click' THEN v END) AS baseline_click,
         max(CASE WHEN channel = 'error' THEN v END) AS baseline_error,
         max(CASE WHEN channel = 'purchase' THEN v END) AS baseline_purchase,
         max(CASE WHEN channel = 'signup' THEN v END) AS baseline_signup,
         max(CASE WHEN channel = 'view' THEN v END) AS baseline_view
  FROM (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY entity_id, channel ORDER BY day
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v
        FROM series WHERE day BETWEEN -15 AND 0) AS x
  GROUP BY 1) AS y""", SERIES,
       "baseline_click baseline_error baseline_purchase baseline_signup baseline_view")
def baseline_last_observation(t):
    return S.baseline(t.days(-15, 0), t.channels, -15, 0)


@query("last_row_before_cutoff", "J7b", """
, wide AS (SELECT entity_id, day,
           max(CASE WHEN channel = 'click' THEN value END) AS click, max(CASE WHEN channel = 'error' THEN value END) AS error,
           max(CASE WHEN channel = 'purchase' THEN value END) AS purchase, max(CASE WHEN channel = 'signup' THEN value END) AS signup,
           max(CASE WHEN channel = 'view' THEN value END) AS view
           FROM series GROUP BY 1, 2)
SELECT entity_id, click AS baseline_click, error AS baseline_error, purchase AS baseline_purchase, signup AS baseline_signup,
       view AS baseline_view, 0 - day AS baseline_gap_days
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) AS r FROM wide WHERE day < 0) AS x
WHERE r = 1""", SERIES, "baseline_click baseline_error baseline_purchase baseline_signup baseline_view")
def last_row_before_cutoff(t):
    return S.last_row_before(S.to_wide(t.days(-36_500, -1), t.channels), 0)


TWO_WINDOWS = """
, tagged AS (SELECT *, CASE WHEN day BETWEEN -15 AND -1 THEN 'baseline' ELSE 'early_post' END AS "window"
             FROM series WHERE day BETWEEN -15 AND 7 AND value IS NOT NULL)
SELECT entity_id, channel, "window", count(*) AS count, avg(value) AS mean,
       coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max,
       CASE WHEN count(*) >= 2 THEN regr_slope(value, day) ELSE 0 END AS slope,
       arg_max(day, (value, -day)) AS time_to_peak
FROM tagged GROUP BY 1, 2, 3"""
TWO_COLUMNS = ["entity_id", "channel", "window", "count", "mean", "std", "min", "max", "slope", "time_to_peak"]


@query("two_window_features", "A19", TWO_WINDOWS, SERIES, "mean std min max slope")
def two_window_features(t):
    return S.multi_window_features(t.days(-15, 7), {"baseline": (-15, -1), "early_post": (0, 7)}).select(*TWO_COLUMNS)


@query("stored_two_window_features", "A19 P10", TWO_WINDOWS, SERIES, "mean std min max slope")
def stored_two_window_features(t):
    days = layout.stored_series(t.spark, t.stored, -15, 7)
    return S.multi_window_features(days, {"baseline": (-15, -1), "early_post": (0, 7)}, clustered=True).select(*TWO_COLUMNS)


def _wide_sql(stats, channels=("click", "error", "purchase", "signup", "view")) -> str:
    cols = [f"max(CASE WHEN channel = '{c}' THEN {s} END) AS {c}_{s}" for c in channels for s in stats]
    return ", ".join(cols)


FEATURE_STATS = ["count", "mean", "slope", "auc", "last_value"]
FEATURE_COLUMNS = [
    f"{c}_{s}" for c in ("click", "error", "purchase", "signup", "view") for s in FEATURE_STATS if s != "count"
]


FEATURE_SQL = WINDOW + f"""
, wide AS (SELECT entity_id, {_wide_sql(FEATURE_STATS)} FROM feats GROUP BY 1),
meter AS (SELECT entity_id, count(value) AS total_nonmiss,
                 count(DISTINCT CASE WHEN value IS NOT NULL THEN day END) AS days_with_any
          FROM series WHERE day BETWEEN -15 AND 2 GROUP BY 1)
SELECT s.entity_id, acctbal AS s_acctbal, segment AS s_segment, region AS s_region, nation AS s_nation,
       age AS s_age, crs AS s_crs, icans AS s_icans, sex AS s_sex,
       wide.* EXCLUDE (entity_id), total_nonmiss, days_with_any
FROM static s LEFT JOIN wide ON wide.entity_id = s.entity_id LEFT JOIN meter ON meter.entity_id = s.entity_id
"""


@query("feature_table", "J1 J7a P10 P16 A11 A13 A14 A17 A18", FEATURE_SQL, SERIES + "," + STATIC, ["s_acctbal", *FEATURE_COLUMNS])
def feature_table_query(t):
    return feature_table(t.static, t.days(-15, 2), t.channels, FEATURE_STATS, -15, 2)


@query("stored_feature_table", "J1 P10 A11 A13 A14 A17 A18", FEATURE_SQL, SERIES + "," + STATIC, ["s_acctbal", *FEATURE_COLUMNS])
def stored_feature_table(t):
    """The same table from the stored layout, both sides in the buckets of the series."""
    static = t.spark.table(layout.store_by_entity(t.static, t.stored))
    series = layout.stored_series(t.spark, t.stored, -15, 2)
    return feature_table(static, series, t.channels, FEATURE_STATS, -15, 2, clustered=True)


@query("stored_window_features", "P10 A11 A12 A13 A14 A16 A17", WINDOW + " SELECT * FROM feats", SERIES,
       "mean median std min max slope auc last_value")
def stored_window_features(t):
    return S.window_features(layout.stored_series(t.spark, t.stored, -15, 2), -15, 2, clustered=True)


@query("stored_carried_auc", "P10 A15", CARRIED + """
SELECT entity_id, channel, sum(step) AS auc FROM (
  SELECT entity_id, channel, (v + lag(v) OVER (PARTITION BY entity_id, channel ORDER BY day)) / 2 AS step
  FROM filled) AS s GROUP BY 1, 2""", SERIES, "auc")
def stored_carried_auc(t):
    return S.carried_auc(layout.stored_series(t.spark, t.stored, -15, 2), -15, 2)


TWO_MEANS = [f"""avg(CASE WHEN channel = '{c}' AND "window" = '{w}' THEN value END) AS {c}_{w}_mean"""
             for c in ("click", "error", "purchase", "signup", "view") for w in ("baseline", "early_post")]


@query("two_window_pivot", "A19 J2", """
, tagged AS (SELECT *, CASE WHEN day BETWEEN -15 AND -1 THEN 'baseline' ELSE 'early_post' END AS "window"
             FROM series WHERE day BETWEEN -15 AND 7 AND value IS NOT NULL)
SELECT s.entity_id, s.segment, p.* EXCLUDE (entity_id) FROM static s JOIN (
  SELECT entity_id, """ + ", ".join(TWO_MEANS) + """
  FROM tagged GROUP BY 1) AS p ON p.entity_id = s.entity_id""", SERIES + "," + STATIC,
       [m.split(" AS ")[1] for m in TWO_MEANS])
def two_window_pivot(t):
    names = {"baseline": (-15, -1), "early_post": (0, 7)}
    f = S.multi_window_features(t.days(-15, 7), names)
    wide = S.pivot_features(f, t.channels, ["mean"], "window", list(names))
    return t.static.select("entity_id", "segment").join(wide, "entity_id")


@query("availability", "A10 J9", """
, names AS (SELECT * FROM (VALUES ('usage', 'click'), ('usage', 'view'), ('trade', 'purchase'), ('trade', 'signup'),
                                  ('fault', 'error'), ('absent', 'none')) AS v(grp, channel)),
cells AS (SELECT g.grp, d.day FROM (SELECT DISTINCT grp FROM names) AS g,
                (SELECT CAST(unnest(generate_series(-15, 14)) AS INTEGER) AS day) AS d),
seen AS (SELECT grp, day, count(DISTINCT entity_id) AS n FROM series JOIN names USING (channel)
         WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT c.grp AS "group", c.day, coalesce(n, 0) / CAST(500 AS DOUBLE) AS fraction,
       CAST(trunc((1 - coalesce(n, 0) / CAST(500 AS DOUBLE)) * 100) AS INTEGER) AS missing_pct
FROM cells c LEFT JOIN seen s ON s.grp = c.grp AND s.day = c.day""", SERIES, "fraction")
def availability(t):
    groups = {"usage": ["click", "view"], "trade": ["purchase", "signup"], "fault": ["error"], "absent": ["none"]}
    return profile.availability(t.days(LO, HI), groups, LO, HI, 500)


@query("channel_missing", "A7", """
SELECT channel, count(value) AS n_filled, n_rows, n_rows - count(value) AS missing_count,
       (n_rows - count(value)) * CAST(100 AS DOUBLE) / n_rows AS missing_pct
FROM series, (SELECT count(*) AS n_rows FROM (SELECT DISTINCT entity_id, day FROM series) AS d) AS r
GROUP BY channel, n_rows""", SERIES, "missing_pct")
def channel_missing(t):
    return profile.channel_missing(t.series)


@query("variable_monitor", "V11", """
, vars AS (SELECT * FROM (VALUES ('click'), ('error'), ('none')) AS v(variable)),
ids AS (SELECT c_custkey AS entity_id FROM customer),
span AS (SELECT entity_id, min(CASE WHEN day BETWEEN -15 AND -14 THEN day END) AS first_day,
                max(CASE WHEN day BETWEEN -15 AND -14 THEN day END) AS last_day FROM series GROUP BY 1),
has AS (SELECT DISTINCT entity_id, channel AS variable FROM series
        WHERE day BETWEEN -15 AND -14 AND value IS NOT NULL)
SELECT i.entity_id, v.variable, h.variable IS NOT NULL AS has_data,
       CASE WHEN h.variable IS NOT NULL THEN NULL WHEN s.entity_id IS NULL THEN 'patient_file_not_found'
            WHEN s.first_day IS NULL THEN 'no_data_in_time_window' ELSE 'value_is_nan' END AS reason,
       s.first_day, s.last_day
FROM ids i CROSS JOIN vars v LEFT JOIN span s ON s.entity_id = i.entity_id
LEFT JOIN has h ON h.entity_id = i.entity_id AND h.variable = v.variable""", SERIES)
def variable_monitor(t):
    ids = t.customer.select(F.col("c_custkey").alias("entity_id"))
    return quality.monitor_variables(ids, t.series, ["click", "error", "none"], -15, -14)


@query("variable_monitor_summary", "V11", """
, has AS (SELECT v.variable, e.entity_id,
                 max(CASE WHEN s.channel = v.variable AND s.value IS NOT NULL THEN 1 ELSE 0 END) AS hit
          FROM (SELECT DISTINCT channel AS variable FROM series) AS v
          CROSS JOIN (SELECT DISTINCT entity_id FROM series) AS e
          LEFT JOIN series s ON s.entity_id = e.entity_id AND s.day BETWEEN -15 AND 0 GROUP BY 1, 2)
SELECT variable, count(*) AS n_entities, count(*) FILTER (WHERE hit = 0) AS n_empty, CAST(0 AS BIGINT) AS n_no_file,
       count(*) FILTER (WHERE hit = 0 AND NOT seen) AS n_no_window, count(*) FILTER (WHERE hit = 0 AND seen) AS n_nan
FROM has JOIN (SELECT entity_id, bool_or(day BETWEEN -15 AND 0) AS seen FROM series GROUP BY 1) AS w USING (entity_id) GROUP BY 1""", SERIES)
def variable_monitor_summary(t):
    found = quality.monitor_variables(t.series.select("entity_id").distinct(), t.series, t.channels, -15, 0)
    return quality.monitor_summary(found)


@query("day_grid_check", "V4", """
, days AS (SELECT entity_id, count(DISTINCT day) AS n_days, min(day) AS lo FROM series GROUP BY 1)
SELECT entity_id, n_days AS n_rows, n_days, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_misplaced,
       (SELECT min(g.d) FROM (SELECT CAST(unnest(generate_series(-15, 14)) AS INTEGER) AS d) AS g
        WHERE g.d NOT IN (SELECT day FROM series s WHERE s.entity_id = days.entity_id)) AS first_gap
FROM days WHERE n_days <> 30""", SERIES)
def day_grid_check(t):
    return quality.check_day_grid(t.series.select("entity_id", "day").distinct(), LO, HI)


@query("day_order_check", "V4", """
, lines AS (SELECT user_id AS entity_id, CAST(date_diff('day', DATE '2024-01-16', CAST(ts AS DATE)) AS INTEGER) AS day, max(event_id) AS line
            FROM events GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY line) - 1 AS position FROM lines)
SELECT entity_id, count(*) AS n_rows, count(*) FILTER (WHERE day BETWEEN -15 AND 14) AS n_days,
       count(*) FILTER (WHERE day NOT BETWEEN -15 AND 14) AS n_outside, count(*) FILTER (WHERE day <> position - 15) AS n_misplaced,
       (SELECT min(g.d) FROM (SELECT CAST(unnest(generate_series(-15, 14)) AS INTEGER) AS d) AS g
        WHERE g.d NOT IN (SELECT l.day FROM lines l WHERE l.entity_id = placed.entity_id)) AS first_gap
FROM placed GROUP BY 1
HAVING count(*) <> 30 OR count(*) FILTER (WHERE day BETWEEN -15 AND 14) <> 30 OR count(*) FILTER (WHERE day <> position - 15) > 0""",
       "none AS (SELECT 1)")
def day_order_check(t):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-16").cast("date")).alias("day")
    lines = t.events.groupBy(F.col("user_id").alias("entity_id"), day).agg(F.max("event_id").alias("line"))
    return quality.check_day_grid(quality.with_position(lines, "entity_id", "line"), LO, HI, position="position")


@query("partwise_features", "J5", """
SELECT s.entity_id, s.segment, max(x.day) AS last_day, count(x.day) = 0 AS no_series
FROM static s LEFT JOIN series x ON x.entity_id = s.entity_id GROUP BY 1, 2""", SERIES + "," + STATIC)
def partwise_features(t):
    last = t.series.groupBy("entity_id").agg(F.max("day").alias("last_day"))
    joined = left_features(t.static.select("entity_id", "segment"), last)
    return joined.withColumn("no_series", F.col("last_day").isNull())
