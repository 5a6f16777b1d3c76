"""Queries for the evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.operators import evaluate as E
from daygrid.operators import profile
from daygrid.plans.bindings import SCORES
from daygrid.plans.registry import query
from daygrid.sources.writers import write_predictions
from daygrid.session import fresh_path

CELLS = """
, cells AS (SELECT {k}, count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score < 0.5 AND y = 0) AS tn,
                   count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn,
                   avg(pow(score - y, 2)) AS brier, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg
            FROM scores GROUP BY {k})"""
RATIOS = """tp, tn, fp, fn, coalesce((tp + tn) / CAST(nullif(tp + tn + fp + fn, 0) AS DOUBLE), 0) AS accuracy,
  coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS sensitivity, coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0) AS specificity,
  coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS "precision", coalesce(tn / CAST(nullif(tn + fn, 0) AS DOUBLE), 0) AS npv,
  coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1,
  sqrt(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) * coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0)) AS g_mean"""
CURVE = """
, tally AS (SELECT {k}, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scores GROUP BY {k}, score),
curve AS (SELECT *, CAST(sum(pos) OVER o AS DOUBLE) AS cp, CAST(sum(neg) OVER o AS DOUBLE) AS cn,
                 CAST(sum(pos) OVER a AS DOUBLE) AS p, CAST(sum(neg) OVER a AS DOUBLE) AS n
          FROM tally WINDOW o AS (PARTITION BY {k} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                            a AS (PARTITION BY {k}))"""
AREAS = """
, areas AS (SELECT {k}, sum(neg * (cp - pos / CAST(2 AS DOUBLE))) / nullif(max(p) * max(n), 0) AS auc,
                   sum(pos * (cp / (cp + cn) + CASE WHEN cp - pos + cn - neg = 0 THEN 1 ELSE (cp - pos) / (cp - pos + cn - neg) END) / 2) / nullif(max(p), 0) AS pr_auc,
                   sum(pos * cp / (cp + cn)) / nullif(max(p), 0) AS average_precision
            FROM curve GROUP BY {k})"""


def sql(*parts: str, k: str = "model, split") -> str:
    return "".join(p.replace("{k}", k) for p in parts)


METRICS = "accuracy sensitivity specificity precision npv f1 g_mean"


@query("confusion_metrics", "E1 E2", sql(CELLS, f"SELECT model, split, {RATIOS} FROM cells"), SCORES, METRICS)
def confusion_metrics(t):
    return E.confusion(t.scores, ["model", "split"])


@query("roc_points", "E3", sql(CURVE, """
SELECT model, split, score AS threshold, cn / n AS fpr, cp / p AS tpr FROM curve
UNION ALL SELECT DISTINCT model, split, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM scores"""),
       SCORES, "threshold fpr tpr")
def roc_points(t):
    return E.roc_points(t.scores, ["model", "split"])


@query("roc_auc", "E3", """
SELECT a.model, a.split, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc
FROM scores a JOIN scores b ON a.model = b.model AND a.split = b.split AND a.y = 1 AND b.y = 0 GROUP BY 1, 2""", SCORES, "auc")
def roc_auc(t):
    return E.auc(t.scores, ["model", "split"])


@query("pr_points", "E4", sql(CURVE, """
SELECT model, split, score AS threshold, cp / (cp + cn) AS "precision", cp / p AS recall FROM curve"""),
       SCORES, "threshold precision recall")
def pr_points(t):
    return E.pr_points(t.scores, ["model", "split"])


@query("pr_areas", "E4", sql(CURVE, AREAS, "SELECT model, split, pr_auc, average_precision FROM areas"),
       SCORES, "pr_auc average_precision")
def pr_areas(t):
    return E.summary(t.scores, ["model", "split"]).select("model", "split", "pr_auc", "average_precision")


@query("brier_score", "E5", "SELECT model, split, avg(pow(score - y, 2)) AS brier FROM scores GROUP BY 1, 2", SCORES, "brier")
def brier_score(t):
    return E.brier(t.scores, ["model", "split"])


CALIBRATION = """
, bins AS (SELECT model, split, CAST(greatest(1, least(10, ceil(score * 10))) AS INTEGER) AS bin, count(*) AS n,
                  avg(y) AS prob_true, avg(score) AS prob_pred FROM scores GROUP BY 1, 2, 3)"""


@query("calibration_bins", "E6", CALIBRATION + "SELECT * FROM bins", SCORES, "prob_true prob_pred")
def calibration_bins(t):
    return E.calibration(t.scores, ["model", "split"])


@query("calibration_error", "E6", CALIBRATION + """
SELECT model, split, avg(abs(prob_true - prob_pred)) AS calibration_error FROM bins GROUP BY 1, 2""", SCORES, "calibration_error")
def calibration_error(t):
    return E.calibration_error(t.scores, ["model", "split"])


@query("decision_curve", "E7 J10", """
, g AS (SELECT CAST(0.01 AS DOUBLE) + i * ((CAST(0.99 AS DOUBLE) - CAST(0.01 AS DOUBLE)) / 99) AS t
        FROM (SELECT unnest(generate_series(0, 99)) AS i) AS s),
n AS (SELECT model, split, count(*) AS n, CAST(sum(y) AS DOUBLE) AS p FROM scores GROUP BY 1, 2)
SELECT s.model, s.split, g.t AS threshold,
       count(*) FILTER (WHERE score > t AND y = 1) / CAST(n.n AS DOUBLE)
         - count(*) FILTER (WHERE score > t AND y = 0) / CAST(n.n AS DOUBLE) * (t / (1 - t)) AS net_benefit,
       n.p / n.n - (n.n - n.p) / n.n * (t / (1 - t)) AS treat_all
FROM scores s JOIN n ON n.model = s.model AND n.split = s.split CROSS JOIN g GROUP BY s.model, s.split, g.t, n.n, n.p""",
       SCORES, "threshold net_benefit treat_all")
def decision_curve(t):
    return E.decision_curve(t.scores, ["model", "split"])


@query("mean_roc", "E8 J11", sql(CURVE, """
, pts AS (SELECT model, fold, cn / n AS fpr, cp / p AS tpr FROM curve UNION ALL SELECT DISTINCT model, fold, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM scores),
g AS (SELECT CAST(i AS INTEGER) AS point, i * (CAST(1 AS DOUBLE) / 99) AS x FROM (SELECT unnest(generate_series(0, 99)) AS i) AS s),
l AS (SELECT model, fold, point, x, max((fpr, tpr)) AS a FROM pts JOIN g ON fpr <= x GROUP BY 1, 2, 3, 4),
r AS (SELECT model, fold, point, min((fpr, tpr)) AS b FROM pts JOIN g ON fpr > x GROUP BY 1, 2, 3),
e AS (SELECT model, fold, point, x, CASE WHEN point = 0 THEN 0 WHEN b IS NULL THEN a[2]
        ELSE a[2] + (x - a[1]) * (b[2] - a[2]) / (b[1] - a[1]) END AS tpr FROM l LEFT JOIN r USING (model, fold, point)),
m AS (SELECT model, point, x AS fpr, CASE WHEN point = 99 THEN 1 ELSE avg(tpr) END AS mean_tpr, stddev_pop(tpr) AS std_tpr FROM e GROUP BY 1, 2, 3)
SELECT *, greatest(mean_tpr - std_tpr, 0) AS lower, least(mean_tpr + std_tpr, 1) AS upper FROM m""", k="model, fold"),
       SCORES, "fpr mean_tpr std_tpr lower upper")
def mean_roc(t):
    return E.mean_roc(t.scores, ["model"])


@query("subgroup_auc", "E9", sql(CURVE, AREAS, "SELECT model, lang, auc FROM areas", k="model, lang"), SCORES, "auc")
def subgroup_auc(t):
    return E.subgroup_auc(t.scores, ["model"], "lang")


@query("train_test_gap", "E10 J8", sql(CURVE, AREAS, """
SELECT a.model, a.auc AS train_auc, b.auc AS test_auc, a.auc - b.auc AS gap
FROM areas a JOIN areas b ON a.model = b.model AND a.split = 'train' AND b.split = 'test'"""), SCORES, "train_auc test_auc gap")
def train_test_gap(t):
    return E.split_gap(E.auc(t.scores, ["model", "split"]))


@query("fold_metrics", "E11 E1 E2 E3 E4 E5", sql(CURVE, AREAS, CELLS, f"""
SELECT c.model, c.fold, n_pos, n_neg, brier, auc, pr_auc, average_precision, {RATIOS}
FROM cells c JOIN areas a ON a.model = c.model AND a.fold = c.fold""", k="model, fold"),
       SCORES, f"brier auc pr_auc average_precision {METRICS}")
def fold_metrics(t):
    return E.summary(t.scores, ["model", "fold"])


@query("fold_summary", "A24", sql(CURVE, AREAS, CELLS, """
SELECT c.model, avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc, avg(brier) AS mean_brier, stddev_pop(brier) AS std_brier
FROM cells c JOIN areas a ON a.model = c.model AND a.fold = c.fold GROUP BY 1""", k="model, fold"),
       SCORES, "mean_auc std_auc mean_brier std_brier")
def fold_summary(t):
    return profile.fold_summary(E.summary(t.scores, ["model", "fold"]), ["model"], ["auc", "brier"])


@query("best_models", "K3", sql(CURVE, AREAS, """
SELECT model, auc FROM areas WHERE split = 'test' ORDER BY auc DESC, model LIMIT 2"""), SCORES, "auc")
def best_models(t):
    return E.best_models(E.auc(t.scores.where("split = 'test'"), ["model"]), "auc", 2)


@query("predictions", "S9", """
SELECT id, y AS label, score AS probability, CAST(score >= 0.5 AS INTEGER) AS prediction FROM scores""",
       SCORES, "probability")
def predictions(t):
    path = fresh_path(t.spark, "predictions")
    write_predictions(t.scores, path, "id", fmt="parquet")
    return t.spark.read.parquet(path)


STEPS = " + ".join(f"(u > {s!r}::DOUBLE)::INT" for s in E.poisson_steps())
BOOT = f"""
, drawn AS (SELECT b, score, y, {STEPS} AS w
            FROM (SELECT b, score, y, CAST(('0x' || substr(md5(concat('42-', id, '-', b)), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496 AS u
                  FROM scores, (SELECT unnest(generate_series(1, 1000)) AS b) AS r WHERE model = 'size') AS x),
"""


@query("bootstrap_brier", "T12", BOOT + """
v AS (SELECT b, sum(w * pow(score - y, 2)) / sum(w) AS value FROM drawn GROUP BY 1)
SELECT avg(value) AS mean, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper, count(value) AS n_replicates FROM v""",
       SCORES, "mean lower upper")
def bootstrap_brier(t):
    return E.bootstrap_ci(t.size_scores, "id", "brier")


@query("bootstrap_auc", "T12", BOOT + """
t AS (SELECT b, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS neg FROM drawn GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY b ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp FROM t),
v AS (SELECT b, sum(neg * (cp - pos / CAST(2 AS DOUBLE))) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS value FROM c GROUP BY 1)
SELECT avg(value) AS mean, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper, count(value) AS n_replicates FROM v""",
       SCORES, "mean lower upper")
def bootstrap_auc(t):
    return E.bootstrap_ci(t.size_scores, "id", "auc")


@query("thresholded_counts", "J10", """
, g AS (SELECT unnest(generate_series(1, 9)) / CAST(10 AS DOUBLE) AS t)
SELECT model, t AS threshold, count(*) FILTER (WHERE score > t) AS n_above FROM scores CROSS JOIN g GROUP BY 1, 2""", SCORES, "threshold")
def thresholded_counts(t):
    cuts = [i / 10 for i in range(1, 10)]
    counted = E.cut_counts(t.scores, ["model"], cuts)
    return counted.select("model", "threshold", (F.col("pos_above") + F.col("neg_above")).alias("n_above"))


@query("calibration_with_gaps", "E6", """
, g AS (SELECT model, y, CASE WHEN id % 7 = 0 THEN NULL ELSE score END AS score FROM scores)
SELECT model, CAST(greatest(1, least(10, ceil(score * 10))) AS INTEGER) AS bin, count(*) AS n, avg(y) AS prob_true, avg(score) AS prob_pred
FROM g WHERE score IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2""", SCORES, "prob_true prob_pred")
def calibration_with_gaps(t):
    return E.calibration(t.scores.withColumn("score", F.when(F.col("id") % 7 != 0, F.col("score"))), ["model"])
