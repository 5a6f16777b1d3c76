"""Queries that train on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.operators import evaluate, prep, splits, training
from daygrid.plans.bindings import FOLDS, SERIES, STATIC
from daygrid.plans.feature_table import feature_table
from daygrid.plans.model_table import model_table
from daygrid.plans.registry import query
from daygrid.session import durable, spread

FEATURES = ["size", "blank_share", "line_count", "phase"]


def model_rows(t):
    """Labelled documents with scaled numeric features and folds."""
    text = F.col("text")
    docs = t.documents.select(
        F.col("doc_id").alias("id"), F.log1p(F.col("n_chars").cast("double")).alias("size"),
        ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / F.greatest(F.length(text), F.lit(1))).alias("blank_share"),
        F.log1p((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("double")).alias("line_count"),
        ((F.length(text) % 97) / 97.0).alias("phase"),
    )
    rows = t.folds.join(docs, "id").withColumnRenamed("y", "label")
    scaled = prep.scale(rows, prep.learn_scaling(rows.where("split = 'train'"), FEATURES))
    # every fit reads the rows many times: in one file, whatever its length, one task would
    return training.assemble(durable(spread(scaled, "id"), "model_rows"), FEATURES)


MODELS = ("logistic_regression", "random_forest", "decision_tree", "gradient_boosting", "naive_bayes", "linear_svm",
          "multilayer_perceptron")


@query("classifier_scores", "M9 M11 E1")
def classifier_scores(t):
    """Every kind of classifier, weighted where it can be, judged on the test rows."""
    rows = model_rows(t)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    fits = [training.classifier(name, n_features=len(FEATURES)) for name in MODELS]
    models = training.fit_all(train, fits, weighted=True)
    parts = [training.positive_score(m, test).select(F.lit(name).alias("model"), "id", F.col("label").alias("y"), "score")
             for name, m in zip(MODELS, models, strict=True)]
    return evaluate.summary(durable(reduce(DataFrame.unionByName, parts), "scores"), ["model"])


LONG_FEATURES = """
, x AS (SELECT id, fold, split, y, unnest(['size', 'blank_share', 'line_count', 'phase']) AS f,
               unnest([ln(1 + n_chars::DOUBLE), (length(text) - length(replace(text, ' ', ''))) / greatest(length(text), 1)::DOUBLE,
                       ln(1 + (length(text) - length(replace(text, chr(10), '')))::DOUBLE), (length(text) % 97) / 97::DOUBLE]) AS v
        FROM folds JOIN documents ON id = doc_id)"""
# with class weights the priors are equal, so the odds are those of the densities
POSTERIOR = """
, l AS (SELECT x.id, s.y, sum(-0.5 * ln(s.q) - (x.v - s.m) * (x.v - s.m) / (2 * s.q)) AS ll
        FROM x JOIN s ON s.f = x.f AND {held} GROUP BY 1, 2),
p AS (SELECT id, 1 / (1 + exp(least(700, max(CASE WHEN y = 0 THEN ll END) - max(CASE WHEN y = 1 THEN ll END)))) AS score FROM l GROUP BY 1)"""


@query("naive_bayes_scores", "M9 M11", LONG_FEATURES + """
, s AS (SELECT f, y, avg(v) AS m, var_pop(v) AS q FROM x WHERE split = 'train' GROUP BY 1, 2)""" + POSTERIOR.format(held="x.split = 'test'")
       + " SELECT p.id, folds.y, score FROM p JOIN folds ON folds.id = p.id", FOLDS, "score")
def naive_bayes_scores(t):
    rows = model_rows(t)
    model, = training.fit_all(rows.where("split = 'train'"), [training.classifier("naive_bayes")], weighted=True)
    return training.positive_score(model, rows.where("split = 'test'")).select("id", F.col("label").alias("y"), "score")


@query("out_of_fold_naive_bayes", "M12 M11 M9", LONG_FEATURES + """
, s AS (SELECT k, f, y, avg(v) AS m, var_pop(v) AS q FROM x, range(1, 6) AS r(k) WHERE fold <> k GROUP BY 1, 2, 3)"""
       + POSTERIOR.format(held="x.fold = s.k") + " SELECT p.id, folds.fold, folds.y, score FROM p JOIN folds ON folds.id = p.id", FOLDS, "score")
def out_of_fold_naive_bayes(t):
    return training.out_of_fold(model_rows(t), training.classifier("naive_bayes"), keep=["id"], weighted=True)


@query("out_of_fold_scores", "M12 M11", "SELECT id, fold, y, true AS scored FROM folds JOIN documents ON id = doc_id", FOLDS)
def out_of_fold_scores(t):
    """Every labelled document is scored once, in its own fold."""
    rows = model_rows(t)
    estimator = training.classifier("logistic_regression")
    held = training.out_of_fold(rows, estimator, keep=["id"], weighted=True)
    return held.select("id", "fold", "y", F.col("score").between(0, 1).alias("scored"))


@query("out_of_fold_metrics", "M12 M11 E11")
def out_of_fold_metrics(t):
    estimator = training.classifier("logistic_regression")
    held = training.out_of_fold(model_rows(t), estimator, keep=["id"], weighted=True)
    return evaluate.summary(durable(held, "held_out"), ["fold"])


@query("grid_search", "M10 K3")
def grid_search(t):
    """Strength and kind of the penalty of a weighted logistic regression: metrics per setting and fold."""
    grid = {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}
    return training.grid_search(model_rows(t), LogisticRegression(), grid, weighted=True)[2]


@query("grid_search_forest", "M10 M11 K3")
def grid_search_forest(t):
    """Depth and number of trees of a weighted forest: metrics per setting and fold."""
    forest = training.classifier("random_forest")
    return training.grid_search(model_rows(t), forest, {"maxDepth": [3, 5], "numTrees": [10, 20]}, weighted=True)[2]


@query("grid_search_one_feature", "M10 M11 K3", """
, x AS (SELECT fold, y, n_chars AS v FROM folds JOIN documents ON id = doc_id),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY v) + (count(*) OVER (PARTITION BY fold, v) - 1) / 2::DOUBLE AS place FROM x),
a AS (SELECT fold, sum(y) AS n1, count(*) - sum(y) AS n0, (sum(place) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2::DOUBLE)
             / (sum(y) * (count(*) - sum(y)))::DOUBLE AS area FROM r GROUP BY fold),
c AS (SELECT k AS fold, covar_pop(ln(1 + v::DOUBLE), y) AS c FROM x, range(1, 6) AS g(k) WHERE fold <> k GROUP BY k),
m AS (SELECT a.fold, CASE WHEN c.c > 0 THEN area ELSE 1 - area END AS auc FROM a JOIN c ON c.fold = a.fold)
SELECT setting::INTEGER AS setting, avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc, count(*) AS n_folds FROM m, range(0, 6) AS z(setting) GROUP BY 1""",
       FOLDS, "mean_auc std_auc")
def grid_search_one_feature(t):
    """A logistic regression on one feature orders rows as the feature does, whatever the penalty."""
    rows = training.assemble(model_rows(t).drop("features"), ["size"])
    grid = {"regParam": [0.001, 0.01, 0.1], "standardization": [True, False]}
    return training.grid_search(rows, LogisticRegression(), grid, weighted=True)[1].drop("params")


@query("feature_importance", "M13 K2")
def feature_importance(t):
    rows = model_rows(t)
    model = training.classifier("random_forest").fit(rows.where("split = 'train'"))
    return training.feature_importance(model, FEATURES, t.spark)


@query("linear_contributions", "M14", """
, m AS (SELECT avg(acctbal) AS a, avg(age) AS g FROM static)
SELECT 'acctbal' AS feature, avg(abs(CAST(0.002 AS DOUBLE) * (acctbal - a))) AS contribution FROM static, m
UNION ALL SELECT 'age', avg(abs(CAST(-0.3 AS DOUBLE) * (age - g))) FROM static, m""", STATIC, "contribution")
def linear_contributions(t):
    return training.linear_contributions(t.static, {"acctbal": 0.002, "age": -0.3})


PATH = [10 ** (-4 + 3 * i / 19) for i in range(20)]


def picked(table, picks):
    return table.withColumns({n: F.col("lambda") == picks[n] for n in ("lambda_min", "lambda_1se")})


@query("l1_path", "M15")
def l1_path(t):
    return picked(*training.l1_path(model_rows(t), PATH))


@query("l1_path_one_feature", "M15", """
, x AS (SELECT fold, y::DOUBLE AS y, ln(1 + n_chars::DOUBLE) AS x FROM folds JOIN documents ON id = doc_id),
g AS (SELECT pow(10, -4 + 3 * i / 19::DOUBLE) AS l FROM range(0, 20) AS r(i)),
s AS (SELECT k, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v, stddev_pop(x) AS sd
      FROM x, range(0, 6) AS r(k) WHERE fold <> k GROUP BY k),
b AS (SELECT k, l, mx, my, sign(c) * greatest(abs(c) - l * sd, 0) / v AS b FROM s, g),
e AS (SELECT k, l, avg(pow(y - my - b * (x - mx), 2)) AS mse FROM b JOIN x ON x.fold = b.k GROUP BY 1, 2),
m AS (SELECT l, avg(mse) AS mean_mse, stddev_pop(mse) AS std_mse FROM e GROUP BY 1),
o AS (SELECT min(mean_mse) AS low, arg_min(std_mse, (mean_mse, -l)) AS sd, arg_min(l, (mean_mse, -l)) AS at FROM m)
SELECT m.l AS "lambda", mean_mse, std_mse, CAST(b.b <> 0 AS INTEGER) AS df, m.l = o.at AS lambda_min,
       m.l = (SELECT max(l) FROM m, o WHERE mean_mse <= low + sd) AS lambda_1se
FROM m JOIN b ON b.l = m.l AND b.k = 0, o""", FOLDS, "lambda mean_mse std_mse")
def l1_path_one_feature(t):
    rows = training.assemble(model_rows(t).drop("features"), ["size"])
    return picked(*training.l1_path(rows, PATH))


@query("model_table", "J1 J7a P5 P9 F7 W5 W6", """
, base AS (SELECT * FROM static WHERE age IS NOT NULL AND crs IS NOT NULL),
lab AS (SELECT entity_id, segment, CASE WHEN crs > 2 THEN 1 ELSE 0 END AS crs FROM base),
last AS (SELECT entity_id, max(v) AS baseline_click FROM (
  SELECT entity_id, last_value(value IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY day
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v
  FROM series WHERE day BETWEEN -15 AND 0 AND channel = 'click') AS x GROUP BY 1),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY crs ORDER BY md5(concat('42-', entity_id)))
                        <= round(count(*) OVER (PARTITION BY crs) * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM lab),
f AS (SELECT entity_id, CAST(ntile(5) OVER (PARTITION BY crs ORDER BY md5(concat('42-', entity_id))) AS INTEGER) AS fold FROM sp WHERE split = 'train')
SELECT sp.entity_id, segment, crs, baseline_click, split, fold
FROM sp LEFT JOIN f ON f.entity_id = sp.entity_id LEFT JOIN last ON last.entity_id = sp.entity_id""",
       SERIES + "," + STATIC, "baseline_click")
def model_table_query(t):
    out = model_table(t.static, t.days(-15, 0), t.channels, "crs", ["age"], max_missing_pct=None)
    return out.select("entity_id", "segment", "crs", "baseline_click", "split", "fold")


def window_rows(t):
    """Window features of the series beside the static table, a label and entity folds: the
    rows of a cross-validated model."""
    table = feature_table(t.static, t.days(-15, 2), t.channels, ["count", "mean", "slope"], -15, 2)
    features = [c for c in table.columns if c.rsplit("_", 1)[-1] in ("count", "mean", "slope")]
    known = table.where(F.col("s_crs").isNotNull()).withColumn("label", (F.col("s_crs") >= 3).cast("double"))
    filled = prep.impute(known, {c: 0.0 for c in features})
    folded = splits.stratified_folds(durable(filled, "window_rows"), "entity_id", "label", 5, 42)
    return training.assemble(folded, features).select("entity_id", "label", "fold", "features")


@query("window_model_folds", "M12 M11 E11 F9 W8", """
, lab AS (SELECT entity_id, CASE WHEN crs >= 3 THEN 1 ELSE 0 END AS label FROM static WHERE crs IS NOT NULL),
f AS (SELECT *, CAST(ntile(5) OVER (PARTITION BY label ORDER BY md5(concat('42-', entity_id))) AS INTEGER) AS fold FROM lab)
SELECT fold, sum(label) AS n_pos, count(*) - sum(label) AS n_neg, count(*) AS n_scored FROM f GROUP BY 1
UNION ALL SELECT 0, sum(label), count(*) - sum(label), count(*) FROM f""", SERIES + "," + STATIC)
def window_model_folds(t):
    """Out-of-fold scores of a weighted tree model on window features: the class counts and
    the number of scored rows per fold and (fold 0) overall; a refit on all rows scores too."""
    rows = window_rows(t)
    forest = training.classifier("random_forest", maxDepth=4)
    held = durable(training.out_of_fold(rows, forest, keep=["entity_id"], weighted=True), "held_out")
    everything = held.unionByName(held.withColumn("fold", F.lit(0)))
    counts = evaluate.summary(everything, ["fold"]).select("fold", "n_pos", "n_neg")
    scored = everything.where(F.col("score").between(0, 1)).groupBy("fold").agg(F.count("score").alias("n_scored"))
    weighted = training.with_class_weight(rows)
    refit = training.positive_score(forest.copy().setWeightCol("weight").fit(weighted), rows)
    refitted = refit.where(F.col("score").between(0, 1)).count()
    return counts.join(scored, "fold").where((F.col("fold") > 0) | (F.col("n_scored") == refitted))


@query("window_model_metrics", "M12 E11")
def window_model_metrics(t):
    held = training.out_of_fold(window_rows(t), training.classifier("random_forest", maxDepth=4), keep=["entity_id"], weighted=True)
    stored = durable(held, "held_out")
    return evaluate.summary(stored.unionByName(stored.withColumn("fold", F.lit(0))), ["fold"])
