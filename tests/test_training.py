"""Gram-matrix lasso against MLlib, concurrent searches, class weights."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from daygrid.operators import training

LAMBDAS = [0.5, 0.2, 0.05, 0.01, 0.001]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.normal(size=(400, 6)) * [1, 5, 0.1, 1, 1, 0] + [0, 100, 0, 3, 0, 4]
    x[:, 3] += x[:, 0]  # correlated; the last one is constant
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=400)
    data = [(int(i % 5) + 1, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, ["fold", "features", "label"]).withColumn("fold", F.col("fold").cast("int")).repartition(7)


def test_sums_are_those_of_one_scan(rows):
    sums = training.gram_sums(rows)
    assert sorted(sums) == [1, 2, 3, 4, 5]
    held = [(r["fold"], np.array([1.0, *r["features"], r["label"]])) for r in rows.collect()]
    for i, m in sums.items():
        z = np.array([v for f, v in held if f == i])
        assert np.allclose(m, z.T @ z, rtol=1e-12, atol=1e-9)
    dirty = rows.unionByName(rows.limit(3).withColumn("label", F.lit(None).cast("double"))).unionByName(rows.limit(3).withColumn("fold", F.lit(None).cast("int")))
    assert all(np.allclose(m, sums[i], rtol=1e-12) for i, m in training.gram_sums(dirty).items())


def test_path_agrees_with_mllib(rows):
    whole = sum(training.gram_sums(rows).values())
    for value, (intercept, beta) in zip(LAMBDAS, training.lasso_from_sums(whole, LAMBDAS), strict=True):
        model = LinearRegression(elasticNetParam=1.0, regParam=value, maxIter=500, tol=1e-12).fit(rows)
        assert np.allclose(beta, model.coefficients.toArray(), atol=1e-6)
        assert intercept == pytest.approx(model.intercept, abs=1e-5)


def test_errors_are_those_of_the_held_out_rows(rows):
    table, picks = training.l1_path(rows, LAMBDAS)
    got = {r["lambda"]: r for r in table.collect()}
    assert list(got) == sorted(LAMBDAS, reverse=True) and picks["lambda_1se"] >= picks["lambda_min"]
    for value in (0.2, 0.01):
        errors = []
        for i in range(1, 6):
            model = LinearRegression(elasticNetParam=1.0, regParam=value, maxIter=500, tol=1e-12).fit(rows.where(F.col("fold") != i))
            errors.append(model.evaluate(rows.where(F.col("fold") == i)).meanSquaredError)
        assert got[value]["mean_mse"] == pytest.approx(np.mean(errors), rel=1e-6)
        assert got[value]["std_mse"] == pytest.approx(np.std(errors), rel=1e-5)


def test_path_reads_the_rows_once(spark, rows):
    stored = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            stored.add(b.num_rows)
            yield b

    arrays = rows.selectExpr("fold", "label").withColumn("x", F.col("label") * 2 + F.col("fold"))
    once = training.assemble(arrays.mapInArrow(count, "fold int, label double, x double"), ["x"])
    training.l1_path(once, [10 ** (-k / 4) for k in range(20)])
    assert stored.value == rows.count()


def test_few_folds(spark, rows):
    assert training.l1_path(rows.where("fold = 1"), LAMBDAS)[0].count() == 0
    assert training.l1_path(rows.where("false"), LAMBDAS)[1] == {}


def test_search_reports_every_setting_and_fold(spark, rows):
    labelled = rows.withColumn("label", (F.col("label") > -30).cast("double")).cache()
    grid = {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}
    best, table, per_fold = training.grid_search(labelled, LogisticRegression(), grid, weighted=True)
    assert per_fold.count() == 30 and table.count() == 6
    assert {r["n_folds"] for r in table.collect()} == {5}
    assert {"auc", "accuracy", "brier"} <= set(per_fold.columns)
    top = table.orderBy(F.desc("mean_auc"), "setting").first()
    alone = training.out_of_fold(labelled, LogisticRegression(regParam=0.01, elasticNetParam=0.0), weighted=True)
    assert alone.count() == 400 and top["mean_auc"] >= 0.5 and best.coefficients.size == 6


def test_weights_reach_the_model(spark):
    rare = spark.range(1000).select((F.col("id") % 10 == 0).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("x"))
    rows = training.assemble(rare, ["x"])
    plain, = training.fit_all(rows, [training.classifier("naive_bayes")])
    even, = training.fit_all(rows, [training.classifier("naive_bayes")], weighted=True)
    assert np.allclose(np.exp(even.pi.toArray()), 0.5) and not np.allclose(np.exp(plain.pi.toArray()), 0.5)
