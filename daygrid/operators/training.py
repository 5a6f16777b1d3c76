"""Distributed training on given folds: grid search, out-of-fold scores, importance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
    MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.operators import evaluate
from daygrid.operators.columns import q
from daygrid.operators.profile import class_weight
from daygrid.session import durable

CLASSIFIERS: dict[str, Callable[..., Estimator]] = {
    "logistic_regression": LogisticRegression,
    "random_forest": RandomForestClassifier,
    "decision_tree": DecisionTreeClassifier,
    "gradient_boosting": GBTClassifier,
    "naive_bayes": NaiveBayes,
    "linear_svm": LinearSVC,
    "multilayer_perceptron": MultilayerPerceptronClassifier,
}


def classifier(name: str, features: str = "features", label: str = "label", seed: int = 42,
               n_features: int | None = None, **params) -> Estimator:
    """An MLlib classifier by name with the settings its kind needs."""
    options = {"featuresCol": features, "labelCol": label, **params}
    if name == "naive_bayes":
        options.setdefault("modelType", "gaussian")
    if name in ("random_forest", "decision_tree", "gradient_boosting", "multilayer_perceptron"):
        options.setdefault("seed", seed)
    if name == "multilayer_perceptron" and "layers" not in options:
        options["layers"] = [n_features, 16, 2]
    return CLASSIFIERS[name](**options)


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def with_class_weight(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Positives weigh negatives / positives, everything else 1 (one scalar aggregate)."""
    ratio = class_weight(df, label).first()["pos_weight"]
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(1.0))


def positive_score(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1, or the raw margin where a model has no probability."""
    scored = model.transform(df)
    source = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.withColumn(name, vector_to_array(source)[1])


def _together(df: DataFrame, jobs: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Results of several fits on ``df`` that run at the same time; their order is that of ``jobs``."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(df.sparkSession)(lambda job: job()), jobs))


def _fit(df: DataFrame, estimator: Estimator, label: str, weighted: bool):
    """A model, with the positives weighing as much as the negatives where that is asked for
    and the estimator knows weights."""
    if weighted and estimator.hasParam("weightCol"):
        return estimator.copy({estimator.weightCol: "weight"}).fit(with_class_weight(df, label))
    return estimator.fit(df)


def fit_all(df: DataFrame, estimators: Sequence[Estimator], label: str = "label", weighted: bool = False, parallelism: int = 4) -> list:
    """The model of every estimator on the same stored rows, fitted at the same time."""
    return _together(df, [lambda e=e: _fit(df, e, label, weighted) for e in estimators], parallelism)


def out_of_fold(
    df: DataFrame, estimator: Estimator, fold: str = "fold", label: str = "label",
    keep: Sequence[str] = (), k: int = 5, weighted: bool = False, parallelism: int = 4,
) -> DataFrame:
    """(keep…, fold, y, score): each row scored by the model that did not see its fold.

    ``df`` should be a stored frame: the folds are fitted at the same time."""
    models = _together(df, [lambda i=i: _fit(df.where(F.col(fold) != i), estimator, label, weighted) for i in range(1, k + 1)], parallelism)
    parts = [positive_score(m, df.where(F.col(fold) == i)).select(*keep, fold, F.col(label).alias("y"), "score") for i, m in enumerate(models, 1)]
    return reduce(DataFrame.unionByName, parts)


def param_grid(estimator: Estimator, values: Mapping[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(getattr(estimator, name), list(options))
    return builder.build()


def setting_name(setting: Mapping) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(setting.items(), key=lambda x: x[0].name))


def fold_metrics(
    df: DataFrame, estimator: Estimator, settings: Sequence[Mapping], fold: str = "fold", label: str = "label",
    k: int = 5, weighted: bool = False, parallelism: int = 4,
) -> DataFrame:
    """(setting, params, fold, and the columns of ``evaluate.summary``) for every setting and
    fold: all models are fitted at the same time, ``parallelism`` of them, and their held-out
    scores judged in one plan."""
    pairs = [(n, s, i) for n, s in enumerate(settings) for i in range(1, k + 1)]
    models = _together(df, [lambda s=s, i=i: _fit(df.where(F.col(fold) != i), estimator.copy(dict(s)), label, weighted) for _, s, i in pairs], parallelism)
    parts = [
        positive_score(m, df.where(F.col(fold) == i)).select(
            F.lit(n).alias("setting"), F.lit(setting_name(s)).alias("params"), F.lit(i).alias("fold"), F.col(label).alias("y"), "score")
        for (n, s, i), m in zip(pairs, models, strict=True)
    ]
    return evaluate.summary(durable(reduce(DataFrame.unionByName, parts), "held_out"), ["setting", "params", "fold"])


def grid_search(
    df: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence], fold: str = "fold",
    label: str = "label", k: int = 5, weighted: bool = False, parallelism: int = 4,
) -> tuple[object, DataFrame, DataFrame]:
    """(best model fitted on all rows, AUC mean and deviation per setting, metrics per setting and fold).

    ``fold`` is 1…k; the folds are those of the column, never drawn anew. The best setting
    has the highest mean AUC, the first of equals.
    """
    settings = param_grid(estimator, grid)
    per_fold = durable(fold_metrics(df, estimator, settings, fold, label, k, weighted, parallelism), "fold_metrics")
    table = per_fold.groupBy("setting", "params").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.count("auc").alias("n_folds"))
    best = table.orderBy(F.desc_nulls_last("mean_auc"), "setting").first()["setting"]
    return _fit(df, estimator.copy(dict(settings[best])), label, weighted), table, per_fold


def feature_importance(model, columns: Sequence[str], spark) -> DataFrame:
    """(feature, importance) of a tree model, or |coefficient| of a linear one."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = abs(model.coefficients.toArray())
    rows = [(c, float(v)) for c, v in zip(columns, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float]) -> DataFrame:
    """(feature, contribution): mean |coefficient · (x - mean)| per feature."""
    names = list(coefficients)
    means = df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    sizes = df.agg(
        *[
            F.avg(F.abs(F.lit(float(coefficients[c])) * (F.col(q(c)) - F.lit(means[f"m{i}"])))).alias(c)
            for i, c in enumerate(names)
        ]
    )
    return sizes.unpivot([], [F.col(q(c)) for c in names], "feature", "contribution")


def gram_sums(df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold") -> dict[int, np.ndarray]:
    """Per fold, the sums of products of (1, features…, label) with each other, in one scan.

    Tasks add up rows in blocks; each line of a fold's matrix is then summed by itself, so
    that the work on wide tables spreads over (fold, line). What reaches the driver has the
    size of the columns squared, whatever the number of rows. Rows with a null or without
    fold take no part.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            z = np.column_stack([np.ones(len(x)), x, batch.column(2).to_numpy()])
            folds = batch.column(0).to_numpy()
            for i in np.unique(folds):
                own = z[folds == i]
                total[int(i)] = total.get(int(i), 0.0) + own.T @ own
        for i, m in total.items():
            lines = pa.array([line.tobytes() for line in m], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), lines], names=["fold", "line", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        line = lambda: pa.RecordBatch.from_arrays([pa.array([k], t) for k, t in zip((*now, total.tobytes()), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["fold", "line", "sums"])
        for batch in batches:
            for i, n, sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (i, n) != now:
                    if now is not None:
                        yield line()
                    now, total = (i, n), np.zeros(len(sums) // 8)
                total += np.frombuffer(sums)
        if now is not None:
            yield line()

    rows = df.where(F.col(features).isNotNull() & F.col(label).isNotNull() & F.col(fold).isNotNull()).select(
        F.col(fold).cast("int").alias("fold"), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    parts = rows.mapInArrow(partial, "fold int, line int, sums binary").repartition("fold", "line").sortWithinPartitions("fold", "line", F.xxhash64("sums"))
    lines: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.mapInArrow(merge, "fold int, line int, sums binary").collect():
        lines.setdefault(r["fold"], {})[r["line"]] = np.frombuffer(r["sums"])
    return {i: np.stack([m[n] for n in range(len(m))]) for i, m in sorted(lines.items())}


def lasso_from_sums(sums: np.ndarray, lambdas: Sequence[float], tolerance: float = 1e-12, rounds: int = 10_000) -> list[tuple[float, np.ndarray]]:
    """(intercept, coefficients) for every lambda, largest first as given: coordinate descent
    on centred products, each start from the solution before.

    The penalty is lambda times the sum of |coefficient| x deviation, as MLlib's normal
    solver with standardization; a constant feature has coefficient 0.
    """
    n = sums[0, 0]
    means = sums[0] / n
    cov = sums / n - np.outer(means, means)
    gram, cross = cov[1:-1, 1:-1], cov[1:-1, -1]
    spread = np.diag(gram)
    # what centring leaves of a constant column is rounding
    live = np.flatnonzero(spread > 1e-12 * np.maximum(np.diag(sums)[1:-1] / n, 1e-300))
    sd = np.sqrt(np.maximum(spread, 0))
    beta = np.zeros(len(cross))
    out = []
    for value in lambdas:
        for _ in range(rounds):
            moved = 0.0
            for j in live:
                free = cross[j] - gram[j] @ beta + spread[j] * beta[j]
                new = np.sign(free) * max(abs(free) - value * sd[j], 0.0) / spread[j]
                moved = max(moved, abs(new - beta[j]) * sd[j])
                beta[j] = new
            if moved <= tolerance * max(np.sqrt(max(cov[-1, -1], 0.0)), 1e-300):
                break
        out.append((float(means[-1] - means[1:-1] @ beta), beta.copy()))
    return out


def squared_error(sums: np.ndarray, intercept: float, beta: np.ndarray) -> float:
    """Mean squared error of a linear model over the rows that ``sums`` were taken of."""
    v = np.concatenate([[-intercept], -beta, [1.0]])
    return float(max(v @ sums @ v, 0.0) / sums[0, 0])


def l1_path(
    df: DataFrame, lambdas: Sequence[float], features: str = "features", label: str = "label", fold: str = "fold",
) -> tuple[DataFrame, dict[str, float]]:
    """(lambda, mean_mse, std_mse, df) and the picks lambda_min and lambda_1se.

    One scan gives every fold's sums of products; each fold's model is solved from the sums
    of the others and judged on its own, for all lambdas, without reading a row again.
    lambda_1se is the largest lambda whose error is within one deviation of the least.
    """
    ordered = sorted(lambdas, reverse=True)
    folds = gram_sums(df, features, label, fold)
    spark = df.sparkSession
    schema = "lambda double, mean_mse double, std_mse double, df int"
    if len(folds) < 2:
        return spark.createDataFrame([], schema), {}
    whole = sum(folds.values())
    errors = np.array([[squared_error(own, *model) for model in lasso_from_sums(whole - own, ordered)] for own in folds.values()])
    counts = [int((beta != 0).sum()) for _, beta in lasso_from_sums(whole, ordered)]
    rows = [(float(v), float(m), float(s), n) for v, m, s, n in zip(ordered, errors.mean(axis=0), errors.std(axis=0), counts, strict=True)]
    least = min(rows, key=lambda r: r[1])
    near = next(r for r in rows if r[1] <= least[1] + least[2])
    picks = {"lambda_min": least[0], "df_min": least[3], "lambda_1se": near[0], "df_1se": near[3]}
    return spark.createDataFrame(rows, schema), picks
