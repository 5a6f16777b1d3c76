"""The stored series layout: no exchange, only the bands of a window, the same rows."""

import re

import pytest
from pyspark.sql import functions as F

from daygrid.operators import series as S
from daygrid.plans.feature_table import feature_table
from daygrid.sources import layout


@pytest.fixture(scope="module")
def series(spark):
    days = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 200).alias("entity_id"), ((F.col("id") * 7) % 90 - 45).cast("int").alias("day"),
        F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("channel"), F.when(F.col("id") % 5 != 0, (F.col("id") % 17).cast("double")).alias("value"))
    return S.daily(days.unionByName(spark.createDataFrame([(None, 1, "c0", 1.0), (3, None, "c0", 1.0)], days.schema)))


@pytest.fixture(scope="module")
def table(series):
    return layout.store_series(series, buckets=6)


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Broadcast)Exchange \w+", plan)


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["window", "two", "carried", "fill", "baseline"])
def test_no_exchange_and_same_rows(spark, series, table, name):
    work = {
        "window": lambda s, c: S.window_features(s, -15, 2, clustered=c),
        "two": lambda s, c: S.multi_window_features(s, {"a": (-15, -1), "b": (0, 7)}, clustered=c),
        "carried": lambda s, c: S.carried_auc(s, -15, 2),
        "fill": lambda s, c: S.forward_fill(s, -15, 2),
        "baseline": lambda s, c: S.baseline(s, ["c0", "c1", "c2", "c3"], -15, 2),
    }[name]
    hi = 7 if name == "two" else 2
    stored = work(layout.stored_series(spark, table, -15, hi), True)
    clean = series.where("entity_id is not null and day is not null")
    assert rows_of(stored) == rows_of(work(clean, False))
    assert shuffles(stored) == []


def test_only_the_bands_of_the_window_are_read(spark, table):
    days = layout.stored_series(spark, table, -15, 2)
    files = days.inputFiles()
    bands = {int(re.search(r"band=(-?\d+)", f).group(1)) for f in files}
    assert bands and bands <= {-2, -1, 0}
    assert len(files) < len(spark.table(table).inputFiles())
    assert days.agg(F.min("day"), F.max("day")).first() == (-15, 2)


def test_feature_table_moves_neither_side(spark, series, table):
    static = spark.range(250).select(F.col("id").alias("entity_id"), (F.col("id") % 3).alias("group"))
    own = spark.table(layout.store_by_entity(static, table))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = feature_table(own, layout.stored_series(spark, table, -15, 2), ["c0", "c1"], lo=-15, hi=2, clustered=True)
        assert shuffles(wide) == []
        clean = series.where("entity_id is not null and day is not null")
        assert rows_of(wide) == rows_of(feature_table(static, clean, ["c0", "c1"], lo=-15, hi=2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_empty_series(spark, series):
    name = layout.store_series(series.where("false"), buckets=2)
    assert layout.stored_series(spark, name, -5, 5).count() == 0
