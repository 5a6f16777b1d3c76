"""Rows whose work their bytes do not show are dealt to many tasks."""

from pyspark.sql import functions as F

from daygrid.operators import evaluate
from daygrid.plans import training_queries
from daygrid.plans.bindings import Tables


def test_resampled_rows_are_not_gathered_by_size(spark):
    rows = spark.range(300).select(
        F.lit(1).alias("_bucket"), F.col("id").alias("_id"), (F.col("id") / 300).alias("score"), (F.col("id") % 2).alias("y"), (F.col("id") % 16).cast("int").alias("_salt"))
    cells = evaluate._resampled_buckets(rows, 5, 42)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
    assert cells.count() == 16


def test_model_rows_are_stored_in_many_files(spark):
    """A fit has a task for each file at most, if the files are short."""
    assert len(training_queries.model_rows(Tables(spark, "/root/testdata/sf0.001")).inputFiles()) > 4
