"""Text boundaries: the same buckets as a search by hand, and one plan for any number of them."""

from bisect import bisect_right

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daygrid.operators import running

TEXT = st.text(st.sampled_from(["a", "b", "é", "\U0001f600", " ", "z"]), max_size=5)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXT, min_size=1, max_size=20), st.sets(TEXT, max_size=9))
def test_buckets_are_those_of_a_search(spark, texts, cuts):
    cuts = sorted(cuts, key=str.encode)
    df = spark.createDataFrame([(t,) for t in texts], "k string")
    got = running.text_bucket(df, "k", cuts).collect()
    coded = [c.encode() for c in cuts]
    assert [r[running.BUCKET] for r in got] == [bisect_right(coded, t.encode()) for t in texts]


def expressions(df):
    plan = df._jdf.queryExecution().analyzed().expressions().toString()
    return sum(plan.count(word) for word in ("CASE", "aggregate", "lambda"))


def test_plan_does_not_grow_with_the_buckets(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("k"))
    few, many = (running.text_bucket(df, "k", [f"{i:05}" for i in range(n)]) for n in (3, 3000))
    assert expressions(few) == expressions(many)
    assert many.where(f"{running.BUCKET} is null").count() == 0


def test_ranks_of_texts_with_one_long_beginning(spark):
    """Keys that differ only late, and many buckets."""
    start = "http://the.same.host/and/path/"
    df = spark.range(400).select(F.concat(F.lit(start), F.format_string("%04d", F.col("id") % 200)).alias("k"))
    out = running.running_sums(df, [], "k", {"n": F.lit(1)}, text=True, buckets=64).collect()
    assert {r["k"]: r["cum_n"] for r in out} == {f"{start}{i:04}": 2 * (i + 1) for i in range(200)}
    cuts = running.text_cuts(df, "k", 64)
    sizes = running.text_bucket(df, "k", cuts).groupBy(running.BUCKET).count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 40
