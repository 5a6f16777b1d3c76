"""Results must not depend on layout, bucket counts or skew."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daygrid.operators import evaluate, quality, running, splits
from daygrid.operators import series as S


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    # group "hot" holds most rows, most of them one value
    rows = [("hot", 1.0) for _ in range(600)] + [("hot", rng.random() * 10) for _ in range(300)]
    rows += [(g, float(rng.randint(0, 20))) for g in ("a", "b", "c") for _ in range(60)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_running_sums_for_any_buckets(numbers, buckets):
    rows, df = numbers
    got = {
        (r["g"], r["v"]): (r["n"], r["cum_n"], r["total_n"])
        for r in running.running_sums(df.repartition(buckets), ["g"], "v", {"n": F.lit(1)}, buckets=buckets).collect()
    }
    counts = Counter(rows)
    for g in {g for g, _ in rows}:
        seen, total = 0, sum(1 for x, _ in rows if x == g)
        for v in sorted({v for x, v in rows if x == g}):
            seen += counts[g, v]
            assert got.pop((g, v)) == (counts[g, v], seen, total)
    assert not got


def test_exact_quantiles_match_sorting(numbers):
    rows, df = numbers
    got = {r["g"]: r for r in running.exact_quantiles(df, ["g"], "v", {"q": 0.25, "m": 0.5}).collect()}
    for g in got:
        values = sorted(v for x, v in rows if x == g)
        for name, p in (("q", 0.25), ("m", 0.5)):
            at = p * (len(values) - 1)
            lo = int(at)
            hi = min(lo + 1, len(values) - 1)
            assert got[g][name] == pytest.approx(values[lo] + (values[hi] - values[lo]) * (at - lo))


@pytest.mark.parametrize("buckets", [1, 2, 17])
def test_previous_row_crosses_buckets(spark, buckets):
    rows = [("hot", i, f"r{i}") for i in range(200)] + [("b", i * 10, f"s{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, r string").repartition(5)
    bucketed = running.with_bucket(df, "i", buckets)
    out = running.with_previous(bucketed, ["g"], "i", {"r": "before"})
    last = {}
    for g, i, r in rows:
        last[g, i] = next((x for h, j, x in reversed(rows) if h == g and j < i), None)
    assert {(r["g"], r["i"]): r["before"] for r in out.collect()} == last
    sums = running.running_row_sums(bucketed.withColumn("one", F.lit(1)), ["g"], "i", {"one": "s"})
    assert {(r["g"], r["s"]) for r in sums.where("g = 'b'").collect()} == {("b", k) for k in range(1, 6)}


def test_text_order_numbers(spark):
    words = ["b", "a", "ab", "é", "Z", "zz", "a", "b"] + [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["number"] for r in running.dense_numbers(df, "w", text=True).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words), key=str.encode), 1)}


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([(i, 1 if i % 7 == 0 else 0) for i in range(1, 311)], "id int, y int")


def test_splits_keep_shares_and_ignore_layout(entities):
    one = splits.assign(entities, "id", "y", test_share=0.3, k=5)
    two = splits.assign(entities.orderBy(F.desc("id")).repartition(7), "id", "y", test_share=0.3, k=5)
    a, b = sorted(map(tuple, one.collect())), sorted(map(tuple, two.collect()))
    assert a == b and len(a) == 310
    for y in (0, 1):
        group = [r for r in a if r[1] == y]
        assert sum(r[2] == "test" for r in group) == round(len(group) * 0.3)
        sizes = Counter(r[3] for r in group)
        assert set(sizes) == {1, 2, 3, 4, 5} and max(sizes.values()) - min(sizes.values()) <= 1
        assert [sizes[i] for i in range(1, 6)] == sorted(sizes.values(), reverse=True)


def test_fewer_members_than_folds(spark):
    few = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, y int")
    rows = splits.stratified_folds(few, "id", "y", 5).collect()
    assert sorted((r["y"], r["fold"]) for r in rows) == [(0, 1), (0, 2), (1, 1)]


def test_null_labels_form_a_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(40)], "id int, y int")
    rows = splits.stratified_split(df, "id", "y", 0.25).collect()
    assert Counter((r["y"], r["split"]) for r in rows) == {
        (None, "test"): 5, (None, "train"): 15, (1, "test"): 5, (1, "train"): 15
    }


def test_rows_of_an_entity_share_a_fold(spark):
    rows = [(i % 20, i, 1 if i % 20 < 6 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t int, y int")
    out = splits.folds_for_rows(df, "id", "y", "t", 4)
    assert out.count() == 200
    assert out.groupBy("id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_fold_check_finds_overlap_and_gaps(spark):
    rows = [(1, "train", 1), (1, "val", 1), (1, "val", 2), (2, "train", 1), (2, "val", 2), (2, "val", 3)]
    got = {r["fold"]: r for r in quality.check_folds(spark.createDataFrame(rows, "fold int, role string, id int")).collect()}
    assert got[1]["n_overlap"] == 1 and not got[1]["ok"]
    assert got[2]["ok"]


def test_auc_counts_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(150)]
    df = spark.createDataFrame([("m", y, s) for y, s in rows], "model string, y int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    for layout in (1, 6):
        assert evaluate.auc(df.repartition(layout), ["model"]).first()["auc"] == pytest.approx(want, abs=1e-12)


def test_carried_auc_equals_dense_walk(spark):
    rng = random.Random(1)
    rows = [(e, d, "c", None if rng.random() < 0.4 else rng.random()) for e in range(12) for d in range(-6, 7) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "entity_id int, day int, channel string, value double")
    got = {r["entity_id"]: r["auc"] for r in S.carried_auc(df, -5, 3).collect()}
    for e in got:
        carried, curve = None, []
        for d in range(-5, 4):
            v = next((x[3] for x in rows if x[0] == e and x[1] == d), None)
            carried = v if v is not None else carried
            curve.append(carried or 0.0)
        assert got[e] == pytest.approx(sum((a + b) / 2 for a, b in zip(curve, curve[1:])))


def test_heavy_ties_keep_the_buckets_even(spark):
    """One value with 99 % of the rows: the buckets follow the distinct keys."""
    df = spark.range(200_000).select(F.when(F.col("id") % 100 < 99, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    keys = df.groupBy("v").count()
    cuts = running.numeric_cuts(keys, "v", 16)
    sizes = [r["count"] for r in running.numeric_bucket(keys, "v", cuts).groupBy(running.BUCKET).count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_blank_and_missing_labels_are_strata_of_their_own(spark):
    df = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(8)], "id int, label string")
    got = Counter((r["label"], r["fold"]) for r in splits.stratified_folds(df, "id", "label", 2).collect())
    assert got == {("", 1): 2, ("", 2): 2, (None, 1): 2, (None, 2): 2}
