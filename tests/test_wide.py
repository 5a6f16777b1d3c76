"""Many levels, many files, long files, many ranks: what must not end in the driver or one task."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from daygrid.operators import prep, quality, stats
from daygrid.sources import readers


def test_many_levels_encode(spark):
    """A column of 200,000 levels: vectors by join, the driver sees their number."""
    rows = spark.range(200_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    hot = prep.OneHot(["c", "d"]).fit(rows)
    assert hot.sizes == {"c": 200_000, "d": 3}
    at = sorted(f"v{i}" for i in range(200_000)).index("v199999")
    some = spark.createDataFrame([("v0", "1"), ("v199999", "2"), ("new", None), (None, "0")], "c string, d string")
    got = hot.transform(some).select("c", "d", "c_onehot", "d_onehot").collect()
    assert {(r["c"], r["d"]): (r["c_onehot"].size, list(r["c_onehot"].indices), list(r["d_onehot"].toArray())) for r in got} == {
        ("v0", "1"): (200_000, [0], [0, 1, 0]), ("v199999", "2"): (200_000, [at], [0, 0, 1]),
        ("new", None): (200_000, [], [0, 0, 0]), (None, "0"): (200_000, [], [1, 0, 0])}


def test_one_hot_without_levels(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b")], "c string, d string")
    got = prep.OneHot(["c", "d"]).fit(rows).transform(rows).select("d", vector_to_array("c_onehot").alias("c"), vector_to_array("d_onehot").alias("v")).collect()
    assert {r["d"]: (sum(r["c"]), r["v"]) for r in got} == {"a": (0.0, [1.0, 0.0]), "b": (0.0, [0.0, 1.0])}


def test_positions_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "7.csv").write_text("day,A001\n" + "".join(f"{i},{i * 2}\n" for i in range(4000)))
    (tmp_path / "8.csv").write_text("day,A001\n3,1\n\n1,2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.read_series_lines(spark, str(tmp_path))
        assert lines.select("line.start").distinct().count() > 5
        placed = quality.with_position(lines, "file", "line").select("entity_id", F.col("cells")[0].cast("int").alias("day"), "position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["day"], r["position"]) for r in placed if r["entity_id"] == 7) == [(i, i) for i in range(4000)]
    assert sorted((r["position"], r["day"]) for r in placed if r["entity_id"] == 8) == [(0, 3), (1, 1)]


def test_many_files_of_few_layouts(spark, tmp_path):
    names = [["id", "a"], ["id", "b", "a"], ["id", 'odd, "x']]
    for n in range(60):
        header = ",".join(f'"{c}"' if "," in c else c for c in names[n % 3]).replace('"odd, "x"', '"odd, x"')
        (tmp_path / f"part {n}.csv").write_text(f"{header}\n{n}," + ",".join("1" * (len(names[n % 3]) - 1)) + "\n")
    paths = [str(tmp_path / f"part {n}.csv") for n in range(60)]
    tracker, group = spark.sparkContext.statusTracker(), "layouts"
    spark.sparkContext.setJobGroup(group, group)
    try:
        table = readers.read_union(spark, paths)
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 6
    assert set(table.columns) == {"id", "a", "b", "odd, x"} and table.count() == 60
    assert {r["id"]: r["a"] for r in table.collect() if int(r["id"]) % 3 == 1}.keys() == {str(n) for n in range(1, 60, 3)}


@pytest.mark.parametrize("limit", [0, 2, 32])
def test_ranks_by_any_way(spark, monkeypatch, limit):
    monkeypatch.setattr(stats, "BROADCAST_COLUMNS", limit)
    rnd = random.Random(limit)
    rows = [(rnd.randrange(5), rnd.random(), rnd.choice([None, 1.0, 2.0]), float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "a int, b double, c double, `d e` double")

    def ranks(values):
        known = sorted(v for v in values if v is not None)
        return [None if v is None else known.index(v) + (known.count(v) + 1) / 2 for v in values]

    want = sorted(zip(*[ranks([r[k] for r in rows]) for k in range(4)], strict=True), key=repr)
    assert sorted((tuple(r) for r in stats.rank_columns(df, ["a", "b", "c", "d e"]).collect()), key=repr) == want


def test_a_thousand_columns_in_one_pass(spark):
    """Flags, hashes and numbers of 1,000 columns; the plan has no aggregate per column."""
    from daygrid.operators import columns, profile

    n = 1000
    df = spark.range(0, 900, 1, 5).select(
        *[F.when((F.col("id") + i) % 7 != 0, (F.col("id") * (i + 1) % 97).cast("double") + 1e9).alias(f"c.{i}") for i in range(n - 3)],
        F.lit("same").alias("s"), F.when(F.col("id") < 0, 1).alias("none"), F.col("id").cast("string").alias("t"))
    flags = columns.constant_flags(df)
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert plan.count("min(") <= 6  # it would be one per column
    got = {r["column"]: r["is_constant"] for r in flags.collect()}
    assert len(got) == n and [c for c, v in got.items() if v] == ["c.96", *[f"c.{i}" for i in range(193, n - 3, 97)], "s", "none"]
    missing = {r["column"]: r["missing_count"] for r in profile.missing_profile(df).collect()}
    assert missing["s"] == 0 and missing["none"] == 900 and missing["c.3"] == sum((k + 3) % 7 == 0 for k in range(900))
    numbers = [c for c in df.columns if c.startswith("c.")]
    scaling = prep.learn_scaling(df, numbers)
    values = [k * 6 % 97 for k in range(900) if (k + 5) % 7]
    mean = sum(values) / len(values)
    assert abs(scaling.means["c.5"] - 1e9 - mean) < 1e-5
    assert abs(scaling.sds["c.5"] - (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5) < 1e-6


def test_summaries_of_an_empty_table(spark):
    from daygrid.operators import columns

    df = spark.createDataFrame([], "a int, b string")
    assert sorted(map(tuple, columns.constant_flags(df).collect())) == [("a", True), ("b", True)]
    assert sorted(map(tuple, columns.missing_by_column(df).collect())) == [("a", 0, None, 0), ("b", 0, None, 0)]
    assert prep.learn_scaling(df, ["a"]) == prep.Scaling({"a": 0.0}, {"a": 1.0})
