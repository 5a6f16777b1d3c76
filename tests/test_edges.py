"""Edge rows: nulls, single points, ties, one class, empty windows, missing files, duplicates."""

import math

import pytest
from pyspark.sql import functions as F

from daygrid.functions import labels, recode
from daygrid.functions.pvalues import chi2_p, fisher_p, normal_p, t_p
from daygrid.operators import cohort, columns, dialogue, evaluate, prep, profile, quality, stats
from daygrid.operators import series as S

SERIES = "entity_id int, day int, channel string, value double"


def features(spark, rows, **options):
    out = S.window_features(spark.createDataFrame(rows, SERIES), -2, 2, **options)
    return {(r["entity_id"], r["channel"]): r for r in out.collect()}


def test_window_feature_edges(spark):
    rows = [
        (1, 0, "null", None), (1, 1, "null", None),
        (1, 1, "one", 4.0), (1, 9, "one", 100.0),
        (1, -2, "tie", 3.0), (1, -1, "tie", 5.0), (1, 0, "tie", None), (1, 2, "tie", 5.0),
    ]
    got = features(spark, rows)
    empty = got[1, "null"]
    assert empty["count"] == 0 and all(empty[c] is None for c in S.STATS if c != "count")
    single = got[1, "one"]
    assert (single["mean"], single["std"], single["slope"], single["auc"]) == (4.0, 0.0, None, None)
    tie = got[1, "tie"]
    assert tie["time_to_peak"] == -1 and tie["last_value"] == 5.0
    assert tie["auc"] == pytest.approx(4.0 + 15.0)
    sample = features(spark, rows, ddof=1, peak_min_points=2)
    assert sample[1, "one"]["std"] is None and sample[1, "one"]["time_to_peak"] is None


def test_empty_window(spark):
    assert features(spark, [(1, 20, "c", 1.0)]) == {}


def test_baseline_gap_and_sparse_channel(spark):
    rows = [(1, -5, "a", 2.0), (1, -1, "a", None), (1, -1, "b", 3.0), (2, 3, "a", 9.0)]
    got = S.baseline(spark.createDataFrame(rows, SERIES), ["a", "b"]).collect()
    assert [(r["entity_id"], r["baseline_a"], r["baseline_b"], r["baseline_gap_days"]) for r in got] == [(1, 2.0, 3.0, 1)]


def test_two_window_defaults(spark):
    rows = [(1, -3, "a", 2.0), (1, 0, "a", 5.0), (1, 2, "a", 9.0)]
    out = S.multi_window_features(spark.createDataFrame(rows, SERIES), {"before": (-5, -1), "after": (0, 5)})
    got = {r["window"]: (r["count"], r["std"], r["slope"]) for r in out.collect()}
    assert got["before"] == (1, 0.0, 0.0)
    assert got["after"][0] == 2 and got["after"][2] == pytest.approx(2.0)


def test_monitor_reasons(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "entity_id int")
    rows = [(1, -1, "a", None), (1, -2, "b", 1.0), (2, 5, "a", 1.0)]
    out = quality.monitor_variables(ids, spark.createDataFrame(rows, SERIES), ["a", "b"])
    got = {(r["entity_id"], r["variable"]): (r["has_data"], r["reason"]) for r in out.collect()}
    assert got[1, "a"] == (False, "value_is_nan") and got[1, "b"] == (True, None)
    assert got[2, "a"][1] == "no_data_in_time_window" and got[3, "a"][1] == "patient_file_not_found"


def test_id_continuity(spark):
    ids = spark.createDataFrame([("2",), ("3",), ("3",), ("6",), (None,)], "id string")
    rows = {tuple(r) for r in quality.check_id_continuity(ids, "id").collect()}
    assert rows == {("bad_start", 1, 2), ("gap", 1, 2), ("duplicate", None, 3)}
    twice = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    assert ("gap", 3, 2) in {tuple(r) for r in quality.check_id_continuity(twice, "id").collect()}


def test_duplicate_ids_get_one_number(spark):
    static = spark.createDataFrame([(7,), (3,), (7,)], "entity_id int")
    series = spark.createDataFrame([(3, 1), (7, 2), (9, 3)], "entity_id int, v int")
    out = cohort.rekey(series, cohort.id_map(static))
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 2)]


def test_day_grid_positions(spark):
    rows = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 0), (2, 2, 1), (2, 1, 2), (3, 0, 0), (3, 0, 1), (3, 5, 2)]
    df = spark.createDataFrame(rows, "entity_id int, day int, pos int")
    got = {r["entity_id"]: r for r in quality.check_day_grid(df, 0, 2, position="pos").collect()}
    assert set(got) == {2, 3}
    assert got[2]["n_misplaced"] == 2 and got[2]["first_gap"] is None
    assert got[3]["n_days"] == 1 and got[3]["n_outside"] == 1 and got[3]["first_gap"] == 1


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.4), ("b", 0, 0.1), ("b", 1, 0.9)], "g string, y int, score double")
    assert {r["g"]: r["auc"] for r in evaluate.subgroup_auc(df, [], "g").collect()} == {"a": None, "b": 1.0}
    zero = evaluate.confusion(df.where("y = 0 and score < 0.5"), ["g"]).first()
    assert zero["sensitivity"] == 0.0 and zero["f1"] == 0.0 and zero["specificity"] == 1.0


def test_binarize_argument_checks(spark):
    df = spark.createDataFrame([(1, "x", 3), (2, "y", None)], "a int, t string, g int")
    assert [r["g_bin"] for r in labels.binarize(df, ["g"], 2, "_bin").collect()] == [1, None]
    with pytest.raises(ValueError):
        labels.binarize(df, "nope")
    with pytest.raises(TypeError):
        labels.binarize(df, "t")
    with pytest.raises(TypeError):
        labels.binarize(df, 5)


def test_scalar_rules(spark):
    texts = ["3", "-1", "many", "1e1", "1d", " 2 ", None, "NA", "2.9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    rows = df.select(
        recode.extranodal_level(c).alias("e"), recode.therapy_line_level(c).alias("n"),
        recode.grade_to_int(c).alias("g"), recode.is_numeric_or_missing(c).alias("ok"),
    ).collect()
    assert [r["e"] for r in rows] == ["2", "-1", "many", "2", "1d", "2", None, "NA", "2"]
    assert [r["n"] for r in rows] == ["3", "-1", "many", "4", "1d", "2", None, "NA", "2"]
    assert [r["g"] for r in rows] == ["3", "-1", "many", "10", "1d", "2", None, "NA", "2"]
    assert [r["ok"] for r in rows] == [True, True, False, True, False, True, True, True, True]


def p_values(spark, p, rows):
    """The p-value of each row of arguments."""
    names = "abcd"[: len(rows[0])]
    kind = "long" if p is fisher_p else "double"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} {kind}" for c in names))
    return [r["p"] for r in df.select("i", p(*names).alias("p")).orderBy("i").collect()]


def t_by_hand(t, df):
    """Whole degrees of freedom: a finite sum over powers of the cosine."""
    angle = math.atan(t / math.sqrt(df))
    if df % 2 == 0:
        terms = sum(math.comb(2 * j, j) / 4**j * math.cos(angle) ** (2 * j) for j in range(df // 2))
        return 1 - math.sin(angle) * terms
    terms = sum(4**j / (math.comb(2 * j, j) * (2 * j + 1)) * math.cos(angle) ** (2 * j + 1) for j in range((df - 1) // 2))
    return 1 - 2 / math.pi * (angle + math.sin(angle) * terms)


def test_p_values(spark):
    close = lambda want, tol=1e-10: pytest.approx(want, rel=tol, abs=1e-12)
    assert p_values(spark, t_p, [(2.0, 10.0), (-2.0, 10.0)]) == close([0.0733880347707] * 2)
    cases = [(t, df) for df in (1, 2, 3, 7, 10, 60, 101) for t in (0.0, 0.01, 0.7, 1.96, 4.0)]
    assert p_values(spark, t_p, [(t, float(df)) for t, df in cases]) == close([t_by_hand(*c) for c in cases])
    # as many degrees of freedom as a table of a billion rows has: all but normal
    many = p_values(spark, t_p, [(1.96, 1e9), (5.0, 1e12)])
    assert many == close([math.erfc(v / math.sqrt(2)) for v in (1.96, 5.0)], 1e-7)
    assert p_values(spark, normal_p, [(z,) for z in (0.0, 0.1, -1.0, 1.96, 8.0, 30.0)]) == close(
        [math.erfc(z / math.sqrt(2)) for z in (0.0, 0.1, 1.0, 1.96, 8.0, 30.0)])
    assert p_values(spark, chi2_p, [(3.841458820694124, 1.0), (9.487729036781154, 4.0)]) == close([0.05, 0.05])
    # even degrees of freedom: a Poisson sum; one degree: the normal tail
    cases = [(x, k) for k in (2, 4, 10, 60) for x in (1e-3, 0.5, 5.0, 40.0, 90.0)]
    poisson = lambda x, k: sum(math.exp(-x / 2 + j * math.log(x / 2) - math.lgamma(j + 1)) for j in range(k // 2))
    assert p_values(spark, chi2_p, [(x, float(k)) for x, k in cases]) == close([poisson(*c) for c in cases])
    assert p_values(spark, chi2_p, [(x, 1.0) for x in (0.01, 1.0, 50.0)]) == close([math.erfc(math.sqrt(x / 2)) for x in (0.01, 1.0, 50.0)])
    assert p_values(spark, chi2_p, [(0.0, 3.0), (5.0, 0.0)]) == [1.0, 1.0]
    assert p_values(spark, fisher_p, [(8, 2, 1, 5), (0, 0, 0, 0)]) == close([0.034965034965, 1.0], 1e-9)


def test_undefined_statistics_have_no_p_value(spark):
    nan = float("nan")
    assert p_values(spark, t_p, [(None, 3.0), (nan, 3.0), (1.0, None), (1.0, 0.0)]) == [None] * 4
    assert p_values(spark, chi2_p, [(None, 3.0), (nan, 3.0), (1.0, None)]) == [None] * 3
    assert p_values(spark, normal_p, [(None,), (nan,)]) == [None] * 2
    assert p_values(spark, fisher_p, [(None, 1, 1, 1), (1, 1, 1, 1)]) == [None, 1.0]


def test_group_tests(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (3, 4, 5, 6, 9)]
    df = spark.createDataFrame(rows, "g string, v double")
    t = stats.t_test(df, ["v"], "g", ["a", "b"]).first()
    # means 3 and 5.4, pooled variance (4 · 2.5 + 4 · 5.3) / 8 = 3.9
    assert t["statistic"] == pytest.approx(-2.4 / (3.9 * 0.4) ** 0.5) and t["df"] == 8
    u = stats.mann_whitney(df, ["v"], "g", ["a", "b"]).first()
    assert u["statistic"] == 4.5 and u["z"] == pytest.approx(7.5 / (25 / 12 * 10.8) ** 0.5)
    assert u["p_value"] == pytest.approx(0.11384, abs=1e-4)


def test_table_one_picks_fisher_for_small_cells(spark):
    rows = [("a", "x", 1.0)] * 8 + [("a", "y", 2.0)] * 2 + [("b", "x", 3.0)] + [("b", "y", 4.0)] * 5
    df = spark.createDataFrame(rows, "g string, c string, v double")
    out = stats.baseline_table(df, "g", ["a", "b"], ["v"], ["c"]).where("type = 'categorical'").collect()
    assert {r["test"] for r in out} == {"fisher"}
    assert out[0]["p_value"] == pytest.approx(0.034965034965, abs=1e-9)
    assert {(r["level"], r["group_1"], r["group_2"]) for r in out} == {("x", "8 (80.0%)", "1 (16.7%)"), ("y", "2 (20.0%)", "5 (83.3%)")}


def test_adjusted_p(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "variable string, p_value double")
    got = {r["variable"]: (r["p_bonferroni"], r["p_bh"]) for r in stats.adjust_p(tests).collect()}
    assert got["a"] == pytest.approx((0.03, 0.03)) and got["c"] == pytest.approx((0.09, 0.04)) and got["d"] == (None, None)


def test_constants_and_alignment(spark):
    df = spark.createDataFrame([(1, "x", None, 5), (2, "x", None, None)], "id int, c string, n string, half int")
    assert columns.ConstantColumnDropper().fit(df).constant_columns == ["c", "n", "half"]
    other = df.drop("c")
    done = columns.align_columns(df, other, drop=["c", "n", "zzz"])
    assert done.dropped == ["n"] and done.only_train == ["c"] and done.not_found == ["zzz"]
    assert done.train.columns == ["id", "c", "half"]
    with pytest.raises(ValueError):
        columns.align_columns(df, other)


def test_missing_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 1, None), (3, 1, None), (4, 1, 1)], "ID int, a int, b int")
    out = columns.filter_by_missing(df, 25.0, scope="static")
    assert out.dropped == ["b"] and out.df.columns == ["ID", "a"]
    assert columns.filter_by_missing(df, 25.0, drop=False, scope="static").df.columns == ["ID", "a", "b"]


def test_imputation_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, None)], "a double, b double")
    medians = prep.learn_medians(df, ["a", "b"])
    assert medians == {"a": 0.0, "b": 2.0}
    assert prep.learn_scaling(prep.impute(df, medians), ["a", "b"]).sds["a"] == 1.0


def test_level_ratio_without_second(spark):
    df = spark.createDataFrame([("male",), ("male",)], "sex string")
    assert profile.level_ratio(df, "sex", "male", "female").first()["ratio"] is None


def test_smote_balances_inside_the_minority(spark):
    rows = [(f"k{i}", 0, float(i), float(i % 5)) for i in range(60)] + [(f"m{i}", 1, 10.0 + i, 2.0) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, y int, a double, b double")
    made = prep.smote(df, "id", "y", ["a", "b"], k=3).collect()
    assert len(made) == 51 and all(r["id"] is None for r in made)
    assert all(r["b"] == 2.0 and 10.0 <= r["a"] <= 18.0 for r in made)
    uses = {}
    for r in made:
        uses[r["source"]] = uses.get(r["source"], 0) + 1
        assert abs(r["a"] - (int(r["source"][1:]) + 10)) <= 3.0
    assert set(uses.values()) == {5, 6}


def test_smote_ignores_layout(spark):
    rows = [(i, int(i % 9 == 0), float(i * 7919 % 1000), float(i * 104729 % 997)) for i in range(2000)] + [(9000 + i, 1, 5.0, 5.0) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (4, 32):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted(map(tuple, prep.smote(df.repartition(parts), "id", "y", ["a", "b"]).select("source", "a", "b").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0]) == sum(1 if r[1] == 0 else -1 for r in rows)


def test_mann_whitney_without_spread(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, None), (1, 3.0, None)], "g int, flat double, lone double")
    got = {r["variable"]: (r["z"], r["p_value"]) for r in stats.mann_whitney(df, ["flat", "lone"], "g", [1, 2]).collect()}
    assert got == {"flat": (None, None), "lone": (None, None)}
    assert stats.compare(df, ["flat"], "g", [1, 2]).count() == 1


def test_calibration_leaves_out_missing(spark):
    df = spark.createDataFrame([(1, 0.95), (0, None), (None, 0.95)], "y int, score double")
    assert [tuple(r) for r in evaluate.calibration(df, []).collect()] == [(10, 1, 1.0, 0.95)]


def test_fisher_of_large_tables(spark):
    cases = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (0, 0, 3, 4), (12, 7, 0, 9), (1, 400, 90, 2000), (700, 500, 400, 600)]
    got = p_values(spark, fisher_p, cases)
    for (a, b, c, d), p in zip(cases, got, strict=True):
        row, col, n = a + b, a + c, a + b + c + d
        each = {k: math.comb(col, k) * math.comb(n - col, row - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(v for v in each.values() if v * 10**7 <= each[a] * (10**7 + 1)) * 10**30 // sum(each.values()) / 10**30
        assert p == pytest.approx(want, rel=1e-9, abs=1e-25)
    big = 10**9
    equal, near, far = p_values(spark, fisher_p, [(big, big, big, big), (big, big, big + 10**5, big), (big, 0, 0, big)])
    assert abs(equal - 1) < 1e-6 and 0 < near < 1 and far == 0.0


def test_bootstrap_weights_have_no_cap():
    steps = evaluate.poisson_steps()
    assert len(steps) > 15 and steps == sorted(steps) and 1 - steps[-1] < 1e-15


def turn(role, text):
    return f'types.Content(\n role="{role}",\n parts=[types.Part.from_text(text="""{text}"""),],\n),'


def test_turn_extraction(spark):
    body = 'model = "m-1"\ncontents = [\n' + turn("user", " a [list] \n") + turn("model", "say 'hi'\n\nthere") + "\n]\n" + turn("user", "outside")
    files = spark.createDataFrame([("f", body), ("none", "x = 1"), ("open", "contents = [ " + turn("user", "lost"))], "file string, value string")
    got = sorted(map(tuple, dialogue.extract_turns(files).collect()))
    assert got == [("f", 1, "user", "a [list]"), ("f", 2, "model", "say 'hi'\n\nthere")]
    meta = {r["file"]: (r["model"], r["key_name"], r["n_lines"]) for r in dialogue.file_metadata(files).collect()}
    assert meta["f"][0] == "m-1" and meta["none"] == (None, None, 1)


def test_rounds_contents_and_documents(spark, tmp_path):
    roles = ["model", "user", "model", "model", "system", "model", "user", "user", "model", "user"]
    turns = spark.createDataFrame([(1, i, r, f"text {i}") for i, r in enumerate(roles)], "conv_id int, turn int, role string, text string")
    got = [(r["round"], r["is_lone_reply"]) for r in dialogue.with_rounds(turns).orderBy("turn").collect()]
    assert got == [(1, True), (2, False), (2, False), (3, True), (None, False), (4, True), (5, False), (6, False), (6, False), (7, False)]
    assert dialogue.contents_table(turns).count() == 4
    blocks = dialogue.document_blocks(turns)
    dialogue.write_documents(blocks, str(tmp_path / "docs"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "docs" / "conv_id=1").glob("part-*")))
    ordered = [r["block"] for r in blocks.orderBy("section", "place").collect()]
    assert text == "\n".join(ordered) + "\n" and len(ordered) == 14


def test_code_detection(spark):
    texts = ["import os\nprint(1)\nreturn x", "```\nimport os print( return \n```", "plain", "\n" * 11]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(dialogue.is_code_like(F.col("t"))).collect()] == [True, False, False, True]


def test_binarizer_in_a_pipeline(spark):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([(3,), (1,), (None,)], "g int")
    model = Pipeline(stages=[columns.Binarizer({"g": 2}, suffix="_hi")]).fit(df)
    assert [r["g_hi"] for r in model.transform(df).collect()] == [1, 0, None]


def test_bootstrap_counts_every_pair(spark):
    """Values per replicate against all pairs, with ties, a hot score, an id that is null and a lone class."""
    import hashlib
    import random

    rnd = random.Random(4)
    rows = [(i, rnd.choice([0.5, rnd.random(), round(rnd.random(), 1)]), rnd.randrange(2)) for i in range(300)]
    rows += [(1000 + i, 0.25, i % 3 % 2) for i in range(300)] + [(None, 0.7, 1), (2000, None, 1), (2001, 0.3, None)]
    df = spark.createDataFrame(rows, "id long, score double, y int").repartition(5)
    steps = evaluate.poisson_steps()

    def weight(i, r):
        key = "-".join(str(x) for x in (42, i, r) if x is not None)
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        return sum(u > s for s in steps)

    for r in (1, 7, 12):
        known = [(s, y, weight(i, r)) for i, s, y in rows if s is not None and y is not None]
        pos, neg = ([(s, w) for s, y, w in known if y == k and w] for k in (1, 0))
        pairs = sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg)
        want = pairs / (sum(w for _, w in pos) * sum(w for _, w in neg))
        got = {x["replicate"]: x["value"] for x in evaluate.bootstrap_auc_values(df, "id", 12).collect()}
        assert abs(got[r] - want) < 1e-12
        brier = {x["replicate"]: x["value"] for x in evaluate.bootstrap_brier_values(df, "id", 12).collect()}
        assert abs(brier[r] - sum(w * (s - y) ** 2 for s, y, w in known) / sum(w for *_, w in known)) < 1e-12
    lone = evaluate.bootstrap_auc_values(df.where("y = 1"), "id", 3).collect()
    assert len(lone) == 3 and all(x["value"] is None for x in lone)
    assert evaluate.bootstrap_auc_values(df.where("false"), "id", 3).count() == 0
