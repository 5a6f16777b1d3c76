"""Table 1 on normal, skewed, constant and one-sided variables: the parts agree with the single tests."""

import numpy as np
import pytest

from daygrid.operators import stats


def test_continuous_rows_agree_with_the_single_tests(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    n = 400
    normal, skewed = rng.normal(3, 2, n), np.round(rng.exponential(4, n), 1)
    rows = [(("a", "b", "other")[i % 3], float(normal[i]), float(skewed[i]) if i % 7 else None, 2.0, 1.5 * i if i % 3 == 0 else None, None) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, normal double, skewed double, flat double, lone double, none double")
    names = ["normal", "skewed", "flat", "lone", "none"]
    got = {r["variable"]: r for r in stats.baseline_table(df, "g", ["a", "b"], names, []).collect()}
    assert set(got) == {"normal", "skewed", "flat", "lone"}
    flags = {r["variable"]: r["is_normal"] for r in stats.normality(df.where("g <> 'other'"), names).collect()}
    t = {r["variable"]: r["p_value"] for r in stats.t_test(df, names, "g", ["a", "b"]).collect()}
    u = {r["variable"]: r["p_value"] for r in stats.mann_whitney(df, names, "g", ["a", "b"]).collect()}
    assert flags["normal"] and not flags["skewed"]
    for name, row in got.items():
        assert row["test"] == ("t" if flags[name] else "mann_whitney")
        want = (t if flags[name] else u)[name]
        assert row["p_value"] == (pytest.approx(want) if want is not None else None)
    parts = {"overall": ("a", "b"), "group_1": ("a",), "group_2": ("b",)}
    for column, levels in parts.items():
        v = np.array([r[1] for r in rows if r[0] in levels])
        assert got["normal"][column] == f"{v.mean():.1f} ± {v.std(ddof=1):.1f}"
        v = np.array([r[2] for r in rows if r[0] in levels and r[2] is not None])
        q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        seen = [float(x) for x in got["skewed"][column].replace("(", "").replace(")", "").replace("-", " ").split()]
        assert seen == pytest.approx([med, q1, q3], abs=0.0501)
    assert got["lone"]["group_1"] is not None and got["lone"]["group_2"] is None


def test_normal_variables_are_not_ordered(spark):
    """Without a variable to rank, the ordering pass meets no row."""
    rng = np.random.Generator(np.random.PCG64(6))
    df = spark.createDataFrame([("ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(0, 1, 300))], "g string, v double")
    row = stats.baseline_table(df, "g", ["a", "b"], ["v"], []).first()
    assert row["test"] == "t" and "±" in row["overall"] and 0 <= row["p_value"] <= 1
