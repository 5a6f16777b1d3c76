"""Exact neighbours against brute force: pivots, ties, copies, odd rows, text ids."""

import math
import random

import pytest

from daygrid.operators import neighbours as N


def by_hand(rows, k):
    good = [(i, x) for i, x in rows if i is not None and x is not None and all(v is not None and not math.isnan(v) for v in x)]
    out = {}
    for i, x in good:
        ranked = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in good if j != i)
        out[i] = [(round(d, 9), j) for d, j in ranked[:k]]
    return {i: v for i, v in out.items() if v}


def got(spark, rows, k, kind="long"):
    df = spark.createDataFrame(rows, f"id {kind}, x array<double>").repartition(3)
    out = {}
    for r in sorted(N.nearest(df, k).collect(), key=lambda r: (str(r["id"]), r["rank"])):
        out.setdefault(r["id"], []).append((round(r["square"], 9), r["neighbour"]))
    return out


@pytest.mark.parametrize(("dims", "cell"), [(2, 16), (6, 40), (1, 8)])
def test_against_brute_force(spark, monkeypatch, dims, cell):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "PART", 25)
    rnd = random.Random(dims)
    middles = [[rnd.uniform(-50, 50) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [m + rnd.gauss(0, 2) for m in rnd.choice(middles)]) for i in range(500)]
    assert got(spark, rows, 5) == by_hand(rows, 5)


def test_ties_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 8)
    monkeypatch.setattr(N, "PART", 10)
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randrange(6)), float(rnd.randrange(6))]) for i in range(150)]  # a grid: ties everywhere
    rows += [(1000 + i, [2.0, 2.0]) for i in range(90)] + [(2000, [-0.0, 0.0]), (2001, [0.0, 0.0])]
    rows += [(None, [1.0, 1.0]), (3000, None), (3001, [None, 1.0]), (3002, [float("nan"), 1.0])]
    assert got(spark, rows, 4) == by_hand(rows, 4)


def test_few_rows(spark):
    assert got(spark, [], 3) == {}
    assert got(spark, [(1, [0.0])], 3) == {}
    assert got(spark, [(1, [0.0]), (2, [3.0])], 3) == {1: [(9.0, 2)], 2: [(9.0, 1)]}


def test_text_ids_have_their_true_distances(spark):
    rnd = random.Random(5)
    rows = [(f"r{i}", [rnd.random(), rnd.random()]) for i in range(80)]
    assert got(spark, rows, 5, "string") == by_hand(rows, 5)


def test_most_parts_are_left_out(spark, monkeypatch):
    """Separate clusters: a point is compared with its own and few others."""
    monkeypatch.setattr(N, "CELL", 20)
    monkeypatch.setattr(N, "PART", 20)
    plain, asked = N._met, []
    monkeypatch.setattr(N, "_met", lambda rows, *a, **k: asked.append(rows.where("query").count()) or plain(rows, *a, **k))
    rows = [(i, [1000.0 * (i % 30) + 0.01 * i, float(i % 7)]) for i in range(1200)]
    assert got(spark, rows, 3) == by_hand(rows, 3)
    assert asked[0] == 0 and asked[1] <= 8 * len(rows)
