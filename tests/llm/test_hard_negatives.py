"""Hard negatives against brute force: clusters, ties, copies, odd vectors, certified stops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.llm import hard_negatives as mine

SCHEMA = "vec_id long, embedding array<float>, label int"
FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def by_hand(rows, every=100):
    held = []
    width = max((len(e) for _, e, _ in rows if e is not None), default=0)
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in e]
        if sum(x * x for x in q) < (1 << 28) ** 2:
            held.append((i, label, q + [0] * (width - len(q))))
    out, asked = [], set()
    for i, label, q in held:
        if i % every or (i, label, tuple(q)) in asked:
            continue
        asked.add((i, label, tuple(q)))
        scored = [(-sum(a * b for a, b in zip(q, r, strict=True)), k, tag) for k, tag, r in held]
        for less, k, _ in sorted(x for x in scored if x[2] == label and x[1] != i)[:5]:
            fit = sorted(x for x in scored if x[2] != label and -80 * less <= -100 * x[0] <= -100 * less)[:5]
            out += [(i, k, r, n, -less, -s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def got(spark, rows, extra=(), **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return sorted(tuple(r[f] for f in FIELDS) for r in mine.hard_negatives(df, **more).collect())


def clustered(n, dims, seed, spread=0.2):
    rng = np.random.Generator(np.random.PCG64(seed))
    middles = rng.normal(size=(6, dims))
    at = rng.integers(0, 6, n)
    x = (middles[at] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("dims", [64, 5, 1])
def test_against_brute_force(spark, dims, monkeypatch):
    for name, value in {"SAMPLE": 64, "CELL": 8, "PART_LEAST": 40, "QUERIES": 3, "TILE": 16}.items():
        monkeypatch.setattr(mine, name, value)
    rows = clustered(500, dims, dims)
    want = by_hand(rows, 10)
    assert want and got(spark, rows, every=10, extra=("key", "v", "part", "i", "lo", "rank", "x", "vec")) == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mine, "PART_LEAST", 16)
    rows = clustered(150, 4, 7)
    copy = rows[3][1]
    rows += [(1000 + k, copy, 1) for k in range(80)] + [(2000 + k, copy, 2) for k in range(40)]  # ties by the dozen
    rows += [(300, copy, 1), (300, copy, 1), (300, rows[5][1], 2), (7, copy, 1), (7, copy, 1)]  # repeated ids
    rows += [(400, None, 1), (500, copy, None), (None, copy, 1), (600, [1.0, None, 0.0, 0.0], 1), (700, [float("nan")] * 4, 1),
             (800, [float("inf"), 0.0, 0.0, 0.0], 2), (900, [], 1), (1100, [0.5], 2), (1200, [1e30, 0.0, 0.0, 0.0], 1), (1300, [-1.0, -1.0, -1.0, -1.0], 9)]
    rows += [(-100, [30000.0, 20000.0, -4000.5, 1.0], 1), (-101, [29000.0, 20000.0, 0.0, 1.0], 1), (-102, [28000.0, 19000.0, 0.0, 1.0], 2)]
    want = by_hand(rows)
    assert want and got(spark, rows) == want


def test_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, [1.0], 1)]) == []
    assert got(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 0), (3, [0.7], 0), (4, [1.1], 0)]) == [(100, 1, 1, 2, 65536, 58880)]


def test_heap_falls_and_bounds_hold():
    rng = np.random.Generator(np.random.PCG64(3))
    rows = rng.integers(-200, 200, (400, 7))
    codes = mine.fitted(rows[:100], 5)
    at = codes.nearest(rows)
    for k, half in enumerate(codes.halves(rows)):
        for c in range(len(codes.books[k])):
            own = half[at[k] == c]
            if len(own):
                codes.radius[k][c] = math.ceil(np.sqrt(((own - codes.books[k][c]) ** 2).sum(axis=1).max()))
                codes.longest[k][c] = math.ceil(np.sqrt((own**2).sum(axis=1).max()))
    q = rng.integers(-200, 200, (20, 7))
    first, second = codes.bounds(q)
    assert ((first[:, at[0]] + second[:, at[1]]) >= q @ rows.T).all()
    for k in range(20):
        seen = list(mine.multi_sequence(first[k], second[k]))
        assert len({(i, j) for _, i, j in seen}) == len(seen) == first.shape[1] * second.shape[1]
        assert [b for b, _, _ in seen] == sorted((b for b, _, _ in seen), reverse=True)
        assert all(b == first[k, i] + second[k, j] for b, i, j in seen)


def test_certified_stop_leaves_cells_unvisited(spark, monkeypatch):
    """On separate clusters most parts are never asked, and the result is whole."""
    monkeypatch.setattr(mine, "CELL", 8)
    monkeypatch.setattr(mine, "PART_LEAST", 20)
    rows = clustered(600, 16, 11, spread=0.02)
    asked = []
    plain = mine._visits
    monkeypatch.setattr(mine, "_visits", lambda *a: asked.append(plain(*a)) or asked[-1])
    assert got(spark, rows) == by_hand(rows)
    parts = -(-600 // 20)
    assert all(0 < v.count() <= 0.6 * 6 * parts for v in asked)
