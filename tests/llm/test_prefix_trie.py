"""The prefix trie against a brute-force trie: shared and single prefixes, odd turns, small sketches."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from daygrid.llm import prefix_trie as trie

FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0, role or ""), (role or "", text or "")))
    own = {c: [x for _, x in sorted(t, key=lambda r: r[0])] for c, t in turns.items()}
    members = defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        path = tuple(own.get(base, [])[:h] + t[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path)))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        yield p
        for k in kids[p]:
            yield from under(k)

    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in who if n == len(p)))
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under(p) if q)
        out.append((min(who)[0], len(p), min(members[p[:-1]])[0] if p else None, len(who), len(kids[p]),
                    sum(not kids[q] for q in under(p)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, n=90):
    """Blocks with shared heads, copies of whole conversations, odd roles, texts and turns."""
    rnd = random.Random(seed)
    said = ["", None, "hello  there", "a\tb c", "yes", "no more of it", "ünï code"]
    rows = []
    for c in rnd.sample(range(-30, 300), n):
        for k in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, k if k or rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None, ""]), rnd.choice(said)))
    for c in range(400, 460):
        rows += [(c, k, "user", f"copy {k}") for k in range(4)]
    rows += [(None, 0, "user", "nobody"), (500, 7, "user", "late"), (501, None, None, None)]
    rnd.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in trie.prefix_trie(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("block", "h", "g", "a", "b", "pa", "last", "alone", "n_convs", "ends"):
        df = df.withColumn(name, F.lit("x"))
    assert got(df) == by_hand(rows)


def test_tiny_sketch_only_costs_shuffle(spark, monkeypatch):
    """A sketch in which nearly everything collides proves little and changes nothing."""
    monkeypatch.setattr(trie, "SKETCH_BYTES", 192)
    rows = rows_of(3)
    assert trie.sketch_width(1000) == 256
    assert got(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_screen_never_calls_a_shared_prefix_alone(spark):
    rows = rows_of(4)
    found = trie.paths(spark.createDataFrame(rows, SCHEMA)).cache()
    width = trie.sketch_width(found.count())
    known = trie.screened(found, trie.sketch(found, width), width)
    sizes = known.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("alone").alias("alone"), F.min("depth").alias("d")).collect()
    assert not any(r["alone"] and r["n"] > 1 for r in sizes)
    assert sum(r["alone"] for r in sizes) >= 0.8 * sum(r["n"] == 1 and r["d"] > 0 for r in sizes) > 0


def test_long_conversation_over_many_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, k, "user", f"turn {k % 3}" if k < 50 else f"{c} {k}") for c in (20, 21, 25, 40, 41) for k in range(120)]
        rows += [(22, 0, "user", "x" * 5_000_000)]
        assert got(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(c, 1, "user", t) for c in (20, 40) for t in ("p", "q", "q", "r")]
    a, b = (got(spark.createDataFrame(r, SCHEMA)) for r in (rows, rows[::-1]))
    assert a == b and max(r[1] for r in a) == 4


def test_few_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)) == []
    one = [(7, 0, "user", "a b")]
    assert got(spark.createDataFrame(one, SCHEMA)) == by_hand(one)
