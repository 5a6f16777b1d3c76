"""Groups of near copies: rows that the walk makes grow with the group, and no link is lost."""

import random

import numpy as np

from daygrid.llm import near_dedup

WORDS = [f"w{i}" for i in range(20_000)]


def group(rnd, n, changed, partners):
    """``n`` texts with changes of their own to one text, and partners close to the first of them."""
    base = [rnd.choice(WORDS) for _ in range(200)]

    def altered(words, times):
        out = list(words)
        for _ in range(times):
            out[rnd.randrange(200)] = rnd.choice(WORDS)
        return out

    own = [altered(base, changed) for _ in range(n)]
    return [" ".join(t) for t in own + [altered(t, 9) for t in own[:partners]]]


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)}


def loose(spark, texts, monkeypatch):
    """Loose components, and the rows that the levels of the trees made."""
    plain, made = near_dedup.durable, []
    monkeypatch.setattr(near_dedup, "durable", lambda df, name="table": (lambda o: made.append(o.count()) or o if name in ("nodes", "walked") else o)(plain(df, name)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = plain(near_dedup.fingerprints(docs, "doc_id", "text", 2).selectExpr("doc_id AS rep", "n", "sketch"), "reps")
    names = {r["id"]: r["component"] for r in near_dedup.components(near_dedup.loose_links(reps)).collect()}
    monkeypatch.setattr(near_dedup, "durable", plain)
    return names, sum(made)


def test_walked_rows_grow_with_the_group(spark, monkeypatch):
    rnd = random.Random(9)
    made = {n: loose(spark, group(rnd, n, 28, 0), monkeypatch)[1] for n in (1000, 2000, 4000)}
    assert made[2000] > 20 * 2000  # the groups are large enough to branch
    assert made[4000] <= 2.2 * made[2000]
    # a tree's root, its branches and the link to a hub, once every document's nodes are large
    assert all(rows <= near_dedup.TREES * (2 + near_dedup.BRANCHES) * n for n, rows in made.items())


def test_links_inside_a_loose_group_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 60)
    texts = group(random.Random(8), 900, 40, 150)
    names, _ = loose(spark, texts, monkeypatch)
    similar = [(k, 900 + k) for k in range(150)
               if 100 * len(shingles(texts[k]) & shingles(texts[900 + k])) >= 80 * len(shingles(texts[k]) | shingles(texts[900 + k]))]
    assert len(similar) > 100
    assert all(names.get(u, u) == names.get(v, v) for u, v in similar)
    assert len({names.get(k, k) for k in range(900)}) > 300  # not because all became one


def test_large_nodes_are_profiled_by_all_members(spark, monkeypatch):
    """What is common in a large node is counted exactly, over any number of chunks, and its
    hubs are the most central of all members."""
    rng = np.random.Generator(np.random.PCG64(5))
    size = {7: 3200, -8: 700}
    rows, want, hubs = [], {}, {}
    for node, n in size.items():
        lanes = rng.integers(100, 60_000, (n, near_dedup.LANES)).astype(np.uint16)
        lanes[: n // 16 + 1, 0] = 5  # just common, and just not
        lanes[: n // 16 - 1, 1] = 6
        lanes[n // 2 :, 1] = 8
        lanes[rng.permutation(n)[: n // 10], 2:40] = 7
        lanes[n - 4 :, :40] = 7
        lanes[n - 4 :, 0] = 5
        reps = rng.permutation(n) + (10_000 if node < 0 else 0)
        rows += [(node, n, int(r), int(r), bytearray(x.tobytes())) for r, x in zip(reps, lanes, strict=True)]
        common = []
        for lane in range(near_dedup.LANES):
            token, hits = np.unique(lanes[:, lane], return_counts=True)
            often = token[near_dedup.COMMON * hits >= n]
            common.append(set(often.tolist()) or {int(token[hits.argmax()])})
        usual = [sum(int(t) in common[k] for k, t in enumerate(x)) for x in lanes]
        want[node] = common
        hubs[node] = [int(r) for _, r in sorted(zip([-u for u in usual], reps, strict=True))[: near_dedup.HUBS]]
    table = near_dedup.durable(spark.createDataFrame(rows, "node long, n long, rep long, label long, sketch binary").repartition(5))
    for chunk in (1 << 14, 300):
        monkeypatch.setattr(near_dedup, "CHUNK", chunk)
        got = {r["node"]: r for r in near_dedup._profiles(table, len(rows)).collect()}
        assert set(got) == set(size)
        for node, r in got.items():
            tokens = np.frombuffer(r["common"], np.uint16).reshape(near_dedup.LANES, near_dedup.COMMON)
            assert [set(t.tolist()) for t in tokens] == want[node] and r["size"] == size[node]
            assert 5 in want[node][0] and 6 not in want[node][1]
            assert r["hub_reps"] == r["hub_labels"] == hubs[node] and len(r["hubs"]) == 2 * near_dedup.LANES * near_dedup.HUBS
