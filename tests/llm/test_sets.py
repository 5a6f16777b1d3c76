"""Near-duplicates, decontamination, packing and the pipeline against brute force."""

import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from daygrid.llm import decontaminate, graph, near_dedup, packing
from daygrid.llm.queries import QUERIES, SQL, word_vocabulary

EDGES = [(901, None), (902, ""), (903, "  \n"), (904, "one"), (905, "ONE "), (906, "tail " * 4000), (None, "lost row of words"), (None, None)]
EXTRA = ("component_id", "rep", "n", "u", "node", "sequence_id", "item", "text_bytes")
WORDS = [f"w{i}" for i in range(400)]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components_by_hand(rows, width):
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def corpus(seed=5):
    rnd, rows = random.Random(seed), []
    base = [[rnd.choice(WORDS) for _ in range(120)] for _ in range(12)]
    for g, words in enumerate(base):
        for _ in range((1, 2, 3, 40)[g % 4]):
            own = list(words)
            for _ in range(rnd.randrange(0, 9)):
                own[rnd.randrange(len(own))] = rnd.choice(WORDS)
            rows.append((len(rows), " ".join(own).upper() if rnd.random() < 0.1 else "  ".join(own)))
    rows += [(500 + i, rows[i][1]) for i in range(10)]
    return rows + [(600, "one two three"), (601, "one  two\tthree"), (602, "one two")]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(make, width):
    rows = corpus() + EDGES
    got = near_dedup.near_duplicates(make(rows, extra=EXTRA), width=width).collect()
    want = components_by_hand(rows, width)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == collections.Counter((i, len(shingles(t, width))) for i, t in rows)


def test_branching_and_tiles(make, monkeypatch):
    """Small leaves and blocks: deep trees and the exhaustive confirmation come to the same."""
    monkeypatch.setattr(near_dedup, "LEAF", 3)
    monkeypatch.setattr(near_dedup, "DEPTH", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 700)
    rows = corpus(8)
    got = near_dedup.near_duplicates(make(rows), width=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_by_hand(rows, 2)


def test_rows_that_share_an_id(make):
    a, b, c = (" ".join(WORDS[k : k + 30]) for k in (0, 100, 200))
    got = near_dedup.near_duplicates(make([(1, a), (2, b), (3, a), (3, b), (4, c), (4, c)]), width=2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert near_dedup.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("finish", [0, 10**6])
def test_components(spark, finish):
    rnd = random.Random(2)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        x, y = root(u), root(v)
        up[max(x, y)] = min(x, y)
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5), finish).collect()}
    assert got == {(x, root(x)) for e in edges for x in e if root(x) != x}


# decontamination --------------------------------------------------------------------------

def edits_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def changed(rnd, text, n):
    s = list(text)
    for _ in range(n):
        k = rnd.randrange(len(s))
        s[k : k + 1] = rnd.choice([[], ["q"], [s[k], "z"]])
    return "".join(s)


def test_decontamination(make, spark):
    rnd = random.Random(4)
    item = lambda: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(14, 40)))
    items = [(i, item()) for i in range(8)] + [(8, "short"), (9, None), (10, "")]
    rows = []
    for i in range(60):
        parts = [item(), item()]
        if i % 3:
            name, text = items[i % 8]
            text = changed(rnd, text, rnd.randrange(0, int(len(text) * 0.14)))
            parts.insert(rnd.randrange(3), text.upper() if i % 5 == 0 else text.replace(" ", "\n", 1))
        rows.append((i, " ".join(parts)))
    rows += [(100, "a short one"), (101, items[0][1]), *EDGES]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated_regions(make(rows, extra=EXTRA), benchmark).collect()
    norm = lambda s: "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in s or "")
    want = set()
    for d, t in rows[:-len(EDGES)]:
        for i, x in items[:8]:
            if edits_inside(norm(x), norm(t)) <= decontaminate.edit_budget(len(x)):
                want.add((d, i))
        if "short" in t:
            want.add((d, 8))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    texts, names = dict(rows), dict(items)
    for r in got:
        region = norm(texts[r["doc_id"]])[r["start"] : r["end"]]
        assert edits_inside(norm(names[r["item_id"]]), region) == r["edits"] or r["item_id"] == 8
    docs = make(rows, extra=EXTRA)
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(rows) - len({d for d, _ in want})
    assert decontaminate.contaminated_regions(make([]), benchmark).count() == 0
    assert decontaminate.contaminated_regions(docs, benchmark.limit(0)).count() == 0


def test_items_in_blocks(make, spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} with some words of its own {i * 37}") for i in range(9)], "item_id long, text string")
    rows = [(i, f"before item number {i} with some words of its own {i * 37} after") for i in range(9)]
    whole = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated_regions(make(rows), items).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 120)
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated_regions(make(rows), items).collect()} == whole


def test_capitals_of_all_letters(make, spark):
    items = ["le bébé près de la forêt a été réveillé très tôt par des élèves âgés, où ça ? à Orléans, dès février",
             "ÀÉÎÕÜ straße größer łódź žluťoučký kůň Ελλάδα ο λόγος της ΝΊΚΗΣ ёлка жёлтый İstanbul ısı"]
    rows = [(0, f"before {items[0].upper()} after"), (1, items[0]), (2, "X " + items[1].lower().replace("i̇", "İ")),
            (3, "".join(c.upper() if len(c.upper()) == 1 else c for c in items[1])), (4, items[0].replace("é", "e").replace("è", "e"))]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["end"], r["edits"]) for r in decontaminate.contaminated_regions(make(rows), benchmark).collect()}
    a, b = map(len, items)
    assert got == {(0, 0, 7, 7 + a, 0), (1, 0, 0, a, 0), (2, 1, 2, 2 + b, 0), (3, 1, 0, b, 0)}


def test_a_tenth_of_an_item_may_differ(make, spark):
    rnd = random.Random(7)
    item = "".join(rnd.choice("etaoinshr ") for _ in range(198)).join("xx")
    spoil = lambda n: "".join("0" if k in set(range(5, 10 * n, 10)) else c for k, c in enumerate(item))
    rows = [(n, f"some words {spoil(n)} and others") for n in (0, 16, 17, 20)] + [(21, f"{spoil(20).replace('x', '0', 1)} and others")]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(r["doc_id"], r["edits"]) for r in decontaminate.contaminated_regions(make(rows), benchmark).collect()}
    assert got == {(0, 0), (16, 16), (17, 17), (20, 20)}


# packing ----------------------------------------------------------------------------------

def check_pieces(rows, texts, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_vocabulary())
    tokenizer.encode_special_tokens = True
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in texts]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.Counter()
    for i, x in ids:
        want[i] += len(x)
    assert {d: sum(r["length"] for r in p) for d, p in by_doc.items()} == dict(want)
    single = {i: x for i, x in ids if sum(j == i for j, _ in ids) == 1}
    for d, x in single.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x)
            assert r["ids_crc32"] == zlib.crc32(np.array(x[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
    odd = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        if at != window:
            odd.append(at)
    assert len(odd) == len(set(odd)) and all(n & (n - 1) == 0 for n in odd)


@pytest.mark.parametrize("rows", [corpus() + EDGES, EDGES, [(1, None)], [(i, " ".join(WORDS[i : i + 9])) for i in range(200)]])
def test_packing(make, rows):
    found = packing.pack(make(rows, extra=EXTRA), word_vocabulary(), window=256).collect()
    check_pieces(found, rows, 256)


def test_packing_nothing(make):
    assert packing.pack(make([]), word_vocabulary(), with_ids=True).count() == 0


@given(st.lists(st.text(alphabet="abÉéİß!?'12 \n\tΣςﬁ", max_size=25), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_word_tokenizer(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_vocabulary())
    got = packing.WordTokenizer(word_vocabulary()).encode([t.encode() for t in texts], 2)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_least_squares_uses_the_histogram():
    have = np.zeros(65, dtype=np.int64)
    have[[10, 54, 20, 24, 5]] = [30, 30, 12, 12, 3]
    rows = packing.combinations(64, have + (np.arange(65) == 0))
    times = packing.repeats(rows, packing.least_squares(rows, have), have)
    used = np.zeros(65, dtype=np.int64)
    for row, n in zip(rows, times, strict=True):
        assert sum(row) == 64
        for size in row[row > 0]:
            used[size] += n
    assert (used <= have).all() and used[10] >= 28


# pipeline and registration ----------------------------------------------------------------

def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder).cache()
        assert after.columns == docs.columns, name
        assert after.count() <= before.count() and after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    good = docs.join(spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0"), "doc_id").select("doc_id")
    assert before.join(good, "doc_id").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, folder).collect()
    check_pieces(pieces, [(r["doc_id"], r["text"]) for r in before.collect()], 4096)


def test_queries_are_registered():
    import __spark_entry__

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
