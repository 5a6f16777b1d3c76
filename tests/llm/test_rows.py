"""Operators that judge a text on its own, or by counts: brute force and edge rows."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daygrid.llm import language_model, licenses, line_dedup, quality_rules, resampling, sanitise, warc

EDGES = [(1, None), (2, ""), (3, "   \n\t"), (4, "a b c"), (4, "a b c"), (None, "no id here at all"), (5, "word " * 3000), (6, "é ß Σ\x00 ﬁ")]
EXTRA = ("kept", "n_words", "spans", "_row", "score", "seed", "line")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# line dedup -------------------------------------------------------------------------------

def lines_by_hand(rows):
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 10:
                owner[k] = min(owner.get(k, i), i, key=lambda x: (x is None, x or 0))
    out = []
    for i, t in rows:
        keep = [x for x in (t or "").split("\n") if (k := lower(x.strip(" \t\n\x0b\x0c\r"))) not in owner or owner[k] == i]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(keep), "\n".join(keep)))
    return collections.Counter(out)


LINES = [(1, "Alpha beta gamma\nshort\nAlpha beta gamma"), (2, "  ALPHA BETA GAMMA\t\nown line here\nshort"), (3, "own line here\r\n\n"),
         (3, "another text under id three\nALPHA beta gamma"), (7, "x" * 50 + "\n" + "É" * 10 + "\n" + "é" * 10), (8, "É" * 10)]


@pytest.mark.parametrize("rows", [LINES, LINES + EDGES, EDGES, []])
def test_lines(make, rows):
    docs = make(rows, extra=EXTRA)
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    got = collections.Counter((r["doc"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in done.collect())
    assert got == lines_by_hand(rows)
    left = line_dedup.dedup_lines(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(n for (_, lines, dropped, _), n in lines_by_hand(rows).items() if dropped < lines)


def test_bitmap_is_runs(make):
    docs = make([(1, "a line of text 1\na line of text 2\na line of text 3"), (2, "own line 0123\na line of text 2\nown line 4567\nown line 89ab")])
    row = line_dedup.keep_bitmaps(docs).collect()
    assert [(r["_id"], [tuple(x) for x in r["keep"]]) for r in row] == [(2, [(0, 1), (2, 2)])]


def test_heavy_line_is_spread(make):
    rows = [(i, f"the same heavy line\nown {i} line of text") for i in range(300)]
    docs = make(rows)
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    assert done.where("n_dropped = 0").count() == 1 and done.where("n_dropped = 1").count() == 299


# warc -------------------------------------------------------------------------------------

def test_archives(spark):
    big, other = "B" * 1500, "O" * 1200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nü"
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (7, "u", other), (7, "u", other), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    source = warc.archive_pages(pages)
    raw = warc.read_archives(spark, source).collect()
    assert collections.Counter((r["page_id"], r["payload"].decode()) for r in raw) == collections.Counter((i, h or "") for i, _, h in rows)
    got = collections.Counter(tuple(r) for r in warc.archived(spark, warc.deduplicated_archives(spark, source)).collect())
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        top = max(j for j, _, g in rows if g == h and j is not None) if len(b) >= 1000 else i
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "response" if i == top else "revisit", None if i == top else top)] += 1
    assert got == want


def test_revisits_of_the_input_are_resolved(spark):
    rows = [(1, "u", "revisit", None, "d1", 2000, None), (2, "u", "response", None, "d1", 2000, b"x" * 2000), (3, "u", "revisit", 9, "d9", 10, None)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, warc.SCHEMA)).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 9)]


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rows = warc.resolve_revisits(spark.createDataFrame([], warc.SCHEMA))
    assert rows.count() == 0
    assert warc.archived(spark, warc.deduplicated_archives(spark, warc.archive_pages(pages))).count() == 0


# licenses ---------------------------------------------------------------------------------

def license_by_hand(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words))
          if words[i : i + len(p.split())] == p.split()]
    places = sorted(i for i, _ in at)
    return len(words), len(at), places[0] if at else None, places[-1] if at else None, ",".join(sorted({x for _, x in at}))


TEXTS = ["Under CC BY-NC 4.0. cc by cc, by", "GNU General Public License, version 3; all rights reserved. ALL RIGHTS RESERVED!", "ccby cc é by",
         "x SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nmore", "SPDX-License-Identifier: MIT OR", None, ""]


def test_licenses(make):
    rows = list(enumerate(TEXTS)) + EDGES
    got = licenses.scan_licenses(make(rows, extra=EXTRA)).collect()
    assert collections.Counter((r["doc_id"], *[r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")]) for r in got) == \
        collections.Counter((i, *license_by_hand(t)) for i, t in rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] == 3 and r["expressions"]}
    assert by[3]["labels"] == "apache-2.0,gpl-2.0-only,mit" and by[3]["permitted"] is False
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan_licenses(make([])).count() == 0


@given(st.text(alphabet="cby generalpublicliceseallrightsreserved .-\n", max_size=120))
@settings(max_examples=150, deadline=None)
def test_license_scan_of_any_text(text):
    r = licenses.Scanner().scan(text)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_by_hand(text)


@pytest.mark.parametrize("text, rpn, met", [
    ("mit or gpl-3.0 and x", "mit gpl-3.0 x and or", True), ("(mit or gpl-3.0) and x", "mit gpl-3.0 or x and", False),
    ("a with e and mit", "a e with mit and", False), ("mit with e", "mit e with", True),
    ("and mit", None, None), ("(mit", None, None), ("mit)", None, None), ("mit mit", None, None), ("", None, None), ("()", None, None)])
def test_expressions(text, rpn, met):
    found = licenses.postfix(text)
    assert (" ".join(found) if found else None) == rpn
    if found:
        assert licenses.evaluate(found)[0] is met


# personal data ----------------------------------------------------------------------------

def spans_by_hand(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PERSONAL = "é a.b@c.de, x@y.z@w.v @q.r 10.0.0.255 1.2.3.256 1.2.3.4.5 4316522678525456 4316 5226 7852 5457 +1 (663) 555-6869 +12 3"


@given(st.text(alphabet="ab@.-+0123456789 ()é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_patterns(text):
    assert sanitise.base_spans(text) == spans_by_hand(text)
    assert sanitise.base_spans(PERSONAL + text + PERSONAL) == spans_by_hand(PERSONAL + text + PERSONAL)


def test_terms_that_disclose(make):
    rows = [(i, f"mail kilroy{i % 2} zanzibar to joe@ex.org common today") for i in range(6)]
    rows += [(100 + i, f"common words {i} today and to mail everybody else") for i in range(60)]
    got = {r["doc_id"]: (r["base"], r["spans"]) for r in sanitise.find_personal_data(make(rows, extra=EXTRA)).collect()}
    text = rows[0][1]
    at = text.index("zanzibar")
    assert (at, 5, at + 8) in [tuple(s) for s in got[0][1]]
    assert not any(text[s["start"]:s["end"]] in ("common", "today", "mail") for s in got[0][1])
    assert got[100] == ([], [])
    clean = sanitise.redact(text, [tuple(s) for s in got[0][1]])
    assert "[EMAIL]" in clean and "zanzibar" not in clean and "common" in clean
    assert sanitise.redact(None, []) is None


def test_values_of_one_document_have_terms_too(make):
    rows = [(i, f"write to person{i} at own{i}@ex{i}.org common today") for i in range(8)]
    rows += [(100 + i, f"write common words {i} to and at today") for i in range(60)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in sanitise.find_personal_data(make(rows, extra=EXTRA)).collect()}
    for i, text in rows[:8]:
        assert [text[a:b] for a, _, b in got[i]] == [f"person{i}", f"own{i}@ex{i}.org"]


def test_terms_anywhere_in_the_document(make):
    filler = " ".join(f"word{k}" for k in range(200))
    rows = [(i, f"from kilroy with love {filler} Kilroy wrote {filler} reach me at joe@ex.org now kilroy") for i in range(5)]
    rows += [(100 + i, f"from somebody with love {filler} wrote {filler} reach me at now {i}") for i in range(60)]
    got = {r["doc_id"]: [(rows[r["doc_id"]][1][a:b], k) for a, k, b in map(tuple, r["spans"])] for r in
           sanitise.find_personal_data(make(rows, extra=EXTRA)).collect() if r["doc_id"] < 100}
    rank = 5 if math.log2((5 + 0.45 * 5 / 65) / (5.45 * 5 / 65)) / math.log2(65 / 5) >= sanitise.REMOVE else 4
    assert all(got[i] == [("kilroy", rank), ("Kilroy", rank), ("joe@ex.org", 0), ("kilroy", rank)] for i in range(5))


def test_disclosures_by_hand(make):
    words = [f"t{k}" for k in range(12)]
    texts = [" ".join(w for k, w in enumerate(words) if (i * 7 + k * k) % (k + 2) == 0) for i in range(40)]
    mails = {e: [i for i in range(40) if i % m == r] for e, m, r in (("a@x.org", 40, 0), ("b@x.org", 17, 3), ("c@x.org", 5, 1), ("d@x.org", 2, 0))}
    rows = [(i, " ".join([t, *(e for e, own in mails.items() if i in own)])) for i, t in enumerate(texts)]
    want = {i: {} for i in range(40)}
    for e, own in mails.items():
        rate = len(own) / 40
        for w in words:
            df = sum(w in t.split() for t in texts)
            net = sum(w in texts[i].split() for i in own)
            share = math.log2((net + 0.45 * rate) / ((df + 0.45) * rate)) / -math.log2(rate) if net else 0
            for i in own:
                if share >= 0.8 and w in texts[i].split():
                    want[i][w] = max(want[i].get(w, 0), 5 if share >= 0.97 else 4)
    got = sanitise.find_personal_data(make(rows)).collect()
    assert sum(map(len, want.values())) > 3
    for r in got:
        text = rows[r["doc_id"]][1]
        assert {text[a:b]: k for a, k, b in map(tuple, r["spans"]) if k > 3} == want[r["doc_id"]]


def test_many_terms_take_the_other_way(make, monkeypatch):
    rows = [(i, "zanzibar joe@ex.org common") for i in range(4)] + [(50 + i, f"common {i}") for i in range(40)]
    few = sorted(map(str, sanitise.find_personal_data(make(rows)).collect()))
    monkeypatch.setattr(sanitise, "TERM_LIST", 0)
    assert sorted(map(str, sanitise.find_personal_data(make(rows)).collect())) == few


def test_personal_edges(make):
    assert sanitise.find_personal_data(make(EDGES, extra=EXTRA)).where("size(spans) = 0").count() == len(EDGES)
    assert sanitise.find_personal_data(make([])).count() == 0


# quality rules ----------------------------------------------------------------------------

def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@given(st.text(alphabet="ab é#|\n\t\x0b", max_size=80))
@settings(max_examples=300, deadline=None)
def test_counts(text):
    data = text.encode()
    from daygrid.llm.text import doc_words

    assert quality_rules.measure(data, next(doc_words([data], lower=False)))[:5] == counts_by_hand(text)


def test_quality(make):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(200)]
    rows += [(1000, " ".join(f"a{j}### b{j}*** $%&" for j in range(20))), (1001, "one two three four five " * 20)] + EDGES
    got = {r["doc_id"]: r for r in quality_rules.judge(make(rows, extra=("kept", "docs", "feature"))).collect()}
    assert all(got[i]["kept"] for i in range(7, 200))
    assert not got[1000]["kept"] and not got[1000]["base_failed"]
    assert got[1001]["base_failed"] and not got[1001]["kept"]
    docs = make(rows, extra=("kept", "docs", "feature"))
    left = quality_rules.keep_good(docs)
    assert left.columns == docs.columns and left.where("doc_id between 7 and 199").count() == 193
    assert quality_rules.judge(make([])).count() == 0


# language model ---------------------------------------------------------------------------

def test_language_model(make, spark):
    rows = [(i, " ".join(["the", f"cat{i % 3}", "sat", "on", "a", f"mat{i % 5}"] * (1 + i % 4))) for i in range(120)] + EDGES
    got = language_model.score_texts(make(rows, extra=EXTRA)).collect()
    train = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 != 2
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [None]
    c = collections.Counter(w for i, t in rows if train(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in rows:
        w = tokens(t)
        want[(i, not train(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # held-out likelihood beats the base model
    assert all(r["score"] < 0 for r in got)
    assert language_model.score_texts(make([])).count() == 0


def test_probabilities_are_normalised():
    import numpy as np

    u = np.full(20, 1 / 20)
    m = language_model.LogBilinear.start(u, 4)
    draw = np.random.default_rng(3)
    y = draw.integers(0, 20, 5000)
    m.train(np.roll(y, 1), np.roll(y, 2), y, u, draw)
    one, two, norm = m.tables()
    p = np.exp(one[:, None, :] + two[None, :, :] - norm[:, :, None])
    assert np.allclose(p.sum(axis=2), 1)


# importance resampling --------------------------------------------------------------------

def test_resampling(make, spark):
    good = [(i, " ".join(f"fine{(i * j) % 7} prose{j % 3}" for j in range(30))) for i in range(60)]
    bad = [(100 + i, " ".join(f"junk{(i * j) % 7}%% spam{j % 3}!!" for j in range(30))) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in resampling.resample(make(good + bad, extra=EXTRA), labels, share=0.6).collect()}
    assert sum(r["kept"] for r in got.values()) == 60 and all(got[i]["kept"] for i, _ in good)
    ranked = sorted(got.values(), key=lambda r: -r["key"])
    assert all(r["kept"] for r in ranked[:60]) and not any(r["kept"] for r in ranked[60:])
    assert resampling.resample(make(EDGES), labels.limit(0)).where("kept").count() == len(EDGES)
    assert resampling.resample(make([]), labels).count() == 0


def test_toxic_labels_weigh(make, spark):
    prose = lambda i: " ".join(f"fine{(i * j) % 7} prose{j % 3}" for j in range(30))
    spoilt = lambda i: " ".join("vile" if k % 6 == 5 else w for k, w in enumerate(prose(i).split()))
    rows = [(i, prose(i)) for i in range(40)] + [(100 + i, spoilt(i)) for i in range(40)]
    rows += [(1000 + i, " ".join(f"plain{i * j % 50} vile" if j == 7 else f"plain{i * j % 50}" for j in range(60))) for i in range(300)]
    good = [(i, 1, 0) for i in range(20)]
    toxic = [(100 + i, 1, 1) for i in range(20)]
    weights = []
    for marked in (good, good + toxic):
        labels = spark.createDataFrame(marked, "doc_id long, quality int, toxic int")
        weights.append({r["doc_id"]: r["log_weight"] for r in resampling.resample(make(rows), labels, share=0.5).collect()})
    without, with_toxic = weights
    mean = lambda w, ids: sum(w[i] for i in ids) / len(ids)
    fall = {k: mean(without, ids) - mean(with_toxic, ids) for k, ids in (("good", range(20, 40)), ("toxic", range(120, 140)))}
    assert fall["toxic"] > fall["good"] + 0.5  # of documents without a label


@given(st.lists(st.integers(-10**12, 10**12), min_size=1, max_size=30), st.integers(1, 30))
@settings(max_examples=8, deadline=None)
def test_kth_key(spark, keys, k):
    k = min(k, len(keys))
    found = resampling.threshold(spark.createDataFrame([(x,) for x in keys], "key long"), k)
    assert found == sorted(keys, reverse=True)[k - 1]
