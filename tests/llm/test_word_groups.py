"""Grouped words of the language model: their context tells them apart, whatever their counts."""

import random
import zlib

from daygrid.llm import language_model as lm


def two_tongues(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        first, kind = (("the", "x"), ("la", "y"))[i % 2]
        rows.append((i, " ".join(f"{first} {kind}{rnd.randrange(40)}" for _ in range(25))))
    return rows


def test_swapped_rare_words_score_lower(make, monkeypatch):
    for name, value in {"CLASSES": 12, "ANCHORS": 4, "GROUPS": 8, "SIZE": 4, "BATCH": 64, "RATE": 0.3}.items():
        monkeypatch.setattr(lm, name, value)
    rows = two_tongues(400, 1)
    held = [i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    words = [f"the x{k} the x{k + 1}" for k in range(0, 30, 2)] + [f"la y{k} la y{k + 1}" for k in range(0, 30, 2)]
    right = " ".join(words)
    wrong = right.translate(str.maketrans("xy", "yx"))  # the same words, each behind the other's article
    got = {r["doc_id"]: r for r in lm.score_texts(make([*rows, (held[0], right), (held[1], wrong)])).collect()}
    a, b = (got[h] for h in held)
    assert a["n_tokens"] == b["n_tokens"] and abs(a["base_score"] - b["base_score"]) < 1e-6
    assert a["score"] > b["score"] + 5


def test_groups_follow_the_word_beside(make):
    import numpy as np

    words = ["the", "la", *[f"{k}{i}" for k in "xy" for i in range(40)]]
    hashes = np.array([int(h[0]) for h in lm.doc_words([w.encode() for w in words], lower=True)], dtype=np.uint64)
    order = np.argsort(hashes)
    role = np.array([1, 2, *[0] * 80])[order]
    named = np.array(words)[order]
    found = lm.neighbours(make(two_tongues(300, 2)), (hashes[order], role), "doc_id", "text").collect()
    anchors = {}
    for r in found:
        anchors.setdefault(named[r["word"]][0], set()).add(r["group"] % lm.ANCHORS)
    assert anchors == {"x": {0}, "y": {1}} and len(found) == 80


def test_inside_a_class_probabilities_sum_to_one(make, spark, monkeypatch):
    """Words of a class, and the share of unknown ones in the class of rare words."""
    seen = []
    plain = lm.encoded
    monkeypatch.setattr(lm, "encoded", lambda docs, top, *rest: seen.append(top) or plain(docs, top, *rest))
    for name, value in {"CLASSES": 24, "ANCHORS": 4, "GROUPS": 8}.items():
        monkeypatch.setattr(lm, name, value)
    rows = two_tongues(200, 3) + [(5000 + i, f"once{i} the x1") for i in range(30)]
    lm.score_texts(make(rows)).count()
    _, counts, classes, inside = seen[0]
    sums = {}
    for k, p in zip(classes, 10.0**inside, strict=True):
        sums[int(k)] = sums.get(int(k), 0.0) + p
    rare = sums.pop(lm.RARE)
    known = counts[classes == lm.RARE]
    assert abs(rare + lm.DISCOUNT * len(known) / known.sum() - 1) < 1e-9
    assert all(abs(v - 1) < 1e-9 for v in sums.values()) and len(sums) > 3
