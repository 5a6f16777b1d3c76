"""Clashing names in the stages, very long texts, many items, crowded tags."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrid.llm import decontaminate, language_model, licenses, line_dedup, near_dedup, packing, quality_rules, resampling, sanitise, sharding
from daygrid.llm.queries import word_vocabulary

NAMES = ("_lang", "_source", "__text", "__n_words", "__kept", "__gone", "gone", "__bad", "bad", "name", "doc", "symbols", "kept")


def clashing(df):
    for name in NAMES:
        df = df.withColumn(name, F.lit("own"))
    return df


def test_stages_with_clashing_names(make, spark):
    words = " ".join(f"word{i} and" for i in range(30))
    rows = [(1, words), (2, words), (3, "other " + " ".join(f"thing{i}" for i in range(25))), (None, "item text of the benchmark is here " + words), (4, "kept " + words), (4, "item text of the benchmark is here")]
    docs = clashing(make(rows))
    marks = spark.createDataFrame([(1, "item text of the benchmark is here")], "item_id long, text string")
    for stage in (quality_rules.keep_good, line_dedup.dedup_lines, near_dedup.drop_near_duplicates, lambda d: decontaminate.drop_contaminated(d, marks)):
        left = stage(docs)
        assert left.columns == docs.columns
        assert all(r[n] == "own" for r in left.collect() for n in NAMES)
    clean = [(r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(docs, marks).collect()]
    assert sorted(clean, key=str) == sorted((r for r in rows if "benchmark" not in r[1]), key=str)


@pytest.fixture(scope="module")
def long_rows():
    rng = np.random.Generator(np.random.PCG64(2))
    words = np.array([f"{chr(97 + i % 26)}{i}" for i in range(4000)])
    text = " ".join(words[rng.integers(0, 4000, 900_000)])
    assert len(text) > 4_500_000
    return [(1, text), (2, text + " tail"), (3, "short one of a few words that are all its own here")]


def test_texts_beyond_a_block(make, spark, long_rows):
    """Texts of several blocks come whole through every operator that cuts them."""
    docs = make(long_rows)
    near = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, width=2).collect()}
    assert near[2]["component_id"] == 1 and near[3]["component_id"] == 3
    words = {i: t.split() for i, t in long_rows}
    assert all(near[i]["n_shingles"] == len(set(zip(w, w[1:], strict=False))) for i, w in words.items())
    counts = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert all(counts[i]["n_words"] == len(w) and counts[i]["word_chars"] == sum(map(len, w)) for i, w in words.items())
    scored = {r["doc_id"]: r for r in language_model.score_texts(docs).collect()}
    assert all(scored[i]["n_tokens"] == len(w) + 1 for i, w in words.items())
    assert {r["doc_id"] for r in line_dedup.dedup_lines(docs).collect()} == {1, 2, 3}
    assert sharding.shard_documents(docs).count() == 3
    pieces = packing.pack(docs, word_vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r["n"] == r["all"] for r in pieces) and len(pieces) == 3
    marks = spark.createDataFrame([(5, long_rows[0][1][3_000_000:3_000_200])], "item_id long, text string")
    regions = {r["doc_id"]: (r["start"], r["end"]) for r in decontaminate.contaminated_regions(docs, marks).collect()}
    assert regions == {1: (3_000_000, 3_000_200), 2: (3_000_000, 3_000_200)}


def test_personal_data_and_resampling_of_a_long_text(make, spark, long_rows):
    mail = "someone@place.example"
    docs = make([(1, long_rows[0][1] + " " + mail), (2, "a b c"), (3, mail)])
    found = {r["doc_id"]: r for r in sanitise.find_personal_data(docs).collect()}
    start = len(long_rows[0][1]) + 1
    assert [(s["start"], s["end"]) for s in found[1]["base"]] == [(start, start + len(mail))]
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in resampling.resample(docs, labels).collect()} <= {1, 2, 3}


def test_many_items_and_short_texts_stay_small():
    rng = np.random.Generator(np.random.PCG64(6))
    letters = np.array(list("etaoinshrdlu "))
    line = lambda n: "".join(letters[rng.integers(0, len(letters), n)])
    index = decontaminate.Index([(i, line(100)) for i in range(20_000)])
    texts = [line(20) for _ in range(10_000)]
    tracemalloc.start()
    assert list(index.search(texts)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20


def test_crowded_and_odd_tags():
    scan = licenses.Scanner().scan
    begin = time.perf_counter()
    crowd = scan("SPDX-License-Identifier: MIT " * 8000)
    assert time.perf_counter() - begin < 1 and crowd["labels"] == "mit" and len(crowd["expressions"]) == 8000
    for text, labels in {"<!-- SPDX-License-Identifier: MIT -->": "mit", "/* SPDX-License-Identifier: Apache-2.0. */": "apache-2.0",
                         "SPDX-License-Identifier: MIT, see LICENSE": "mit", "SPDX-License-Identifier: banana": "",
                         "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0": "gpl-2.0+", "SPDX-License-Identifier: MIT WITH ISC": "",
                         "SPDX-License-Identifier: LicenseRef-own OR ISC\nBSD": "isc,licenseref-own"}.items():
        assert scan(text)["labels"] == labels, text
