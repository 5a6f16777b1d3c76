"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch of a group is a table of rounded values with counts: values keep their leading
bits, so that a sketch has a bounded number of rows, two sketches merge by adding counts
and the result does not depend on the layout. Quartiles per language and source give the
fences; a source with few documents takes the merged sketch of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from daygrid.llm.text import WHITE, doc_words, windows
from daygrid.session import durable

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Per-mille features, the side on which they are bad, and the least width of a fence.
FEATURES = {"symbols": ("above", 100), "dup_lines": ("above", 500), "repeats": ("above", 150), "word_size": ("both", 4000)}
#: A fence lies this many quartile distances outside the quartiles.
REACH = 3
#: Leading bits that a sketch keeps, and the documents that the language's sketch counts for
#: beside those of a group: quartiles are blended by these weights, whatever the group's size.
BITS, PRIOR = 7, 50


def measure(doc: bytes, words: np.ndarray) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    lines = [x for x in doc.split(b"\n") if x.strip(WHITE)]
    chars = len(doc.translate(None, WHITE + bytes(range(0x80, 0xC0))))
    runs = windows(words, 5)
    repeated = 0
    if len(runs):
        _, where, times = np.unique(runs, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[where] > 1)
        if len(starts):
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + 5, -1)
            repeated = int((np.cumsum(edge) > 0).sum())
    return (len(words), chars, len(doc) - len(doc.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
            len(lines))


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of every row, their names behind two
    underscores; a null text counts as empty."""
    names = [f"__{c}" for c in COUNTS]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in names]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            rows = [measure(d or b"", w) for d, w in zip(texts, doc_words(texts, lower=False), strict=True)]
            table = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *[pa.array(table[:, i]) for i in range(len(COUNTS))]],
                names=[*keep, *names])

    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    return read.mapInArrow(count, schema)


def features() -> dict[str, Column]:
    per_word = "1000 * {} div greatest(__n_words, 1)"
    return {
        "symbols": F.expr(per_word.format("__n_symbols")),
        "dup_lines": F.expr("1000 * __n_dup_lines div greatest(__n_lines, 1)"),
        "repeats": F.expr(per_word.format("__n_repeat_words")),
        "word_size": F.expr(per_word.format("__word_chars")),
    }


def sketches(counts: DataFrame, lang: str, source: str) -> DataFrame:
    """(_lang, _source, feature, value, n): a mergeable quantile sketch of every group."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in features().items()])
    group = [F.col(f"`{lang}`").alias("_lang"), F.col(f"`{source}`").alias("_source")]
    long = counts.select(*group, F.explode(pairs).alias("_f")).select("_lang", "_source", "_f.*")
    drop = f"greatest(length(bin(value)) - {BITS}, 0)"
    rounded = F.expr(f"shiftleft(shiftright(value, {drop}), {drop})")
    return long.groupBy("_lang", "_source", "feature", rounded.alias("value")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "feature", "value").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups…, feature, docs, q1, q3): the smallest values with a quarter and three
    quarters of the documents at or below them."""
    of = Window.partitionBy(*groups, "feature")
    run = sketch.withColumns({"_upto": F.sum("n").over(of.orderBy("value")), "docs": F.sum("n").over(of)})
    return run.groupBy(*groups, "feature", "docs").agg(
        F.min(F.when(4 * F.col("_upto") >= F.col("docs"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("_upto") >= 3 * F.col("docs"), F.col("value"))).alias("q3"))


def fences(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(_lang, _source, <feature>_low, <feature>_high) for every group that occurs."""
    fine = sketches(counts, lang, source)
    coarse = quartiles(merged(fine, ["_lang"]), ["_lang"]).select(
        F.col("_lang").alias("_of"), F.col("feature").alias("_feature"), F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
    joined = quartiles(fine, ["_lang", "_source"]).join(
        coarse, F.col("_lang").eqNullSafe(F.col("_of")) & (F.col("feature") == F.col("_feature")))
    blend = f"(docs * {{}} + {PRIOR} * {{}}) div (docs + {PRIOR})"
    joined = joined.withColumns({"_a": F.expr(blend.format("q1", "_q1")), "_b": F.expr(blend.format("q3", "_q3"))})
    cells = []
    for name, (_, least) in FEATURES.items():
        width = F.greatest(REACH * (F.col("_b") - F.col("_a")), F.lit(least))
        of = F.col("feature") == name
        cells += [F.max(F.when(of, F.col("_a") - width)).alias(f"__{name}_low"),
                  F.max(F.when(of, F.col("_b") + width)).alias(f"__{name}_high")]
    return joined.groupBy("_lang", "_source").agg(*cells)


def verdicts(counts: DataFrame, found: DataFrame, lang: str, source: str) -> DataFrame:
    """``counts`` with ``__base_failed`` and ``__kept``."""
    ok = F.lit(True)
    for name, value in features().items():
        ok = ok & (value <= F.col(f"__{name}_high"))
        if FEATURES[name][0] == "both":
            ok = ok & (value >= F.col(f"__{name}_low"))
    failed = (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))
    group = F.col(f"`{lang}`").eqNullSafe(F.col("_lang")) & F.col(f"`{source}`").eqNullSafe(F.col("_source"))
    return counts.join(found, group, "left").withColumns({"__base_failed": failed, "__kept": ~failed & ok})


def _groups(docs: DataFrame, text_col: str, lang: str, source: str, id_col: str | None = None) -> DataFrame:
    """The counts of every text beside its group (and its id), under names of their own."""
    names = {"lang": lang, "source": source} | ({"doc_id": id_col} if id_col else {})
    read = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.col(f"`{text_col}`").alias("text"))
    return text_counts(read, list(names), "text")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, ``base_failed`` and ``kept``.

    Fixed base: fewer than 10 words, or over a fifth of them in repeated 5-word windows.
    The others are kept unless a feature lies outside the fences of their language and
    source. Null languages and sources are groups of their own; null and empty texts have
    no words and fail the base; an empty table gives an empty result. Other columns are
    not read, so their names cannot clash.
    """
    counts = durable(_groups(docs, text_col, lang, source, id_col), "text-counts")
    return verdicts(counts, fences(counts), "lang", "source").select(
        "doc_id", *[F.col(f"__{c}").alias(c) for c in COUNTS[:-1]],
        F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    The fences are stored (a row per language and source); a second pass over the texts
    applies them, so that no text is shuffled while they are small enough to broadcast.
    """
    found = durable(fences(_groups(docs, text_col, lang, source), "lang", "source"), "fences")
    # the row as a struct, so that its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{lang}`").alias("lang"),
                       F.col(f"`{source}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    good = verdicts(text_counts(rows, ["doc", "lang", "source"], "text"), found, "lang", "source").where("__kept")
    return good.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
