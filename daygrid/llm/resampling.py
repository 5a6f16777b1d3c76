"""Quality selection by importance resampling.

Three generative models over hashed word n-grams: one of the target texts, one of all raw
texts and one of the toxic ones, which stand in equal parts on the raw side. The log ratio of a text's probability under target and raw side is its importance weight; adding
Gumbel noise and taking the k largest keys samples k texts without replacement in
proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.llm.text import doc_words, windows
from daygrid.session import durable

BUCKETS_BITS = 16
#: Labelled rows that may form the target model, and the toxic one (those with the smallest id hashes).
LABELLED = 50_000
#: Pseudo-count of a bucket, and fixed-point steps of a key.
PRIOR, STEPS = 1.0, 1 << 20


def buckets(words: np.ndarray) -> np.ndarray:
    """Hashed words and word pairs of a text."""
    shift = np.uint64(64 - BUCKETS_BITS)
    return (np.concatenate([words, windows(words, 2)]) >> shift).astype(np.int64)


def bucket_counts(docs: DataFrame, samples: tuple[np.ndarray, ...], id_col: str, text_col: str) -> np.ndarray:
    """n-grams per bucket: a row over all texts, and one over the ids of each sample."""
    held = docs.sparkSession.sparkContext.broadcast(samples)
    size, names = 1 << BUCKETS_BITS, [f"n{k}" for k in range(len(samples) + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(names), size), dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            known = ~np.asarray(batch.column(0).is_null())
            wanted = np.stack([np.ones(len(ids), dtype=bool), *[np.isin(ids, own) & known for own in held.value]], axis=1)
            for words, own in zip(doc_words(batch.column(1).to_pylist(), lower=True), wanted, strict=True):
                n = np.bincount(buckets(words), minlength=size) if len(words) > size // 8 else None
                for total in (totals[k] for k in np.flatnonzero(own)):
                    if n is None:
                        np.add.at(total, buckets(words), 1)
                    else:
                        total += n
        at = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(t[at]) for t in totals]], names=["bucket", *names])

    read = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary"))
    rows = (read.mapInArrow(count, ", ".join(f"{n} long" for n in ("bucket", *names)))
            .groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow())
    out = np.zeros((len(names), size), dtype=np.int64)
    out[:, rows.column(0).to_numpy()] = [rows.column(k + 1).to_numpy() for k in range(len(names))]
    return out


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, log_weight, noise seed) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            w = [float(table[buckets(words)].sum()) if len(words) else 0.0 for words in doc_words(batch.column(2).to_pylist(), lower=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w, pa.float64())], names=["doc_id", "seed", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    read = docs.select(F.col(f"`{id_col}`"), F.xxhash64(F.lit(6), F.col(f"`{id_col}`")), text.cast("binary"))
    return read.mapInArrow(weigh, f"doc_id {kind}, seed long, log_weight double")


def threshold(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column ``key``: counts per bin, refined bin by bin."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    while low < high:
        width = -(-(high - low + 1) // 4096)
        bins = keys.where(F.col("key").between(low, high)).groupBy(F.expr(f"(key - {low}L) div {width}L").alias("bin")).count().collect()
        for b, n in sorted(((r["bin"], r["count"]) for r in bins), reverse=True):  # at most 4096 bins
            if n >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            k -= n
        else:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, key, kept.

    Target texts are those labelled of good quality and not toxic, and the texts labelled
    toxic weigh on the raw side (at most LABELLED of each). ``share`` of the rows is kept; None takes the share of target labels among all
    labels. The noise comes from the id, so rows that share id and text share their key;
    all rows tied at the last key stay. Null and empty texts have weight 0; null labels
    are no targets; without labels nothing is preferred. Ids are integers; other columns
    are not read.
    """
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    marks = labels.agg(F.count("*").alias("n"), F.sum(F.when(good, 1).otherwise(0)).alias("good")).first()
    if share is None:
        share = marks["good"] / marks["n"] if marks["n"] else 1.0

    def sample(wanted: Column) -> np.ndarray:
        ids = labels.where(wanted & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).toArrow().column(0).to_numpy()

    raw, own, toxic = bucket_counts(docs, (sample(good), sample(F.col("toxic") == 1)), id_col, text_col)
    size = len(raw)
    of = lambda c: np.log((c + PRIOR) / (c.sum() + PRIOR * size))
    other = np.logaddexp(of(raw), of(toxic)) - np.log(2) if toxic.sum() else of(raw)
    ratio = of(own) - other if own.sum() else np.zeros(size)
    uniform = (F.shiftrightunsigned("seed", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    noisy = F.col("log_weight") - F.log(-F.log(uniform))
    found = durable(weights(docs, ratio, id_col, text_col).withColumn("key", F.floor(noisy * STEPS).cast("long")), "importance")
    last = threshold(found, round(share * found.count()))
    kept = F.lit(False) if last is None else F.col("key") >= last
    return found.select("doc_id", "log_weight", (F.col("key") / float(STEPS)).alias("key"), kept.alias("kept"))
