"""Summaries of many columns at once: a task keeps vectors with a place per column.

An aggregate with an expression per column is planned, compiled and buffered per column; a
thousand of them take longer to plan than to run. Here the columns travel as Arrow batches of
flags, hashes or numbers, a task adds them up in vectors, and what is shuffled is one row per
task and column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _named(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every column with what was found at its place; an empty table has found nothing."""
    places = found.sparkSession.range(1).select(F.posexplode(F.lit(list(names))).alias("_i", "column"))
    return places.join(found, F.col("_i") == F.col("i"), "left")


def _flat(df: DataFrame, cells: Sequence[Column]) -> DataFrame:
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])


def filled_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, filled, n_rows): non-null cells of every column, one pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, n = np.zeros(len(names), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            filled += np.array([c.true_count for c in batch.columns], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names)), pa.int32()), pa.array(filled), pa.array(np.full(len(names), n))], names=["i", "filled", "n_rows"])

    if not names:
        return df.sparkSession.createDataFrame([], "column string, filled long, n_rows long")
    flags = _flat(df, [F.col(q(c)).isNotNull() for c in names])
    found = flags.mapInArrow(count, "i int, filled long, n_rows long").groupBy("i").agg(F.sum("filled").alias("filled"), F.sum("n_rows").alias("n_rows"))
    zero = F.lit(0).cast("long")
    return _named(found, names).select("column", F.coalesce("filled", zero).alias("filled"), F.coalesce("n_rows", zero).alias("n_rows"))


def distinct_at_most_one(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, is_constant): whether all non-null cells of a column are equal, judged by
    their 64-bit hashes, one pass."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = [None] * len(names), [None] * len(names)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                ends = pc.min_max(column)
                a, b = ends["min"].as_py(), ends["max"].as_py()
                if a is not None:
                    low[i] = a if low[i] is None else min(a, low[i])
                    high[i] = b if high[i] is None else max(b, high[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names)), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["i", "low", "high"])

    if not names:
        return df.sparkSession.createDataFrame([], "column string, is_constant boolean")
    hashes = _flat(df, [F.when(F.col(q(c)).isNotNull(), F.xxhash64(q(c))) for c in names])
    found = hashes.mapInArrow(extremes, "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    flag = ~F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    return _named(found, names).select("column", flag.alias("is_constant"))


def moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, n, mean, sd_pop): of the non-null numbers of every column. Deviations are
    taken around the mean of a batch and merged, so that large means cost no digits."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = (np.zeros(len(names)) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            known = np.stack([np.asarray(c.is_valid()) for c in batch.columns])
            x = np.where(known, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]), 0.0)
            k = known.sum(axis=1).astype(float)
            own = x.sum(axis=1) / np.maximum(k, 1)
            spread = np.where(known, (x - own[:, None]) ** 2, 0.0).sum(axis=1)
            both = np.maximum(n + k, 1)
            step = own - mean
            square += spread + np.where(k > 0, step * step * n * k / both, 0.0)
            mean += np.where(k > 0, step * k / both, 0.0)
            n += k
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names)), pa.int32()), pa.array(n), pa.array(mean), pa.array(square)], names=["i", "n", "mean", "square"])

    if not names:
        return df.sparkSession.createDataFrame([], "column string, n long, mean double, sd_pop double")
    numbers = _flat(df, [F.col(q(c)).cast("double") for c in names])
    parts = numbers.mapInArrow(gather, "i int, n double, mean double, square double").where("n > 0")
    # as many rows per column as tasks: their states are merged in the order of their means
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("mean", "n", "square"))), F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("n"), F.lit(0.0).alias("square")),
        lambda a, b: F.struct((a["mean"] + (b["mean"] - a["mean"]) * b["n"] / (a["n"] + b["n"])).alias("mean"), (a["n"] + b["n"]).alias("n"),
                              (a["square"] + b["square"] + (b["mean"] - a["mean"]) * (b["mean"] - a["mean"]) * a["n"] * b["n"] / (a["n"] + b["n"])).alias("square")))
    found = parts.groupBy("i").agg(merged.alias("m")).select("i", F.col("m.n").cast("long").alias("n"), F.col("m.mean").alias("mean"), F.sqrt(F.col("m.square") / F.col("m.n")).alias("sd_pop"))
    return _named(found, names).where("n > 0").select("column", "n", "mean", "sd_pop")
