"""Connected components of an edge table.

Tasks first contract the edges they hold to stars of their own; alternating large and
small stars then spread the smallest names through the shuffle, until so few edges are
left that one task of bounded memory finishes them. The components are the same
whichever step finds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.session import durable

#: Edges (16 bytes each) that one task takes at a time.
TASK_EDGES = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for every vertex but the smallest."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _stars(edges: DataFrame) -> DataFrame:
    """Every task's edges, TASK_EDGES at a time, as stars around their smallest vertices."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            u, v = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= TASK_EDGES:
                yield out()
        if held:
            yield out()

    return edges.select("u", "v").mapInArrow(shrink, "u long, v long")


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of u move to the smallest vertex around u. Small star:
    u and its smaller neighbours do."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        return _oriented(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return _oriented(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, finish: int = TASK_EDGES) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (u, v) but the smallest of each
    component, which is its name. The driver sees a count and a checksum per round, and
    rounds grow with the logarithm of the size."""
    now, seen = durable(_stars(_oriented(edges)), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        if mark[0] <= finish:
            now = _stars(now.coalesce(1))
            break
        seen = mark
        now = durable(_star(_star(_stars(now), large=True), large=False).distinct(), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
