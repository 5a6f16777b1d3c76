"""Exact nearest neighbours by pivots and distance bounds.

Equal points are one, with the first few ids they stand for. Every point lies in the cell of
its nearest pivot; cells are stored in parts of bounded size. A point first meets its own
part, which bounds the distance of its last neighbour; by the triangle inequality it then
needs only the parts of cells whose pivot is nearer than that bound and the cell's radius
together. No pair of cells beyond the bound is compared, and nothing within it is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.operators.skew import lookup
from daygrid.session import durable

#: Points that a cell should have, pivots at most, points of a part, queries compared at a time.
CELL, PIVOTS, PART, QUERIES = 512, 1024, 4096, 64
#: A point that stands for a LARGE-th of all rows is looked up by broadcast.
LARGE = 4096
_SLACK = 1e-9


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, from differences: equal points are at 0 exactly."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def _first(squares: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of every row, equal ones by ``order``."""
    limit = np.partition(squares, min(k, squares.shape[1]) - 1, axis=1)[:, min(k, squares.shape[1]) - 1]
    row, col = np.nonzero(squares <= limit[:, None])
    at = np.lexsort((order[col], squares[row, col], row))
    row, col = row[at], col[at]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


_FOUND = "key long, other long, first long, d double"


def _batch(key: np.ndarray, other: np.ndarray, first: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(other), pa.array(first), pa.array(d)], names=["key", "other", "first", "d"])


def _met(rows: DataFrame, width: int, k: int, own: bool) -> DataFrame:
    """The k first of a part for each of its queries; ``own``: its own points are the queries.
    A task holds one part and a batch of queries."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None

        def whole() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        def compare(keys: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, first, points = part
            for at in range(0, len(keys), QUERIES):
                squares = _squares(x[at : at + QUERIES], points)
                row, col = _first(squares, first, k)
                yield _batch(keys[at : at + QUERIES][row], ids[col], first[col], squares[row, col])

        for batch in batches:
            parts, asks = batch.column(0).to_numpy(), np.asarray(batch.column(1).to_pylist(), dtype=bool)
            edges = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(asks.astype(int)) != 0)) + 1), len(parts)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if parts[lo] != now:
                    if own and held:
                        part = whole()
                        yield from compare(part[0], part[2])
                    now, held, part = parts[lo], [], None
                b = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    held.append((b.column(2).to_numpy(), b.column(3).to_numpy(), _rows(b.column(4), width)))
                    continue
                if part is None:
                    part = whole()
                yield from compare(b.column(2).to_numpy(), _rows(b.column(4), width))
        if own and held:
            part = whole()
            yield from compare(part[0], part[2])

    dealt = rows.select("part", "query", "key", "first", "v").repartition("part").sortWithinPartitions("part", "query")
    return dealt.mapInArrow(meet, _FOUND)


def _points(rows: DataFrame, most: int) -> DataFrame:
    """(key, x, first, n, ids): the distinct points, with their first ids in order."""
    place = Window.partitionBy("x").orderBy("order")
    lists = (rows.withColumn("at", F.row_number().over(place)).where(F.col("at") <= most).groupBy("x")
             .agg(F.array_sort(F.collect_list(F.struct("order", "id"))).alias("ids")))
    sizes = rows.groupBy("x").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    return durable(sizes.join(lists, "x").withColumn("key", F.monotonically_increasing_id()), "points")


def nearest(points: DataFrame, k: int) -> DataFrame:
    """(id, x, rank, neighbour, square, y): the k nearest others of every row (id, x).

    Distances are Euclidean, ``square`` is squared, ``y`` the neighbour's point. Equal
    distances go by id, where ids are whole numbers, and else by its hash. Rows without id
    or with a null or NaN in x take no part; ids are expected once. Points with the same
    place are at distance 0. The result does not depend on pivots, cells or layout.
    """
    kind = points.schema["id"].dataType
    order = F.col("id").cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64("id")
    good = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c))
    rows = durable(points.where(good).select("id", F.transform("x", lambda c: c.cast("double") + F.lit(0.0)).alias("x"), order.alias("order")), "neighbour-rows")
    most = k + 1
    distinct = _points(rows, most)
    n, width, total = distinct.agg(F.count("*"), F.max(F.size("x")), F.sum("n")).first()
    width = max(width or 1, 1)
    drawn = distinct.select("x").orderBy(F.xxhash64("x"), "x").limit(max(1, min(PIVOTS, -(-n // CELL)))).collect()
    pivots = np.array([r["x"] for r in drawn], dtype=np.float64).reshape(-1, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, width)
            for at in range(0, len(x), PART):
                own = slice(at, at + PART)
                squares = _squares(x[own], pivots)
                cell = squares.argmin(axis=1)
                v = pa.array([r.tobytes() for r in x[own]], pa.binary())
                size = len(cell)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, size), batch.column(1).slice(at, size), v, pa.array(cell, pa.int32()),
                     pa.array(np.sqrt(squares[np.arange(size), cell]))], names=["key", "first", "v", "cell", "r"])

    placed = durable(distinct.select("key", "first", "x").mapInArrow(assign, "key long, first long, v binary, cell int, r double"), "placed-points")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()}  # at most PIVOTS
    parts, part, room = {}, -1, 0
    for c in sorted(cells):
        size = cells[c]["n"]
        if size > room:
            part, room = part + 1, PART
        parts[c] = (part, max(1, -(-size // PART)))
        part, room = part + parts[c][1] - 1, room - size if parts[c][1] == 1 else 0
    places = rows.sparkSession.createDataFrame([(c, b, m) for c, (b, m) in parts.items()], "cell int, begin long, parts long")
    index = durable(placed.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(places), "cell").select(
        (F.col("begin") + F.col("at") % F.col("parts")).alias("part"), F.lit(False).alias("query"), "key", "first", "v"), "point-index")
    radius = np.array([cells[c]["r"] if c in cells else -np.inf for c in range(len(pivots))])

    home = durable(_met(index, width, most, own=True), "neighbours-at-home")
    bound = home.groupBy("key").agg(F.count("*").alias("have"), F.max("d").alias("d")).select(
        "key", F.when(F.col("have") == most, F.col("d")).otherwise(F.lit(float("inf"))).alias("bound"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, limit, own = _rows(batch.column(2), width), np.sqrt(batch.column(3).to_numpy()), batch.column(4).to_numpy()
            for at in range(0, len(x), PART):
                span = slice(at, at + PART)
                far = np.sqrt(_squares(x[span], pivots))
                reach = far - radius[None, :] <= limit[span, None] + _SLACK * (1 + far)
                row, cell = np.nonzero(reach & np.isfinite(radius))
                begin = np.array([parts[c][0] for c in cell], dtype=np.int64)
                count = np.array([parts[c][1] for c in cell], dtype=np.int64)
                each = np.repeat(row, count)
                where = np.repeat(begin + count - np.cumsum(count), count) + np.arange(count.sum())
                pairs = np.unique(np.stack([each, where], axis=1), axis=0) if len(each) else np.zeros((0, 2), dtype=np.int64)
                pairs = pairs[pairs[:, 1] != own[span][pairs[:, 0]]]
                take = pa.array(pairs[:, 0] + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 1]), pa.array([True] * len(pairs), pa.bool_()), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)],
                    names=["part", "query", "key", "first", "v"])

    asked = index.join(bound, "key").select("key", "first", "v", "bound", "part")
    away = _met(index.unionByName(asked.mapInArrow(plan, "part long, query boolean, key long, first long, v binary")), width, most, own=False)
    best = Window.partitionBy("key").orderBy("d", "first")
    close = home.unionByName(away).withColumn("at", F.row_number().over(best)).where(F.col("at") <= most)
    named = close.join(distinct.select(F.col("key").alias("other"), F.col("x").alias("y"), "ids"), "other").select(
        "key", "d", "y", F.explode("ids").alias("i"))
    few = named.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("d", "i.order"))).where(F.col("at") <= most)
    lists = few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "d", F.col("i.id").alias("id"), "y"))).alias("near"))
    side = durable(distinct.select("key", "x", "n").join(lists, "key").select("x", "n", "near"), "neighbour-lists")
    met = lookup(rows.select("id", "x"), side, ["x"], F.col("n") >= (total or 0) / LARGE)
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k)
    return met.select("id", "x", F.posexplode(others).alias("_at", "_n")).select(
        "id", "x", (F.col("_at") + 1).alias("rank"), F.col("_n.id").alias("neighbour"), F.col("_n.d").alias("square"), F.col("_n.y").alias("y"))
