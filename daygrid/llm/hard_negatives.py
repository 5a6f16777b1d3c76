"""Hard negatives from an inverted multi-index, exact by certified windows.

Vectors are scaled to whole numbers and halved; a codebook per half names the cell (i, j) of
every row. For a query, the best score in a cell is at most the sum of two half scores, each
the product with the code plus the query's length times the code's radius. A multi-sequence
heap visits cells by falling bounds and stops when the next bound lies below every open
window, so that what it leaves out cannot belong to the result. A window is a range of scores
of which the first few rows are wanted; it narrows with every row found, first in the sample
that the codebooks come from, then cell by cell. Queries travel to the parts of the index
that hold their cells; parts are bounded in rows, however many rows a cell has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.session import durable

#: Rows that the codebooks are fitted on (those with the smallest hashes of their ids),
#: steps of the fit, codes of a half at most, rows that a cell should have.
SAMPLE, STEPS, CODES, CELL = 1 << 13, 8, 64, 1 << 10
#: Rows of a part of the index, at least and at most; queries and rows of one product.
PART_LEAST, PART, QUERIES, TILE = 1 << 10, 1 << 16, 256, 1 << 11
#: Scaled vectors of this length or more take no part: their products need not fit 64 bits.
LONGEST = 1 << 28
_LOW, _HIGH = -(2**62), 2**62


class _Codes:
    """Two codebooks of whole numbers, with the radius and the longest half of each code."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books = books
        self.radius = [np.zeros(len(b), dtype=np.int64) for b in books]
        self.longest = [np.zeros(len(b), dtype=np.int64) for b in books]

    def halves(self, rows: np.ndarray) -> list[np.ndarray]:
        width = self.books[0].shape[1]
        return [rows[:, :width], rows[:, width:]]

    def nearest(self, rows: np.ndarray) -> list[np.ndarray]:
        out = []
        for half, book in zip(self.halves(rows), self.books, strict=True):
            b = book.astype(np.float64)
            out.append((half.astype(np.float64) @ b.T - (b * b).sum(axis=1) / 2).argmax(axis=1))
        return out

    def bounds(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each half, the most that a row of each code can score; whole numbers, so that
        every task comes to the same."""
        out = []
        for half, book, radius, longest in zip(self.halves(queries), self.books, self.radius, self.longest, strict=True):
            size = np.ceil(np.sqrt((half.astype(np.float64) ** 2).sum(axis=1)) + 1e-6).astype(np.int64)[:, None]
            out.append(np.minimum(half @ book.T + size * radius, size * longest))
        return out


def fitted(sample: np.ndarray, codes: int) -> _Codes:
    """Codebooks by a few steps of k-means over the halves of a bounded sample."""
    width = -(-sample.shape[1] // 2)
    books = []
    for half in (sample[:, :width], sample[:, width:]):
        x = half.astype(np.float64)
        book = np.unique(half, axis=0).astype(np.float64)
        book = book[np.linspace(0, len(book) - 1, min(codes, len(book))).astype(int)]
        for _ in range(STEPS):
            at = (x @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1)
            n = np.bincount(at, minlength=len(book))
            sums = np.stack([np.bincount(at, weights=x[:, k], minlength=len(book)) for k in range(x.shape[1])], axis=1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        books.append(np.rint(book).astype(np.int64))
    return _Codes(books)


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bound, i, j) of all cells by falling sums of their half bounds."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-int(first[a[0]] + second[b[0]]), 0, 0)]
    while heap:
        less, x, y = heapq.heappop(heap)
        yield -less, int(a[x]), int(b[y])
        if y + 1 < len(b):
            heapq.heappush(heap, (-int(first[a[x]] + second[b[y + 1]]), x, y + 1))
        if y == 0 and x + 1 < len(a):
            heapq.heappush(heap, (-int(first[a[x + 1]] + second[b[0]]), x + 1, 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).reshape(-1, width).astype(np.int64)


def _products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products, in the narrowest numbers that hold them."""
    most = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (queries.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (rows.astype(kind) @ queries.astype(kind).T).astype(np.int64)


def _fits(labels: np.ndarray, ids: np.ndarray, tag: np.ndarray, own: np.ndarray, same: bool) -> np.ndarray:
    """Which rows may stand in a query's windows: others of its label, or those of other labels."""
    return (labels[:, None] == tag) & (ids[:, None] != own) if same else labels[:, None] != tag


class _Windows:
    """The first ``count`` rows of every window (query, lo, hi) among the rows shown so far."""

    def __init__(self, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, count: int) -> None:
        self.owner, self.lo, self.hi, self.count = owner, lo.copy(), hi, count
        self.found = [np.zeros(0, dtype=np.int64)] * 3  # window, score, id

    def show(self, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> None:
        """``scores`` and ``fits`` are (rows, queries); ``queries`` are the owners in the columns."""
        column = np.full(int(self.owner.max(initial=-1)) + 1, -1)
        column[queries] = np.arange(len(queries))
        mine = np.flatnonzero(column[self.owner] >= 0)
        at = column[self.owner[mine]]
        ok = fits[:, at] & (scores[:, at] >= self.lo[mine]) & (scores[:, at] <= self.hi[mine])
        r, w = np.nonzero(ok)
        if not len(r):
            return
        window, score, own = (np.concatenate([a, b]) for a, b in zip(self.found, (mine[w], scores[r, at[w]], ids[r]), strict=True))
        order = np.lexsort((own, -score, window))
        window, score, own = window[order], score[order], own[order]
        begin = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        rank = np.arange(len(window)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(window)]])))
        keep = rank < self.count
        full = rank == self.count - 1
        self.lo[window[full]] = np.maximum(self.lo[window[full]], score[full])
        self.found = [window[keep], score[keep], own[keep]]

    def lowest(self, n: int) -> np.ndarray:
        """Per query, the least score that any of its windows still takes."""
        out = np.full(n, _HIGH)
        np.minimum.at(out, self.owner, self.lo)
        return out


_ROW = "vec long, label long, v binary"


def _whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec, label, x): rows that take part."""
    x = F.col("x")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec"), F.col(f"`{label_col}`").cast("long").alias("label"),
                           F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
            .where(F.col("vec").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & good))


def _scaled(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of every vector, padded with zeros, and which are short enough."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    at = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(0), *[np.arange(n) for n in sizes]]).astype(int)
    out = np.zeros((len(sizes), width))
    out[at] = np.floor(scale * flat)
    good = np.sqrt((out**2).sum(axis=1)) < LONGEST
    out[~good] = 0
    return out.astype(np.int64), good


def _indexed(rows: DataFrame, codes: _Codes, width: int, scale: int) -> DataFrame:
    """(vec, label, v, i, j, r1, r2, n1, n2): rows in their cells, with the distances from
    both codes and the lengths of both halves, rounded up."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, good = _scaled(batch.column(2), width, scale)
            whole = whole[good]
            at = codes.nearest(whole)
            up = lambda x: pa.array(np.ceil(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) + 1e-6).astype(np.int64))
            far = [up(h - book[k]) for h, book, k in zip(codes.halves(whole), codes.books, at, strict=True)]
            size = [up(h) for h in codes.halves(whole)]
            v = pa.array([r.tobytes() for r in whole.astype(np.int32)], pa.binary())
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), v, *[pa.array(k, pa.int32()) for k in at], *far, *size],
                names=["vec", "label", "v", "i", "j", "r1", "r2", "n1", "n2"])

    return rows.mapInArrow(assign, f"{_ROW}, i int, j int, r1 long, r2 long, n1 long, n2 long")


class _Layout:
    """Which parts hold a cell: small cells share a part, large ones take several."""

    def __init__(self, cells: dict[tuple[int, int], int], size: int) -> None:
        self.of: dict[tuple[int, int], tuple[int, int]] = {}
        part, room = -1, 0
        for cell in sorted(cells):
            n = cells[cell]
            if n > size:
                self.of[cell] = (part + 1, -(-n // size))
                part, room = part + self.of[cell][1], 0
            else:
                if n > room:
                    part, room = part + 1, size
                self.of[cell] = (part, 1)
                room -= n


_VISIT = "part long, query boolean, key long, vec long, label long, v binary, i int, j int, lo array<long>, hi array<long>"


def _visits(queries: DataFrame, sample: tuple[np.ndarray, np.ndarray, np.ndarray], codes: _Codes, layout: _Layout, width: int,
            same: bool, count: int) -> DataFrame:
    """The parts that each query (key, vec, label, v, lo, hi) has to visit, as _VISIT rows."""
    shared = queries.sparkSession.sparkContext.broadcast(sample)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = shared.value
        for whole in batches:
            for start in range(0, len(whole), QUERIES):
                batch = whole.slice(start, QUERIES)
                own, tag, q = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3), width)
                windows = _opened(batch.column(4), batch.column(5), count)
                for at in range(0, len(ids), TILE):
                    part = slice(at, at + TILE)
                    fits = _fits(labels[part], ids[part], tag, own, same)
                    windows.show(_products(rows[part], q), fits, ids[part], np.arange(len(q)))
                low = windows.lowest(len(q))
                first, second = codes.bounds(q)
                take, part_of = [], []
                for k in range(len(q)):
                    parts: set[int] = set()
                    for bound, i, j in multi_sequence(first[k], second[k]):
                        if bound < low[k]:
                            break
                        begin, n = layout.of.get((i, j), (0, 0))
                        parts.update(range(begin, begin + n))
                    take += [k] * len(parts)
                    part_of += sorted(parts)
                lists = np.split(windows.lo, np.flatnonzero(np.diff(windows.owner)) + 1) if len(windows.lo) else []
                lo = pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))
                n, chosen = len(take), pa.array(take, pa.int64())
                none = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_of, pa.int64()), pa.array([True] * n, pa.bool_()), *[c.take(chosen) for c in batch.columns[:4]], none, none,
                     lo.take(chosen), batch.column(5).take(chosen)], names=[c.split()[0] for c in _VISIT.split(", ")])

    return queries.select("key", "vec", "label", "v", "lo", "hi").mapInArrow(plan, _VISIT)


def _opened(lo: pa.Array, hi: pa.Array, count: int) -> _Windows:
    sizes = np.diff(lo.offsets.to_numpy())
    return _Windows(np.repeat(np.arange(len(sizes)), sizes), lo.flatten().to_numpy(), hi.flatten().to_numpy(), count)


class _Part:
    """One part of the index in memory, its rows by cell."""

    def __init__(self, held: list[tuple], codes: _Codes, width: int) -> None:
        ids, labels, i, j = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, dtype=np.int64) for k in range(4))
        rows = np.concatenate([h[4] for h in held]) if held else np.zeros((0, width), dtype=np.int64)
        order = np.lexsort((j, i))
        self.ids, self.labels, self.rows, self.codes = ids[order], labels[order], rows[order], codes
        i, j = i[order], j[order]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 0) | (np.diff(j) != 0)])) if len(i) else np.zeros(0, dtype=np.int64)
        self.i, self.j, self.begin, self.end = i[begin], j[begin], begin, np.concatenate([begin[1:], [len(i)]]) if len(i) else begin

    def search(self, own: np.ndarray, tag: np.ndarray, q: np.ndarray, windows: _Windows, same: bool) -> None:
        """Every query takes its cells by falling bounds until its windows are certified."""
        first, second = self.codes.bounds(q)
        bound = first[:, self.i] + second[:, self.j]
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(q))
        for step in range(len(self.begin)):
            low = windows.lowest(len(q))
            live = live[bound[live, order[live, step]] >= low[live]]
            if not len(live):
                break
            cell = order[live, step]
            for c in np.unique(cell):
                who = live[cell == c]
                for at in range(self.begin[c], self.end[c], TILE):
                    part = slice(at, min(at + TILE, self.end[c]))
                    fits = _fits(self.labels[part], self.ids[part], tag[who], own[who], same)
                    windows.show(_products(self.rows[part], q[who]), fits, self.ids[part], who)


def _searched(index: DataFrame, visits: DataFrame, codes: _Codes, width: int, same: bool, count: int) -> DataFrame:
    """(key, vec, window, score, id, rank): the first rows of every window of every query.
    A task holds one part of the index and a batch of queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for whole in batches:
            parts, asks = whole.column(0).to_numpy(), np.asarray(whole.column(1).to_pylist(), dtype=bool)
            edges = np.flatnonzero((np.diff(parts) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(parts)], strict=True):
                if lo == hi:
                    continue
                if parts[lo] != now:
                    now, held, part = parts[lo], [], None
                if not asks[lo]:
                    b = whole.slice(lo, hi - lo)
                    held.append((*[b.column(k).to_numpy() for k in (3, 4, 6, 7)], _matrix(b.column(5), width)))
                    continue
                if part is None:
                    part, held = _Part(held, codes, width), []
                for start in range(lo, hi, QUERIES):
                    b = whole.slice(start, min(QUERIES, hi - start))
                    key, own, tag = (b.column(k).to_numpy() for k in (2, 3, 4))
                    windows = _opened(b.column(8), b.column(9), count)
                    part.search(own, tag, _matrix(b.column(5), width), windows, same)
                    window, score, ids = windows.found
                    who = windows.owner[window]
                    number = window - np.searchsorted(windows.owner, who)
                    yield pa.RecordBatch.from_arrays([pa.array(key[who]), pa.array(own[who]), pa.array(number, pa.int32()), pa.array(score), pa.array(ids)],
                                                     names=["key", "vec", "window", "score", "id"])

    rows = index.unionByName(visits).repartition("part").sortWithinPartitions("part", "query", "i", "j")
    found = rows.mapInArrow(search, "key long, vec long, window int, score long, id long")
    best = Window.partitionBy("key", "vec", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100,
                   positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of vectors whose components become floor(scale * x); higher
    ones come first, equal ones by id. Anchors are the rows whose id is divisible by
    ``every``; their positives are the first other rows of the same label, the negatives of
    a positive the first rows of other labels whose score lies between ``low`` per cent of
    the positive's and all of it. The result is exact: no cell is left out but by its bound.

    Rows without id, label or vector take no part, nor those with a null or non-finite
    component or a scaled length of 2**28 or more. Shorter vectors are filled up with
    zeros. Repeated rows serve once each as positive or negative; an anchor that is
    repeated asks once, and rows of its own id are not its positives. An anchor without
    positives, or a positive without negatives, gives no row.
    """
    spark = vectors.sparkSession
    rows = _whole(vectors, id_col, vector_col, label_col)
    width, total = rows.agg(F.max(F.size("x")), F.count("*")).first()
    width = max(width or 0, 2)
    drawn = rows.orderBy(F.xxhash64("vec"), "vec", "label", "x").limit(SAMPLE).collect()
    flat = pa.array([r["x"] for r in drawn], pa.list_(pa.float64()))
    whole, good = _scaled(flat, width, scale)
    sample = (np.array([r["vec"] for r in drawn], dtype=np.int64)[good], np.array([r["label"] for r in drawn], dtype=np.int64)[good], whole[good])
    codes = fitted(sample[2], max(2, min(CODES, int((total / CELL) ** 0.5)))) if good.any() else _Codes([np.zeros((1, -(-width // 2)), dtype=np.int64), np.zeros((1, width // 2), dtype=np.int64)])
    cells = durable(_indexed(rows, codes, width, scale), "cells")

    # at most CODES * CODES rows of counts and radii
    measures = ("r1", "r2", "n1", "n2")
    counted = cells.groupBy("i", "j").agg(F.count("*").alias("n"), *[F.max(m).alias(m) for m in measures]).collect()
    for r in counted:
        for k, c in enumerate((r["i"], r["j"])):
            codes.radius[k][c] = max(codes.radius[k][c], r[measures[k]])
            codes.longest[k][c] = max(codes.longest[k][c], r[measures[2 + k]])
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = _Layout({(r["i"], r["j"]): r["n"] for r in counted}, max(PART_LEAST, min(PART, -(-total // tasks))))
    places = spark.createDataFrame([(i, j, p, n) for (i, j), (p, n) in layout.of.items()], "i int, j int, begin long, parts long")
    none = F.lit(None)
    index = cells.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(places), ["i", "j"]).select(
        (F.col("begin") + F.col("at") % F.col("parts")).alias("part"), F.lit(False).alias("query"), none.cast("long").alias("key"), "vec", "label",
        "v", "i", "j", none.cast("array<bigint>").alias("lo"), none.cast("array<bigint>").alias("hi"))

    anchors = durable(cells.where(F.col("vec") % every == 0).select("vec", "label", "v").distinct()
                      .withColumn("key", F.xxhash64("vec", "label", "v")), "anchors")
    wide = anchors.withColumns({"lo": F.array(F.lit(_LOW).cast("long")), "hi": F.array(F.lit(_HIGH).cast("long"))})
    first = durable(_searched(index, _visits(wide, sample, codes, layout, width, True, positives), codes, width, True, positives), "positives")

    # a window for every positive, in the order of their ranks
    lists = first.groupBy("key", "vec").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    # a positive with a score below zero leaves an empty window
    asked = anchors.join(lists, ["key", "vec"]).withColumns({"hi": F.col("p.score"), "lo": F.expr(f"transform(p, x -> ({low} * x.score + 99) div 100)")})
    second = _searched(index, _visits(asked, sample, codes, layout, width, False, negatives), codes, width, False, negatives)
    mine = first.select("key", "vec", F.col("vec").alias("anchor_id"), (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mine.join(second.select("key", "vec", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["key", "vec", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
