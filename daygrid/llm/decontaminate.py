"""Benchmark decontamination by q-gram lemma filtering.

A region within k edits of an item of m characters shares at least m - q + 1 - kq
q-grams with it, on diagonals at most 2k apart. Shared q-grams are counted per item and
band of diagonals (two bands cover every diagonal, so that no region falls between
them); bands that reach the bound are verified by a banded alignment. The items are the
query set: they visit all documents in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q, ERRORS = 8, 0.1
#: Characters of items in one block, and of documents looked at together.
ITEM_BLOCK, TEXT_BLOCK = 2_000_000, 1 << 18
_BASE = 0xD1342543DE82EF95
_COST = np.int64(1) << np.int64(32)


def _fold(code: int) -> int:
    """The letter without its case, where that is one code point."""
    letter = chr(code)
    upper = letter.upper()
    lower = (upper if len(upper) == 1 else letter).lower()
    return ord(lower) if len(lower) == 1 else code


#: What every code point is compared as; none beyond the second plane has case.
_FOLDED = np.arange(0x110000, dtype=np.uint32)
_FOLDED[: 0x20000] = [_fold(c) for c in range(0x20000)]
_FOLDED[0x130] = ord("i")  # its lower case in full is an i and a dot
_FOLDED[9:14] = 32


def characters(text: str) -> np.ndarray:
    """Code points with the case of all letters folded and ASCII white space as blanks; positions stay."""
    return _FOLDED[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q = 8 characters from every position."""
    h = codes.astype(np.uint64) + np.uint64(1)
    power = _BASE
    for shift in (1, 2, 4):
        h = h[:-shift] * np.uint64(power) + h[shift:]
        power = power * power % 2**64
    return h


def edit_budget(m: int) -> int:
    """Edits allowed in an item: a share of its length, and never so many that the bound vanishes."""
    return max(0, min(int(ERRORS * m), (m - Q) // Q))


class Index:
    """q-grams of a block of items, with a bit table in front."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        texts = [(i, characters(t or "")) for i, t in items]
        self.short = [(i, c) for i, c in texts if 0 < len(c) < Q]
        self.items = [(i, c) for i, c in texts if len(c) >= Q]
        hashes = [grams(c) for _, c in self.items]
        every = np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([*[np.arange(len(h)) for h in hashes], np.zeros(0, dtype=np.int64)])
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner, self.place = every[order], owner[order], place[order]
        self.names, self.first, self.times = np.unique(self.hashes, return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self._slot(self.names)] = True
        m = np.array([len(c) for _, c in self.items], dtype=np.int64)
        self.budget = np.array([edit_budget(x) for x in m], dtype=np.int64)
        self.bound = np.maximum(1, m - Q + 1 - self.budget * Q)
        self.step = 2 * self.budget + 1  # bands are two steps wide

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, position in the item) of every q-gram in common."""
        h = grams(codes)
        at = np.flatnonzero(self.bits[self._slot(h)])
        near = np.minimum(np.searchsorted(self.names, h[at]), len(self.names) - 1)
        hit = self.names[near] == h[at]
        at, near = at[hit], near[hit]
        n = self.times[near]
        row = np.repeat(self.first[near] + n - np.cumsum(n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[row], self.place[row]

    def bands(self, codes: list[np.ndarray]) -> np.ndarray:
        """(text number, item, band) rows that share enough of the item's q-grams."""
        gap = np.zeros(Q, dtype=np.uint32)  # no q-gram spans two texts
        begins = np.cumsum([0, *[len(c) + Q for c in codes]])
        where, item, place = self.shared(np.concatenate([x for c in codes for x in (c, gap)]))
        doc = np.searchsorted(begins, where, side="right") - 1
        # a text with too few q-grams of an item anywhere has no band with enough
        names, number, times = np.unique(doc * len(self.items) + item, return_inverse=True, return_counts=True)
        rest = (times >= self.bound[names % max(1, len(self.items))])[number]
        doc, item, place, where = doc[rest], item[rest], place[rest], where[rest]
        if not len(doc):
            return np.zeros((0, 3), dtype=np.int64)
        band = (where - begins[doc] - place) // self.step[item]
        low = band.min() - 1
        span = int(band.max() - low) + 1
        key = (doc * len(self.items) + item) * span + band - low
        names, number = np.unique(np.concatenate([key, key - 1]), return_inverse=True)
        # each q-gram of the item counts once, however often the band repeats it
        size = int(place.max()) + 1
        shared = np.unique(number * size + np.tile(place, 2)) // size
        pair, at = np.divmod(names, span)
        rows = np.stack([*np.divmod(pair, len(self.items)), at + low], axis=1)
        return rows[np.bincount(shared, minlength=len(names)) >= self.bound[rows[:, 1]]]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, start, end, edits) of the regions of every text; of
        regions of one item that overlap, the one with the fewest edits."""
        codes = [characters(t) for t in texts]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        if self.items:
            for d, i, b in self.bands(codes).tolist():
                step, budget = int(self.step[i]), int(self.budget[i])
                hit = align(self.items[i][1], codes[d], b * step, (b + 2) * step, budget)
                if hit:
                    found.setdefault((d, self.items[i][0]), []).append(hit)
        for i, own in self.short:
            for d, c in enumerate(codes):
                for start in occurrences(own, c):
                    found.setdefault((d, i), []).append((start, start + len(own), 0))
        for (d, i), hits in found.items():
            kept: list[tuple[int, int, int]] = []
            for hit in sorted(set(hits), key=lambda h: (h[2], h[0], h[1])):
                if all(hit[1] <= k[0] or k[1] <= hit[0] for k in kept):
                    kept.append(hit)
                    yield d, i, *hit


def occurrences(item: np.ndarray, text: np.ndarray) -> Iterator[int]:
    """Places where ``item`` stands in ``text`` without any edit."""
    data, part, at = text.tobytes(), item.tobytes(), -1
    while (at := data.find(part, at + 1)) >= 0:
        if at % 4 == 0:
            yield at // 4


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The best region of ``text`` near the diagonals [low, high): (start, end, edits), or
    None beyond the budget. Cells hold edits and start in one number, so that the smallest
    carries both; row by row, a band of diagonals wide."""
    first = max(0, low)
    for at in occurrences(item, text[first : max(first, high + len(item))]):
        return first + at, first + at + len(item), 0
    low, high = low - budget, high + budget
    width = high - low
    big = np.int64(len(item) + width + 2) * _COST
    columns = low + np.arange(width)
    inside = (columns >= 0) & (columns <= len(text))
    row = np.where(inside, columns, big)
    slope = np.arange(width, dtype=np.int64) * _COST
    for k, letter in enumerate(item):
        at = columns + k
        ok = (at >= 0) & (at < len(text))
        same = np.zeros(width, dtype=bool)
        same[ok] = text[at[ok]] == letter
        change = np.where(ok, row + np.where(same, np.int64(0), _COST), big)
        leave = np.append(row[1:] + _COST, big)
        best = np.minimum(change, leave)
        best[(at + 1 < 0) | (at + 1 > len(text))] = big
        row = np.minimum.accumulate(best - slope) + slope
    ends = columns + len(item)
    row[(ends < 0) | (ends > len(text))] = big
    best = int(np.argmin(row))
    edits, start = divmod(int(row[best]), int(_COST))
    return (start, int(ends[best]), edits) if edits <= budget else None


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per region: doc_id, item_id, start, end (code points, exclusive), edits.

    Letters are compared without case (ß, whose capital is two letters, only with itself
    and its one-letter capital), ASCII white space as blanks. Items up to the
    edit budget (ERRORS of their length, but at most one edit per q characters) are
    found; items shorter than q must occur exactly. Null and empty texts and items have no
    regions; rows that share an id report theirs under it; other columns are not read.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text")).where("length(text) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // ITEM_BLOCK) or 1
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           *[T.StructField(n, T.LongType()) for n in ("item_id", "start", "end", "edits")]])
    read = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).where(F.length(F.col(f"`{text_col}`")) > 0)
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        held = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in own])

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value)
            for batch in batches:
                rows, texts, first, size = [], [], 0, 0
                column = batch.column(1)
                for n in range(batch.num_rows):
                    texts.append(column[n].as_py())
                    size += len(texts[-1])
                    if size >= TEXT_BLOCK or n == batch.num_rows - 1:
                        rows += [(first + d, *rest) for d, *rest in index.search(texts)]
                        texts, first, size = [], n + 1, 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                     *[pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5)]],
                    names=["doc_id", "item_id", "start", "end", "edits"])

        found = read.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a region, all columns intact. Rows are told
    apart by their texts, so that rows without id, or of one id, are each judged by their own."""
    text = F.xxhash64(F.col(f"`{text_col}`"))
    read = docs.select(text.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    bad = contaminated_regions(read, benchmark).select(F.col("doc_id").alias("bad")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("name"))  # its columns may have any names
    return rows.join(bad, F.col("name") == F.col("bad"), "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
