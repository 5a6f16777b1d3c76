"""The trie of conversation prefixes, with a count-min screen before exact grouping.

Turns are dealt by blocks of conversations that share a head, and streamed in order: every
turn becomes a digest of the prefix that it ends. A count-min sketch of these digests, two
saturating bits a counter, is merged from all tasks; an estimate of one proves that a prefix
belongs to a single conversation, and so do all its continuations, which are emitted where
they are. Only prefixes that may be shared are shuffled and grouped exactly. Sums over
subtrees run down each conversation's own path once and are then added by prefix, so that
no step walks the trie level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.llm.text import hash_number, mix
from daygrid.operators.skew import lookup
from daygrid.session import durable

#: Rows of the sketch, counters of a row for each prefix, and bytes that a whole sketch may
#: take: beyond these the screen proves fewer prefixes alone, and results stay the same.
DEPTH, PER_PREFIX, SKETCH_BYTES = 3, 4, 16 << 20
#: Counters of a slice, the unit in which tasks pass on their part of the sketch.
SLICE = 1 << 16
#: A prefix with a LARGE-th of all children is looked up by broadcast.
LARGE = 1 << 12
#: Conversations of a block share the first one's head, at most three turns long.
BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _turns(conv: DataFrame) -> DataFrame:
    """(block, conv_id, turn, role, h, g, words): texts become two hashes and a word count."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.col("conv_id").cast("long")
    return conv.where("conv_id is not null").select(
        (own - own % BLOCK).alias("block"), own.alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h"), F.xxhash64(F.lit(1), role, text).alias("g"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        (F.crc32(own.cast("string").cast("binary")) % HEADS).cast("int").alias("head"))


_PATH = "conv_id long, depth long, a long, b long, pa long, pb long, words long, last boolean"


class _Stream:
    """Prefix digests of ordered turns; what it holds is one batch and three turns of a head."""

    def __init__(self) -> None:
        self.block: int | None = None
        self.conv: int | None = None
        self.first: list[tuple[int, int, int]] = []
        self.seen = self.skip = 0
        self.depth = 0
        self.a = self.b = np.uint64(0)
        self.held: list[tuple] = []

    def _put(self, h: np.ndarray, g: np.ndarray, words: np.ndarray) -> None:
        """More turns at the end of the present conversation."""
        if not len(h):
            return
        at = (np.arange(self.depth + 1, self.depth + len(h) + 1).astype(np.uint64)) * _BASE
        a = self.a + np.cumsum(mix(h ^ at), dtype=np.uint64)
        b = self.b + np.cumsum(mix(g + at), dtype=np.uint64)
        pa_, pb = np.concatenate([[self.a], a[:-1]]), np.concatenate([[self.b], b[:-1]])
        depth = np.arange(self.depth + 1, self.depth + len(h) + 1)
        self.held.append((np.full(len(h), self.conv), depth, a, b, pa_, pb, words, np.zeros(len(h), dtype=bool)))
        self.depth, self.a, self.b = self.depth + len(h), a[-1], b[-1]

    def _begin(self, block: int, conv: int, head: int) -> None:
        if block != self.block:
            self.block, self.first = block, []
        self.conv, self.skip, self.seen, self.depth = conv, head, 0, 0
        self.a = self.b = np.uint64(0)
        zero = np.zeros(1, dtype=np.uint64)
        self.held.append((np.array([conv]), np.zeros(1, dtype=np.int64), zero, zero, zero, zero, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=bool)))
        if conv != block and self.first:
            h, g, w = zip(*self.first[:head], strict=True) if head else ((), (), ())
            self._put(np.array(h, dtype=np.uint64), np.array(g, dtype=np.uint64), np.array(w, dtype=np.int64))

    def _end(self) -> None:
        """The last row so far ends its conversation."""
        if self.conv is not None:
            self.held[-1][-1][-1] = True

    def add(self, block, conv, head, h, g, words) -> None:
        edges = np.flatnonzero(np.diff(conv)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(conv)], strict=True):
            if conv[lo] != self.conv:
                self._end()
                self._begin(int(block[lo]), int(conv[lo]), int(head[lo]))
            if self.conv == self.block:
                for k in range(lo, min(hi, lo + HEADS - 1 - len(self.first))):
                    self.first.append((int(h[k]), int(g[k]), int(words[k])))
                self._put(h[lo:hi], g[lo:hi], words[lo:hi])
            else:
                start = lo + min(max(self.skip - self.seen, 0), hi - lo)
                self._put(h[start:hi], g[start:hi], words[start:hi])
            self.seen += hi - lo

    def taken(self, final: bool) -> pa.RecordBatch | None:
        """All finished rows; the last one waits until it is known whether it ends its conversation."""
        if final:
            self._end()
        if not self.held:
            return None
        cols = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        keep = len(cols[0]) - (0 if final else 1)
        self.held = [] if final else [tuple(c[keep:].copy() for c in cols)]
        arrays = [pa.array(c[:keep].view(np.int64) if c.dtype == np.uint64 else c[:keep]) for c in cols]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "depth", "a", "b", "pa", "pb", "words", "last"])


def paths(conv: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, words, last): a row for every prefix of every rebuilt
    conversation, the textless one included, with its digest and its parent's."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream()
        for batch in batches:
            block, own, head, words = (batch.column(k).to_numpy() for k in (0, 1, 2, 5))
            h, g = (batch.column(k).to_numpy().view(np.uint64) for k in (3, 4))
            if len(own):
                state.add(block, own, head, h, g, words)
                yield state.taken(False)
        done = state.taken(True)
        if done is not None:
            yield done

    # the block's first conversation comes first: the others take their heads from it
    order = ["block", F.col("conv_id") != F.col("block"), "conv_id", F.col("turn").asc_nulls_first(), "role", "h", "g"]
    dealt = _turns(conv).repartition("block").sortWithinPartitions(*order)
    return dealt.select("block", "conv_id", "head", "h", "g", "words").mapInArrow(stream, _PATH)


def _cells(a: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of every digest in each row of the sketch."""
    return [(mix(a + np.uint64(hash_number(r, 13))) % np.uint64(width)).astype(np.int64) + r * width for r in range(DEPTH)]


def _raised(counts: np.ndarray, cells: np.ndarray) -> None:
    """Counters go up to two and no further: one and many are all that the screen tells apart."""
    names, n = np.unique(cells, return_counts=True)
    counts[names] = np.minimum(counts[names] + n, 2)


def sketch_width(prefixes: int) -> int:
    """Counters of a row: a power of two that follows the prefixes up to the bound in bytes."""
    return 1 << max(8, min((PER_PREFIX * max(prefixes, 1) - 1).bit_length(), (SKETCH_BYTES * 4 // DEPTH).bit_length() - 1))


def sketch(found: DataFrame, width: int) -> np.ndarray:
    """The merged count-min sketch, four counters a byte, of all prefixes but the textless."""
    size = DEPTH * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = np.sort(np.concatenate(_cells(batch.column(0).to_numpy().view(np.uint64), width)))
            for part in np.split(cells, np.flatnonzero(np.diff(cells // SLICE)) + 1):
                if len(part):
                    _raised(own.setdefault(int(part[0]) // SLICE, np.zeros(SLICE, dtype=np.uint8)), part % SLICE)
        for k, counts in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["slice", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            quad = total.reshape(-1, 4)
            packed = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([packed.tobytes()], pa.binary())], names=["slice", "counts"])

        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(counts.as_buffer(), dtype=np.uint8)
                if k == now:
                    total = np.minimum(total + one, 2)
                else:
                    if now is not None:
                        yield out()
                    now, total = k, one
        if now is not None:
            yield out()

    parts = found.where("depth > 0").select("a").mapInArrow(count, "slice long, counts binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice long, counts binary")
    packed = np.zeros(-(-size // SLICE) * SLICE // 4, dtype=np.uint8)
    for row in merged.collect():  # at most SKETCH_BYTES in all
        packed[row["slice"] * (SLICE // 4) : (row["slice"] + 1) * (SLICE // 4)] = np.frombuffer(row["counts"], dtype=np.uint8)
    return packed


def screened(found: DataFrame, packed: np.ndarray, width: int) -> DataFrame:
    """``found`` with ``alone`` and ``parent_alone``: whether the sketch proves that only one
    conversation has the prefix, or its parent."""
    shared = found.sparkSession.sparkContext.broadcast(packed)

    def alone(a: np.ndarray) -> np.ndarray:
        low = np.full(len(a), 3, dtype=np.uint8)
        for cells in _cells(a, width):
            low = np.minimum(low, shared.value[cells >> 2] >> ((cells & 3) * 2).astype(np.uint8) & 3)
        return low == 1

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = batch.column(1).to_numpy()
            own = alone(batch.column(2).to_numpy().view(np.uint64)) & (depth > 0)
            above = alone(batch.column(4).to_numpy().view(np.uint64)) & (depth > 1)
            # a prefix below one that is alone is alone as well, whatever its own estimate
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own | above), pa.array(above)], names=[*batch.schema.names, "alone", "parent_alone"])

    return found.mapInArrow(screen, f"{_PATH}, alone boolean, parent_alone boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """(a, b, ends): SHA-256 over the ascending ids of the conversations that end with each
    prefix. Range partitions join the ids to blocks; one task per prefix then only feeds
    blocks to the hash, which has to see them one after another."""
    import hashlib

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            starts = np.concatenate([[0], cuts]) if len(a) else np.zeros(0, dtype=np.int64)
            stops = np.concatenate([cuts, [len(a)]]) if len(a) else starts
            text = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(ids[starts]), pa.array(text, pa.string())],
                                             names=["a", "b", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for a, b, ids in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3)], strict=True):
                if (a, b) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield _hashes(done)
        if now is not None:
            yield _hashes([(*now, state.hexdigest())])

    blocks = rows.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    joined = durable(blocks.mapInArrow(block, "a long, b long, first long, ids string"), "end-blocks")
    return joined.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends string")


def _hashes(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["a", "b", "ends"])


def prefix_trie(conv: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``conv`` has conv_id, turn, role and text. A conversation's turns stand in the order of
    ``turn``, null first, equal numbers by role and then by a hash of the text; null roles
    and texts are empty. Conversation c is rebuilt from the first h turns of c - c % 20
    (fewer if it has fewer, none if it is not in the table) and its own turns after its
    first h, with h the CRC-32 of the decimal c modulo 4. Nodes are the distinct sequences
    of first turns, from the textless root. Repeated rows are turns like any other; rows
    without conv_id take no part; an empty table has no nodes.
    """
    found = durable(paths(conv.select("conv_id", "turn", "role", "text")), "paths")
    width = sketch_width(found.where("depth > 0").count())
    known = durable(screened(found, sketch(found, width), width), "screened")
    single = known.where("alone")
    tops = single.where("not parent_alone").select("conv_id", "depth", "pa", "pb")
    shared = known.where("not alone")
    nodes = durable(shared.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.count("*").alias("n_convs"), F.min("words").alias("words")), "shared-prefixes")

    kids = (nodes.where("depth > 0").select("pa", "pb").unionByName(tops.select("pa", "pb")).groupBy("pa", "pb")
            .agg(F.count("*").alias("n_children")).select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children"))
    nodes = durable(nodes.join(kids, ["a", "b"], "left").fillna(0, ["n_children"]), "shared-nodes")

    # what each node adds to all nodes above: told to the path of its smallest conversation
    none = F.lit(None).cast("long")
    adds = nodes.select("conv_id", "depth", none.alias("a"), none.alias("b"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                        (F.col("n_children") == 0).cast("long").alias("leaves")).where("saved > 0 or leaves > 0")
    ends = single.where("last").select("conv_id", "depth", none.alias("a"), none.alias("b"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves"))
    path = shared.select("conv_id", "depth", "a", "b", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"))
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = adds.unionByName(ends).unionByName(path).select("a", "b", F.sum("saved").over(below).alias("saved"), F.sum("leaves").over(below).alias("leaves"))
    sums = (told.where("a is not null and (saved > 0 or leaves > 0)").groupBy("a", "b")
            .agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))
    full = durable(nodes.join(sums, ["a", "b"], "left").join(_ends(shared.where("last")), ["a", "b"], "left"), "summed-nodes")

    # parents: the few prefixes with a large share of all children are hot
    names = full.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_kids"))
    children = full.agg(F.sum("n_children")).first()[0] or 0
    zero, one, empty = F.lit(0).cast("long"), F.lit(1).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    own_end = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(empty)
    alone = {"n_convs": one, "n_children": F.when(F.col("last"), zero).otherwise(one), "n_leaves": one, "saved_tokens": zero, "ends_sha256": own_end}
    measures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    exact = full.withColumn("ends_sha256", F.coalesce("ends", empty)).fillna(0, ["n_leaves", "saved_tokens"])
    above = durable(exact.where("depth > 0").select("conv_id", "depth", "pa", "pb", *measures).unionByName(
        single.where("not parent_alone").select("conv_id", "depth", "pa", "pb", *[c.alias(n) for n, c in alone.items()])), "nodes-below")
    out = ["conv_id", "depth", "parent_conv_id", *measures]
    # a node whose parent is not among them hangs below one that was proven alone
    met = lookup(above, names.where("_kids > 0"), ["pa", "pb"], F.col("_kids") >= children / LARGE, "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    tails = single.where("parent_alone").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *[c.alias(n) for n, c in alone.items()])
    root = exact.where("depth = 0").select("conv_id", "depth", none.alias("parent_conv_id"), *measures)
    return root.unionByName(met.select(*out)).unionByName(tails.select(*out))
