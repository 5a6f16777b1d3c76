"""Packing of tokenised documents into fixed windows.

Whole windows are cut from long documents. The remainders form a histogram of lengths;
shallow combinations of two or three lengths fill a window exactly, and a non-negative
least-squares fit gives the number of times each is used. Rounded and clipped to the
histogram, these windows take whole remainders; what is left over is laid end to end and
cut at the window size, its tail into powers of two, so that nothing needs padding.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daygrid.llm.text import BLOCK
from daygrid.session import durable

WINDOW = 4096
#: Words that a task remembers, and steps of the fit.
REMEMBERED, STEPS = 600_000, 400
#: The middle length of a triple lies this far (in windows) behind its shortest one.
OFFSETS = (0, 1 / 32, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 5 / 16, 3 / 8)
#: Punctuation that is a unit of its own behind a word of letters, and the letter up to
#: which (but for one) lower case and normal form of a letter are one letter.
_TAIL, _LAST_LATIN, _DOTTED = "!,.%#*$&|:;?", "\u024f", "\u0130"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is a
    printable Latin-1 character, else the next one from U+0100 on."""
    spare = iter(range(256, 512))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b if b in shown else next(spare)) for b in range(256)}


class _Known(dict):
    """Packed ids by word; a word that is asked for the first time is encoded."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = self.learn(word)
        return ids


class WordTokenizer:
    """Ids of whole texts, a distinct word at a time.

    Right for tokenizers that lower-case, drop white space and encode the parts of a text
    between white space independently; then a word's ids can be remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.kind.itemsize]
        self.letters = _byte_letters()
        self.merge = self.tokenizer.model.tokenize
        self.known = _Known(self._learn)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _core(self, core: str) -> bytes:
        """Ids of a word of letters only, which is one unit to the merges."""
        shown = core if core.isascii() else "".join(map(self.letters.__getitem__, core.lower().encode()))
        return self._packed([t.id for t in self.merge(shown)])

    def _learn(self, word: bytes) -> bytes:
        if word.isalpha():
            return self._core(word.decode())
        text = word.decode("utf-8", "replace")
        core = text.rstrip(_TAIL)
        if core.isalpha() and (core.isascii() or max(core) <= _LAST_LATIN and _DOTTED not in core):
            if len(core) == len(text):
                return self._core(core)
            return self.known[core.encode()] + self.known[text[len(core):].encode()]
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, docs: list[bytes | None], end: int) -> list[bytes]:
        """The ids of each text and then ``end``, as packed little-endian numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        last, ids = self._packed([end]), self.known.__getitem__
        return [b"".join(map(ids, (d or b"").lower().split())) + last for d in docs]


def blocks(docs: list[bytes | None]) -> Iterator[list[bytes | None]]:
    held, size = [], 0
    for d in docs:
        held.append(d)
        size += len(d or b"")
        if size > BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def tokenised(docs: DataFrame, path: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, ids): the tokens of every row with its end token, as packed numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        for batch in batches:
            ids = [x for held in blocks(batch.column(1).to_pylist()) for x in tokenizer.encode(held, end)]
            n = [len(x) // tokenizer.kind.itemsize for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.large_binary()).cast(pa.binary())],
                                             names=["doc_id", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary"))
    return read.mapInArrow(encode, f"doc_id {kind}, n long, ids binary")


def combinations(window: int, have: np.ndarray) -> np.ndarray:
    """Rows of three lengths (the last 0 in a pair) of which ``have`` has some, filling the window."""
    a = np.arange(1, window // 2 + 1)
    found = [np.stack([a, window - a, np.zeros_like(a)], axis=1)]
    for shift in OFFSETS:
        b = a + int(shift * window)
        three = np.stack([a, b, window - a - b], axis=1)
        found.append(three[three[:, 2] >= 1])
    rows = np.unique(np.sort(np.concatenate(found), axis=1)[:, ::-1], axis=0)
    return rows[(have[rows] > 0).all(axis=1)] if len(rows) else rows


def least_squares(rows: np.ndarray, have: np.ndarray) -> np.ndarray:
    """x >= 0 minimising the squared distance of the lengths used from the histogram:
    accelerated projected gradient steps on the sparse incidence of combinations."""
    target = have.astype(float)
    target[0] = 0
    real = (rows > 0).astype(float)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (real * x[:, None]).ravel(), minlength=len(have))

    def back(y: np.ndarray) -> np.ndarray:
        return (y[rows] * real).sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(20):
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(used(v))))
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, z - step * back(used(z) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def repeats(rows: np.ndarray, fit: np.ndarray, have: np.ndarray) -> np.ndarray:
    """The fit rounded, largest first, never using a length more often than it occurs."""
    left = have.copy()
    out = np.zeros(len(rows), dtype=np.int64)
    for wanted in (np.rint(fit).astype(np.int64), have[rows[:, 0]]):  # the second fills up what rounding left
        for k in np.argsort(-wanted, kind="stable"):
            if wanted[k] <= 0:
                break
            sizes, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
            n = min(wanted[k], (left[sizes] // times).min())
            out[k] += n
            left[sizes] -= n * times
    return out


def slots(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of ranks per length: (key of first rank, end rank, first sequence, offset), by key."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for row, n in zip(rows.tolist(), times.tolist(), strict=True):
        if not n:
            continue
        at = 0
        for size in (s for s in row if s):
            first = taken.get(size, 0)
            out.append((size << 44 | first, first + n, sequence, at))
            taken[size] = first + n
            at += size
        sequence += n
    out.sort()
    return tuple(np.array([r[i] for r in out], dtype=np.int64) for i in range(4)) + (sequence,)


def _placed(ranked: DataFrame, table: tuple[np.ndarray, ...]) -> DataFrame:
    """(_row, full, rest, bucket, sequence, offset): remainders in combination windows; sequence -1 elsewhere."""
    keys, ends, first, offsets = ranked.sparkSession.sparkContext.broadcast(table[:4]), None, None, None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_, ends_, first_, offsets_ = keys.value
        for batch in batches:
            size, rank = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            if len(keys_):
                at = np.searchsorted(keys_, size << 44 | rank, side="right") - 1
                near = np.maximum(at, 0)
                hit = (at >= 0) & (keys_[near] >> 44 == size) & (rank < ends_[near]) & (size > 0)
                sequence = np.where(hit, first_[near] + rank - (keys_[near] & ((1 << 44) - 1)), -1)
                offset = np.where(hit, offsets_[near], 0)
            else:
                sequence, offset = np.full(len(size), -1), np.zeros(len(size), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             names=["_row", "full", "rest", "bucket", "sequence", "offset"])

    return ranked.select("_row", "full", "rest", "bucket", "rank").mapInArrow(
        place, "_row long, full long, rest long, bucket long, sequence long, offset long")


def _offsets(totals: DataFrame, names: list[str]) -> tuple[DataFrame, list[int]]:
    """Running sums before each bucket; one row per shuffle partition, so a driver table."""
    rows = sorted(totals.collect(), key=lambda r: r["bucket"])
    sums, out = [0] * len(names), []
    for r in rows:
        out.append((r["bucket"], *sums))
        sums = [s + r[n] for s, n in zip(sums, names, strict=True)]
    schema = "bucket long, " + ", ".join(f"before_{n} long" for n in names)
    return F.broadcast(totals.sparkSession.createDataFrame(out, schema)), sums


def pack(docs: DataFrame, tokenizer: str, end: int = 2, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, if asked for, ids.

    Every id of every row lies in one piece; pieces of a sequence are gapless from offset
    0. All sequences are full but those of the tail, whose lengths are powers of two.
    ``window`` is a power of two below 2^16. Null and empty texts are their end token
    alone; rows that share an id are packed on their own; other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = durable(tokenised(docs, tokenizer, end, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    lengths = durable(stored.select(
        "_row", F.expr(f"n div {window}").alias("full"), (F.col("n") % window).alias("rest"),
        F.pmod(F.xxhash64("_row"), F.lit(parts)).alias("bucket")), "lengths")

    have = np.zeros(window + 1, dtype=np.int64)
    for r in lengths.where("rest > 0").groupBy("rest").count().collect():  # at most window - 1 rows
        have[r["rest"]] = r["count"]
    rows = combinations(window, have + (np.arange(window + 1) == 0))
    times = repeats(rows, least_squares(rows, have), have) if len(rows) else np.zeros(0, dtype=np.int64)
    table = slots(rows, times)

    cells = lengths.groupBy("rest", "bucket").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("count")).drop("count")
    ranked = (lengths.withColumn("local", F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("_row")))
              .join(cells, ["rest", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1))
    placed = durable(_placed(ranked, table), "placed")

    loose = F.when(F.col("sequence") < 0, F.col("rest")).otherwise(0)
    before, (full_windows, stream) = _offsets(
        placed.groupBy("bucket").agg(F.sum("full").alias("full"), F.sum(loose).alias("loose")), ["full", "loose"]) \
        if not placed.isEmpty() else (None, (0, 0))
    if before is None:
        return spark.createDataFrame([], _schema(docs, id_col, with_ids))
    upto = Window.partitionBy("bucket").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    plan = (placed.withColumns({"_f": F.coalesce(F.sum("full").over(upto), F.lit(0)), "_l": F.coalesce(F.sum(loose).over(upto), F.lit(0))})
            .join(before, "bucket")
            .select("_row", "sequence", "offset", (F.col("before_full") + F.col("_f") + table[4]).alias("first"),
                    (F.col("before_loose") + F.col("_l")).alias("place")))
    tail = stream - stream % window
    cuts = [tail]
    for bit in reversed(range(window.bit_length())):
        if stream % window >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    return _cut(stored.join(plan, "_row"), window, table[4] + full_windows, cuts, _schema(docs, id_col, with_ids), with_ids)


def _schema(docs: DataFrame, id_col: str, with_ids: bool) -> str:
    kind = docs.schema[id_col].dataType.simpleString()
    return (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
            + ", ids array<int>" * with_ids)


def pieces(n: int, window: int, sequence: int, offset: int, first: int, place: int, base: int, cuts: list[int]) -> Iterator[tuple]:
    """(start, length, sequence, offset) of one document."""
    full, rest = divmod(n, window)
    for k in range(full):
        yield k * window, window, first + k, 0
    start = full * window
    if rest and sequence >= 0:
        yield start, rest, sequence, offset
    elif rest:
        at, end = place, place + rest
        while at < end:
            if at < cuts[0]:
                begin = at - at % window
                stop, number = begin + window, base + at // window
            else:
                k = int(np.searchsorted(cuts, at, side="right")) - 1
                begin, stop, number = cuts[k], cuts[k + 1], base + cuts[0] // window + k
            yield start + at - place, min(stop, end) - at, number, at - begin
            at = min(stop, end)


def _cut(rows: DataFrame, window: int, base: int, cuts: list[int], schema: str, with_ids: bool) -> DataFrame:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out, tokens = [], [], []
            for i, r in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                n, packed, *where = r
                ids = np.frombuffer(packed, dtype="<u2" if len(packed) == 2 * n else "<u4")
                for start, length, sequence, offset in pieces(n, window, *where, base, cuts):
                    own = ids[start : start + length].astype("<u4")
                    owner.append(i)
                    out.append((start, length, zlib.crc32(own.tobytes()), n, sequence, offset))
                    if with_ids:
                        tokens.append(own)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())),
                       *[pa.array([x[k] for x in out], pa.int64()) for k in range(6)]]
            if with_ids:
                lengths = np.cumsum([0, *[len(t) for t in tokens]])
                flat = np.concatenate(tokens).astype(np.int32) if tokens else np.zeros(0, dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    return rows.select("doc_id", "n", "ids", "sequence", "offset", "first", "place").mapInArrow(cut, schema)
