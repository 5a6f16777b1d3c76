"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

Word counts of all training texts give the base model and the vocabulary: the commonest
words are classes of their own; the others that occur twice or more are grouped by the
common word that they stand beside more than others do; words seen once share a class with
unknown ones. The log-bilinear model predicts the class from the two before it, and inside a
class words are told apart by their counts. The model's context acts as a sum, so the normaliser of every context is one cell of a matrix product
of two exponentiated score tables, and every token's log-probability is normalised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.llm.text import doc_words, hash_number
from daygrid.session import durable

#: Words (16 bytes each) whose counts travel to the tasks; the others' counts are joined.
SHIPPED = 1 << 17
CLASSES, SIZE, ROUNDS, BATCH, NOISE, RATE = 1024, 16, 4, 2048, 32, 0.06
END, RARE = 0, 1
#: Common words that group others, those before and those behind them; words that are grouped
#: occur LEAST times.
ANCHORS, LEAST = 128, 2
GROUPS = 2 * ANCHORS
#: Taken off the count of every word of the shared class and given to unknown words as one.
DISCOUNT = 0.5
#: The training share is all but one remainder in this many.
FOLDS, HELD = 7, 2


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text falls on the held-out remainder; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, c): hashed words of all training texts, the end token among them."""
    end = np.uint64(hash_number(END, 9)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = list(doc_words(batch.column(0).to_pylist(), lower=True))
            keys, n = np.unique(np.concatenate([*words, np.zeros(0, dtype=np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys.view(np.int64), end)), pa.array(np.append(n, len(words)).astype(np.int64))],
                                             names=["word", "c"])

    texts = docs.where(~held_out(id_col)).select(F.col(f"`{text_col}`").cast("binary"))
    return texts.mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


class Lookup:
    """Place of each known hash: one table slot by its leading bits, and a short list of
    the hashes that lost their slot."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.table = np.zeros(1 << 20, dtype=np.int32)
        slot = (keys >> np.uint64(44)).astype(np.int64)
        self.table[slot] = np.arange(len(keys))
        lost = np.flatnonzero(self.table[slot] != np.arange(len(keys)))
        self.lost = lost[np.argsort(keys[lost])]

    def find(self, words: np.ndarray) -> np.ndarray:
        """Index into ``keys``, or -1."""
        if not len(self.keys):
            return np.full(len(words), -1)
        at = self.table[(words >> np.uint64(44)).astype(np.int64)]
        at = np.where(self.keys[at] == words, at, -1)
        if len(self.lost):
            miss = np.flatnonzero(at < 0)
            near = np.minimum(np.searchsorted(self.keys[self.lost], words[miss]), len(self.lost) - 1)
            found = self.lost[near]
            at[miss] = np.where(self.keys[found] == words[miss], found, -1)
        return at


def groups(arrays: Iterator[np.ndarray], size: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for a in arrays:
        held.append(a)
        n += len(a)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def neighbours(docs: DataFrame, top: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(word, group): for every shipped word that is no class of its own, the group in which it
    stands most often for the group's size; counted over all training texts.

    ``top`` holds the sorted hashes and, for each, 1 + its number among the anchors, 0 for a
    word to be grouped, -1 otherwise. ``word`` is its place there.
    """
    held = docs.sparkSession.sparkContext.broadcast(top)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, role = held.value
        lookup, role = Lookup(keys), np.append(role, -1)
        for batch in batches:
            for some in groups(doc_words(batch.column(0).to_pylist(), lower=True)):
                at = np.concatenate([np.append(lookup.find(w), -1) for w in some])
                what = role[at]
                after = np.flatnonzero((what[1:] == 0) & (what[:-1] > 0)) + 1
                before = np.flatnonzero((what[:-1] == 0) & (what[1:] > 0))
                pairs = np.concatenate([at[after] * GROUPS + what[after - 1] - 1, at[before] * GROUPS + ANCHORS + what[before + 1] - 1])
                pair, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair // GROUPS), pa.array(pair % GROUPS), pa.array(n.astype(np.int64))], names=["word", "group", "n"])

    texts = docs.where(~held_out(id_col)).select(F.col(f"`{text_col}`").cast("binary"))
    counts = durable(texts.mapInArrow(count, "word long, group long, n long").groupBy("word", "group").agg(F.sum("n").alias("n")), "word-neighbours")
    sizes = counts.groupBy("group").agg(F.sum("n").alias("size"))  # at most GROUPS rows
    share = F.col("n") / F.pow("size", F.lit(0.75))
    return counts.join(F.broadcast(sizes), "group").groupBy("word").agg(F.max_by("group", F.struct(share, -F.col("group"))).alias("group"))


_ENCODED = ("doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_log double, inside_log double, classes binary, "
            "other array<struct<word: long, n: long>>")


def encoded(docs: DataFrame, top: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], end_count: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: its class sequence, its sums over shipped words (``top``: sorted hashes, counts,
    classes, log-probabilities inside the class), and its other words."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(top)
    other_type = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, classes, within = held.value
        lookup = Lookup(keys)
        logs, inside = np.append(np.log10(counts + 1.0), 0.0), np.append(within, 0.0)
        names = np.append(classes, RARE).astype(np.uint16)
        end_log = np.log10(end_count + 1.0)
        for batch in batches:
            n, known, base, within, seq, off, other_w, other_n = [], [], [], [], [], [0], [], []
            for some in groups(doc_words(batch.column(2).to_pylist(), lower=True)):
                flat = np.concatenate(some)
                at = lookup.find(flat)
                value, name = logs[at], names[at]
                cut = 0
                for words in some:
                    own = slice(cut, cut + len(words))
                    cut += len(words)
                    miss = words[at[own] < 0]
                    w, k = np.unique(miss, return_counts=True)
                    seq.append(np.append(name[own], np.uint16(END)).tobytes())
                    n.append(len(words) + 1)
                    known.append(len(words) - len(miss) + int(end_count > 0))
                    base.append(float(value[own].sum()) + end_log)
                    within.append(float(inside[at[own]].sum()))
                    other_w.append(w.view(np.int64))
                    other_n.append(k)
                    off.append(off[-1] + len(w))
            items = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64)) for x in (other_w, other_n)],
                                               fields=list(other_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(within, pa.float64()), pa.array(seq, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(off, pa.int32()), items)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_log", "inside_log", "classes", "other"])

    read = docs.select(F.col(f"`{id_col}`"), held_out(id_col).alias("held"), F.col(f"`{text_col}`").cast("binary"))
    return read.mapInArrow(encode, _ENCODED.format(kind=kind))


class LogBilinear:
    """score(w | v1, v2) = (near * R[v1] + far * R[v2]) . Q[w] + b[w].

    All numbers lie in one vector, with the squared-gradient sums of the optimiser behind
    the parameters, so that models can be averaged.
    """

    def __init__(self, vector: np.ndarray, classes: int, size: int) -> None:
        self.vector = np.array(vector, dtype=float)
        cuts = np.cumsum([classes * size, classes * size, classes, size, size])
        values, sums = np.split(self.vector, 2)
        self.parts, self.sums = np.split(values, cuts[:-1]), np.split(sums, cuts[:-1])
        for group in (self.parts, self.sums):
            group[0], group[1] = group[0].reshape(classes, size), group[1].reshape(classes, size)

    @classmethod
    def start(cls, unigram: np.ndarray, size: int) -> LogBilinear:
        draw = np.random.default_rng(0)
        small = draw.normal(0, 0.1, 2 * len(unigram) * size)
        values = np.concatenate([small, np.log(unigram), np.ones(size), np.full(size, 0.5)])
        return cls(np.concatenate([values, np.ones(len(values))]), len(unigram), size)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (last, next), scores by (last but one, next), and the log-normaliser
        by (last, last but one), which is one matrix product."""
        context, target, bias, near, far = self.parts
        one = (context * near) @ target.T + bias
        two = (context * far) @ target.T
        top_one, top_two = one.max(axis=1), two.max(axis=1)
        norm = np.log(np.exp(one - top_one[:, None]) @ np.exp(two - top_two[:, None]).T)
        return one, two, norm + top_one[:, None] + top_two[None, :]

    def train(self, v1: np.ndarray, v2: np.ndarray, y: np.ndarray, unigram: np.ndarray, draw: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation with adaptive steps. Equal triples are
        taken once, with their number as weight; a minibatch shares its noise words."""
        context, target, bias, near, far = self.parts
        classes, size = target.shape
        noise_log, edges = np.log(NOISE * unigram), np.cumsum(unigram)
        triples, times = np.unique((v1 * classes + v2) * classes + y, return_counts=True)

        def spread(index: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(index, rows[:, j], minlength=classes) for j in range(size)], axis=1)

        order = draw.permutation(len(triples))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            weight = times[pick].astype(float)
            rest, w = np.divmod(triples[pick], classes)
            a, b = np.divmod(rest, classes)
            noise = np.minimum(np.searchsorted(edges, draw.random(NOISE) * edges[-1]), classes - 1)
            ra, rb = context[a], context[b]
            p = ra * near + rb * far
            q, qn = target[w], target[noise]
            true = np.minimum((p * q).sum(axis=1) + bias[w] - noise_log[w], 30)
            false = np.minimum(noise_log[noise] - p @ qn.T - bias[noise], 30)
            gt = weight / (1 + np.exp(true))
            gf = -weight[:, None] / (1 + np.exp(false))
            dp = gt[:, None] * q + gf @ qn
            dq, db = spread(w, gt[:, None] * p), np.bincount(w, gt, minlength=classes)
            np.add.at(dq, noise, gf.T @ p)
            np.add.at(db, noise, gf.sum(axis=0))
            dr = spread(a, dp * near) + spread(b, dp * far)
            for x, g, s in zip(self.parts, (dr, dq, db, (dp * ra).sum(axis=0), (dp * rb).sum(axis=0)), self.sums, strict=True):
                s += g * g
                x += RATE * g / np.sqrt(s)


def contexts(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last, last but one, next, lengths) of all tokens; a text begins after two ends."""
    lengths = np.array([len(x) // 2 for x in rows], dtype=np.int64)
    y = np.frombuffer(b"".join(rows), dtype=np.uint16).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    v1 = np.concatenate([[END], y[:-1]]) if len(y) else y
    v1[begins[lengths > 0]] = END
    v2 = np.concatenate([[END], v1[:-1]]) if len(y) else y
    v2[begins[lengths > 0]] = END
    return v1, v2, y, lengths


def fit(rows: DataFrame, unigram: np.ndarray, size: int = SIZE, rounds: int = ROUNDS) -> LogBilinear:
    """Parameters averaged over the tasks, by tokens, after each of ``rounds`` rounds; the
    rounds divide the training rows among them, so that all are used once.

    A task passes on its parameter vector cell by cell, to be summed by key: the driver
    sees one vector, whatever the number of tasks.
    """
    spark = rows.sparkSession
    model = LogBilinear.start(unigram, size)
    for turn in range(rounds):
        held = spark.sparkContext.broadcast((model.vector, unigram))

        def learn(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            vector, base = held.value
            own, n, draw = LogBilinear(vector, len(base), size), 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                draw = draw or np.random.default_rng([turn, batch.column(0)[0].as_py()])
                v1, v2, y, _ = contexts(batch.column(1).to_pylist())
                own.train(v1, v2, y, base, draw)
                n += len(y)
            if n:
                moved = own.vector * n
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(moved))), pa.array(moved), pa.array(np.full(len(moved), n))],
                                                 names=["cell", "value", "n"])

        part = rows.where(~F.col("held_out") & (F.pmod(F.xxhash64("_row"), F.lit(rounds)) == turn)).select("_row", "classes")
        cells = (part.mapInArrow(learn, "cell long, value double, n long").groupBy("cell")
                 .agg((F.sum("value") / F.sum("n")).alias("value")).toArrow())
        if cells.num_rows:
            vector = np.zeros(cells.num_rows)
            vector[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
            model = LogBilinear(vector, len(unigram), size)
    return model


def _scored(rows: DataFrame, model: LogBilinear) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, norm = held.value.tables()
        for batch in batches:
            out = []
            column = batch.column(1).to_pylist()
            for at in range(0, len(column), 500):
                v1, v2, y, lengths = contexts(column[at : at + 500])
                token = one[v1, y] + two[v2, y] - norm[v1, v2]
                begins = np.cumsum(lengths) - lengths
                out += (np.add.reduceat(token, begins) / np.log(10)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["_row", "class_score"])

    return rows.select("_row", "classes").mapInArrow(score, "_row long, class_score double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability of the whole text under the model).

    Null and empty texts are their end token. Without training texts counts are zero and
    all words unknown. Rows that share an id are scored on their own. Words are told apart
    by 64-bit hashes. The parameters depend on how rows are dealt to tasks; counts and
    base scores do not. Other columns are not read.
    """
    counts = durable(word_counts(docs, id_col, text_col), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    best = counts.orderBy(F.desc("c"), "word").limit(SHIPPED).toArrow()
    words, c = best.column(0).to_numpy().view(np.uint64), best.column(1).to_numpy()
    is_end = words == np.uint64(hash_number(END, 9))
    # the end token occurs once per text; where short texts are few it need not be shipped
    end_count = int(c[is_end].sum()) if is_end.any() else int(
        (counts.where(F.col("word") == int(np.uint64(hash_number(END, 9)).astype(np.int64))).select("c").first() or [0])[0])
    words, c = words[~is_end], c[~is_end]
    # words come by falling counts: classes of their own, grouped ones, and those of the shared class
    place = np.arange(len(words))
    own, grouped = place < CLASSES - 2 - GROUPS, (place >= CLASSES - 2 - GROUPS) & (c >= LEAST)
    order = np.argsort(words)
    role = np.where(place < ANCHORS, place + 1, np.where(grouped, 0, -1))
    found = neighbours(docs, (words[order], role[order]), id_col, text_col).toArrow()  # at most SHIPPED rows
    group = np.full(len(words), -1)
    group[order[found.column(0).to_numpy()]] = found.column(1).to_numpy()
    classes = np.where(own, place + 2 + GROUPS, np.where(group >= 0, group + 2, RARE))
    sums = np.bincount(classes, weights=c, minlength=CLASSES)
    rare_words = max(0, total["v"] - int((classes != RARE).sum()) - 1)
    rare_tokens = total["n"] - end_count - int(sums[2:].sum())
    mass = np.ones(CLASSES if len(words) else 2)
    mass[2:] += sums[2 : len(mass)]
    mass[END] += end_count
    mass[RARE] += rare_tokens
    unigram = mass / mass.sum()
    # inside the shared class: (c - DISCOUNT) / tokens of the class, and the rest for unknown words
    unknown, space = (DISCOUNT * rare_words, rare_tokens) if rare_tokens else (1.0, 1.0)
    inside = np.log10(np.where(classes == RARE, c - DISCOUNT, c)) - np.log10(np.where(classes == RARE, space, np.maximum(sums[classes], 1)))
    rows = durable(encoded(docs, (words[order], c[order], classes[order], inside[order]), end_count, id_col, text_col)
                   .withColumn("_row", F.monotonically_increasing_id()), "encoded")
    model = fit(rows, unigram)
    scored = _scored(rows, model)
    count = F.coalesce("c", F.lit(0))
    others = (rows.select("_row", F.explode("other").alias("o")).select("_row", "o.word", "o.n").join(counts, "word", "left")
              .groupBy("_row").agg(F.sum(F.col("n") * F.log10(count + 1)).alias("other_log"),
                                   F.sum(F.when(count > 0, F.col("n") * F.log10(count - DISCOUNT)).otherwise(0.0)).alias("other_rare"),
                                   F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("other_known"), F.sum("n").alias("others")))
    n_known = F.col("n_known") + F.coalesce("other_known", F.lit(0))
    base = F.col("base_log") + F.coalesce("other_log", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total["n"] + total["v"] + 1))
    n_other = F.coalesce("others", F.lit(0))
    unseen = F.col("n_tokens") - n_known - int(end_count == 0)
    within = (F.col("inside_log") + F.coalesce("other_rare", F.lit(0.0)) - n_other * float(np.log10(space)) + unseen * float(np.log10(unknown)))
    return (
        rows.drop("classes", "other").join(scored, "_row").join(others, "_row", "left")
        .select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
                base.alias("base_score"), (F.col("class_score") + within).alias("score"))
    )
