"""Personal data: fixed patterns, and terms of the same documents that give them away.

The information-theoretic part counts over the whole corpus in how many documents a term
stands together with a protected entity (an address or number found by the patterns) and
in how many it stands at all. A term whose pointwise mutual information with the entity
reaches a share of the entity's own information content discloses it: all its occurrences
in documents with the entity are generalised, or removed from a higher share on.

Entities of the same documents have the same counts and are one set. A set in n of all
documents cannot be disclosed by terms above a document frequency that follows from n, and
a set in one document has every term of it once; so only rare terms form pairs, and only
with sets of several documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.llm.text import doc_words
from daygrid.session import durable

#: The kinds in their order, and the patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Documents at the entity's overall rate added to those of every term (a term of one
#: document proves less than one of ten); shares of the entity's information content from
#: which a term is generalised and removed.
PSEUDO, GENERALISE, REMOVE = 0.45, 0.8, 0.97
#: Terms (8 bytes each) up to which the document frequencies are counted for them alone.
TERM_LIST = 1_000_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ backwards: linear in the text."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match, in order."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _entity(text: str, kind: int) -> bytes:
    value = text.lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else "[^0-9]", "", text)
    return f"{KINDS[kind]}:{value}".encode("utf-8", "surrogatepass")


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words that no span (start, kind, end) touches."""
    out, at, reach = [], 0, 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= a:
            out.append((a, b))
    return out


def _terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The free words of a text and their hashes."""
    words = free_words(text, spans)
    return words, _hashes([text[a:b].encode("utf-8", "surrogatepass") for a, b in words])


def _hashes(items: list[bytes]) -> np.ndarray:
    if not items:
        return np.zeros(0, dtype=np.int64)
    return next(doc_words([b" ".join(items)], lower=True)).view(np.int64)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()),
                                   T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))


def _tuples(spans: list[dict]) -> list[tuple[int, int, int]]:
    return [(s["start"], s["rank"], s["end"]) for s in spans]


def detect(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, spans, entities, text) per row: base matches, their hashed values, and the
    text where there are any."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", _SPANS),
                           T.StructField("entities", T.ArrayType(T.LongType())), T.StructField("text", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, entities, texts = [], [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                found = base_spans(text)
                spans.append([{"start": s, "rank": k, "end": e} for s, k, e in found])
                entities.append(np.unique(_hashes([_entity(text[s:e], k).replace(b" ", b"_") for s, k, e in found])).tolist())
                texts.append(text if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS_ARROW), pa.array(entities, pa.list_(pa.int64())),
                                              pa.array(texts, pa.string())], names=["doc_id", "spans", "entities", "text"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(find, schema)


def held_terms(found: DataFrame) -> DataFrame:
    """(_row, term): the distinct free words of each row with an entity."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                _, own = _terms(batch.column(1)[n].as_py(), _tuples(batch.column(2)[n].as_py()))
                own = np.unique(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(0)[n].as_py(), dtype=np.int64)), pa.array(own)],
                                                 names=["_row", "term"])

    return found.where("text IS NOT NULL").select("_row", "text", "spans").mapInArrow(take, "_row long, term long")


def entity_sets(found: DataFrame) -> DataFrame:
    """(_row, set, ne): the sets of entities of each row, and the number of their rows."""
    each = found.select("_row", F.explode("entities").alias("entity"))
    sets = each.groupBy("entity").agg(F.count("*").alias("ne"), F.expr("bit_xor(xxhash64(_row))").alias("set"))
    return each.join(sets, "entity").select("_row", "set", "ne").distinct()


def document_frequencies(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(term, df): documents of the whole corpus that hold each term of ``wanted``.

    Up to TERM_LIST terms travel to the tasks; more of them are counted for all words and
    joined.
    """
    few = wanted.limit(TERM_LIST + 1).toArrow()
    terms = np.sort(few.column(0).to_numpy()) if few.num_rows <= TERM_LIST else None
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            each = []
            for words in doc_words(batch.column(0).to_pylist(), lower=True):
                own = np.unique(words).view(np.int64)
                if known is not None:
                    if not len(known):
                        continue
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[known[at] == own]
                each.append(own)
            keys, n = np.unique(np.concatenate(each) if each else np.zeros(0, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    counted = docs.select(F.col(f"`{text_col}`").cast("binary")).mapInArrow(count, "term long, n long")
    found = counted.groupBy("term").agg(F.sum("n").alias("df"))
    return found if terms is not None else found.join(wanted, "term", "left_semi")


def disclosures(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """(_row, terms (term, rank)): the terms of each row whose share of disclosed information
    is too high for one of its entities."""
    held = durable(held_terms(found), "held-terms")
    frequencies = document_frequencies(docs, held.select("term").distinct(), text_col)
    total = F.lit(float(max(found.count(), 2)))
    sets = entity_sets(found).withColumn("rate", F.col("ne") / total)
    # share >= GENERALISE with net = ne, the most it can be, solved for df
    most = F.col("ne") + PSEUDO * F.col("rate")
    sets = durable(sets.withColumn("df_most", most / F.pow("rate", F.lit(1 - GENERALISE)) - PSEUDO + F.lit(1e-6)), "entity-sets")
    widest = sets.groupBy("_row").agg(F.max("df_most").alias("df_most"))
    rare = held.join(widest, "_row").join(frequencies, "term").where(F.col("df") <= F.col("df_most")).select("_row", "term", "df")
    pairs = durable(rare.join(sets, "_row").where(F.col("df") <= F.col("df_most")).select("_row", "term", "df", "set", "ne", "rate"), "term-pairs")

    content = F.greatest(-F.log2("rate"), F.lit(1e-9))
    pmi = F.log2((F.col("net") + PSEUDO * F.col("rate")) / ((F.greatest("df", "net") + PSEUDO) * F.col("rate")))

    def judged(counted: DataFrame) -> DataFrame:
        rank = F.when(F.col("share") >= REMOVE, F.lit(5)).when(F.col("share") >= GENERALISE, F.lit(4))
        return counted.withColumn("share", pmi / content).withColumn("rank", rank).where("rank IS NOT NULL")

    alone = judged(pairs.where("ne = 1").withColumn("net", F.lit(1))).select("_row", "term", "rank")
    several = pairs.where("ne > 1")
    bad = judged(several.groupBy("set", "term", "df", "ne", "rate").agg(F.count("*").alias("net"))).select("set", "term", "rank")
    shared = several.select("_row", "set", "term").join(bad, ["set", "term"]).select("_row", "term", "rank")
    return (alone.unionByName(shared).groupBy("_row", "term").agg(F.max("rank").alias("rank"))
            .groupBy("_row").agg(F.collect_list(F.struct("term", "rank")).alias("terms")))


def mark(found: DataFrame) -> DataFrame:
    """(doc_id, base, spans): every occurrence of the ``terms`` of a row among its spans."""
    schema = T.StructType([found.schema["doc_id"], T.StructField("base", _SPANS), T.StructField("spans", _SPANS)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, text, terms in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                spans = _tuples(base)
                if terms:
                    ranks = {t["term"]: t["rank"] for t in terms}
                    words, own = _terms(text, spans)
                    spans = sorted(spans + [(a, ranks[h], b) for (a, b), h in zip(words, own.tolist(), strict=True) if h in ranks])
                out.append([{"start": s, "rank": k, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPANS_ARROW)], names=["doc_id", "base", "spans"])

    return found.select("doc_id", "spans", "text", "terms").mapInArrow(place, schema)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` (the base matches) and ``spans`` (start,
    rank, end) sorted by start and rank. Ranks 0 to 3 are the base kinds; 4 is a term to
    generalise, 5 one to remove.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows that
    share an id keep their own spans. Other columns are not read.
    """
    found = durable(detect(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "personal-data")
    bad = durable(disclosures(docs, found, text_col), "disclosures")
    return mark(found.join(bad, "_row", "left"))


NAMES = (*KINDS, "generalise", "remove")


def count_of(spans: str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def shown(spans: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["rank"]], s["start"], s["end"])), ",")


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with base matches and generalised terms named by their kind, and terms to
    remove taken out; where spans overlap, the first to begin wins."""
    if text is None:
        return None
    out, at = [], 0
    for start, rank, end in spans:
        if start < at:
            continue
        out += [text[at:start], "" if rank == 5 else f"[{NAMES[rank].upper()}]"]
        at = end
    return "".join([*out, text[at:]])
