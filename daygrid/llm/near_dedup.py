"""Near-duplicates by a chosen-path set similarity join.

Every distinct shingle set has a sketch of minwise tokens. In each of ``TREES`` independent
trees a document walks from node to node by tokens that the node selects; in nodes with more
than ``LEAF`` documents it goes on by tokens that are rare there, counted over all members,
and is compared with the most central members, smaller nodes are compared exhaustively on their sketches. A pair at
the threshold survives one tree with a probability of about three quarters, hence all trees
fail it once in a million. What the trees link loosely (a spanning forest per node) is
grouped, and links are then confirmed on full sets: first against the most central member of
a group, then, for the members that this leaves alone, in blocks against all others. Groups
of copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.llm.graph import components
from daygrid.llm.text import doc_words, hash_number, mix, windows
from daygrid.operators.skew import lookup
from daygrid.session import durable

LANES, TREES, BRANCHES, DEPTH, LEAF = 64, 10, 2, 8, 500
#: The share of all members of a large node that makes a token common there (one in COMMON),
#: the members that all others are compared with, and members that are counted at a time.
COMMON, HUBS, CHUNK = 16, 4, 1 << 14
#: Lanes of a deep path, lanes that must agree for a loose link to a deep path's first
#: member, and for a loose link inside a leaf (at 0.8 the mean is 51, the deviation 3.2).
DEEP, LOOSE_DEEP, LOOSE_LEAF = 4, 32, 36
#: Shingles in a block of the exhaustive confirmation.
BLOCK_SHINGLES = 1 << 18
_SEED = np.random.Generator(np.random.PCG64(4))
_FLIP = _SEED.integers(0, 2**63, LANES, dtype=np.uint64)
_MUL = _SEED.integers(0, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes; fewer words than ``width`` make one shingle, none make none."""
    return np.unique(windows(words, min(width, len(words)))) if len(words) else words


def sketch(items: np.ndarray) -> np.ndarray:
    """The minwise token of every lane, cut to 16 bits."""
    low = np.full(LANES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(items), 4096):
        low = np.minimum(low, ((items[at : at + 4096, None] ^ _FLIP) * _MUL).min(axis=0))
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n, a, b, sketch): the size of each row's set, a 128-bit name of it, its sketch."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, sk = [], [], [], []
            for words in doc_words(batch.column(1).to_pylist(), lower=True):
                items = shingle_set(words, width)
                n.append(len(items))
                a.append(int(mix(items).sum(dtype=np.uint64)))
                b.append(int(mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                sk.append(sketch(items).tobytes() if len(items) else None)
            ids = pa.array(batch.column(0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)),
                 pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(sk, pa.binary())], names=["doc_id", "n", "a", "b", "sketch"])

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return read.mapInArrow(hashed, "doc_id long, n long, a long, b long, sketch binary")


def _lanes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, LANES)


def _roots(reps: DataFrame) -> DataFrame:
    """(rep, deep, nodes): deep paths of DEEP tokens, and the first node in every tree."""
    picks = [hash_number(t, 1) % LANES for t in range(TREES)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = _lanes(batch.column(1)).astype(np.uint64)
            deep = np.zeros((len(lanes), LANES // DEEP), dtype=np.uint64)
            for k in range(DEEP):
                deep = mix(deep + lanes[:, k :: DEEP] + np.arange(1, LANES // DEEP + 1, dtype=np.uint64) * np.uint64(65537))
            nodes = np.stack([mix(lanes[:, p] + np.uint64(hash_number(t, 2))) for t, p in enumerate(picks)], axis=1)
            out = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64)))
                   for x in (deep, nodes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["rep", "deep", "nodes"])

    return reps.select("rep", "sketch").mapInArrow(walk, "rep long, deep array<long>, nodes array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(key, rows) for every run of a sorted stream with equal values in its first ``keys`` columns."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([c.to_numpy() for c in batch.columns[:keys]], axis=1)
        edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1), len(names)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = tuple(names[lo].tolist())
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, held


def _common(rows: DataFrame) -> DataFrame:
    """(node, size, common) of the nodes in (node, n, rep, label, sketch): the tokens of each
    lane that a COMMON-th of all ``n`` members has, or the most frequent one.

    Members are counted in chunks, and the counts of a node's chunks added up lane by lane.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, _, n), held in _groups(batches, 3):
            lanes = np.concatenate([_lanes(b.column(3)) for b in held])
            cell, hits = np.unique(lanes + (np.arange(LANES, dtype=np.int32) << 16), return_counts=True)
            if len(lanes) == n:
                # the whole node: what is not common here is not common
                keep = COMMON * hits >= n
                keep[np.lexsort((-hits, cell >> 16))[np.searchsorted(cell >> 16, np.arange(LANES))]] = True
                cell, hits = cell[keep], hits[keep]
            edges = np.searchsorted(cell >> 16, np.arange(LANES + 1))
            parts = [slice(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]
            tokens, hits = cell.astype(np.uint16), hits.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([node] * LANES, pa.int64()), pa.array(range(LANES), pa.int32()), pa.array([n] * LANES, pa.int64()),
                 pa.array([tokens[p].tobytes() for p in parts], pa.binary()), pa.array([hits[p].tobytes() for p in parts], pa.binary())],
                names=["node", "lane", "size", "tokens", "hits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for (node, lane, n), held in _groups(batches, 3):
            seen = [np.frombuffer(x, np.uint16) for b in held for x in b.column(3).to_pylist()]
            for token, hits in zip(seen, (x for b in held for x in b.column(4).to_pylist()), strict=True):
                total[token] += np.frombuffer(hits, np.int32)
            token = np.unique(np.concatenate(seen))
            hits = total[token]
            total[token] = 0
            often = token[COMMON * hits >= n]
            # COMMON entries a lane; a lane with fewer common tokens repeats one of them
            table = np.resize(often if len(often) else token[hits.argmax()], COMMON)
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([lane], pa.int32()), pa.array([n], pa.int64()),
                                              pa.array([table.tobytes()], pa.binary())], names=["node", "lane", "size", "tokens"])

    part = F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("n") / CHUNK))
    dealt = rows.select("node", part.alias("part"), "n", "sketch").repartition("node", "part").sortWithinPartitions("node", "part")
    counts = dealt.mapInArrow(count, "node long, lane int, size long, tokens binary, hits binary")
    tables = counts.repartition("node", "lane").sortWithinPartitions("node", "lane").mapInArrow(merge, "node long, lane int, size long, tokens binary")
    lanes = tables.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("lane", "tokens"))).alias("lanes"))
    return lanes.select("node", "size", _joined("lanes", "tokens").alias("common"))


def _joined(rows: str, field: str):
    return F.aggregate(rows, F.lit(b""), lambda out, x: F.concat(out, x[field]))


def _hub_members(met: DataFrame) -> DataFrame:
    """(node, hubs, hub_reps, hub_labels) from (node, rep, label, sketch, common): of all members
    of a node the HUBS with the most tokens that are common there."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                node, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                common = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint16).reshape(-1, LANES, COMMON)
                usual = (common == _lanes(batch.column(3))[:, :, None]).any(axis=2).sum(axis=1)
                order = np.lexsort((rep, -usual, node))
                # the best of each node among these rows
                first = np.searchsorted(node[order], node[order])
                best = order[np.arange(len(order)) - first < HUBS]
                took = batch.take(pa.array(best))
                yield pa.RecordBatch.from_arrays([*took.columns[:4], pa.array(usual[best], pa.int64())], names=["node", "rep", "label", "sketch", "usual"])

    judged = met.select("node", "rep", "label", "sketch", "common").mapInArrow(judge, "node long, rep long, label long, sketch binary, usual long")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("usual"), "rep"))
    best = judged.withColumn("place", place).where(F.col("place") <= HUBS)
    members = best.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "rep", "label", "sketch"))).alias("m"))
    return members.select("node", _joined("m", "sketch").alias("hubs"), F.col("m.rep").alias("hub_reps"), F.col("m.label").alias("hub_labels"))


def _profiles(rows: DataFrame, total: int) -> DataFrame:
    """(node, size, common, hubs, hub_reps, hub_labels) of every large node, from all its
    members (node, n, rep, label, sketch), which are ``total`` rows and stored."""
    common = durable(_common(rows), "common")
    hubs = _hub_members(lookup(rows, common, ["node"], _hot(total)))
    return durable(common.join(hubs, "node"), "profiles")


def _hot(total: int):
    """A node with a 4096th of the rows is hot; there are at most so many."""
    return F.col("size") >= total / 4096


def _branched(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, rep, label, hub): the child nodes of every (node, n, rep, label), and links to hubs.

    A token that many members of a node share leads many of them to the same child and tells
    them apart badly. So each document goes on by its first BRANCHES lanes, in the node's own
    order, whose token is not common there: a similar pair shares such a lane, unless both
    consist of common tokens, and then they agree with a hub. Rows with ``hub`` are those links.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                node = batch.column(0).to_numpy().view(np.uint64)
                rep, label = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                lanes = _lanes(batch.column(3))
                common = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint16).reshape(-1, LANES, COMMON)
                rare = (common != lanes[:, :, None]).all(axis=2)
                order = np.argsort(mix(node[:, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(77)), axis=1)
                ranked = np.take_along_axis(rare, order, axis=1)
                chosen = ranked & (np.cumsum(ranked, axis=1) <= BRANCHES)
                row, at = np.nonzero(chosen)
                lane = order[row, at]
                child = mix(mix(node[row] + lane.astype(np.uint64) + np.uint64(1)) + lanes[row, lane].astype(np.uint64))
                hubs = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint16).reshape(-1, HUBS, LANES)
                ids = batch.column(6).flatten().to_numpy().reshape(-1, HUBS)
                tags = batch.column(7).flatten().to_numpy().reshape(-1, HUBS)
                agree = np.where(tags == label[:, None], -1, (hubs == lanes[:, None, :]).sum(axis=2))
                best = agree.argmax(axis=1)
                near = np.flatnonzero(agree[np.arange(len(rep)), best] >= LOOSE_LEAF)
                k, m = len(row), len(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(child.view(np.int64)), pa.nulls(m, pa.int64())]), pa.array(np.concatenate([rep[row], rep[near]])),
                     pa.array(np.concatenate([label[row], label[near]])), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(ids[near, best[near]])])],
                    names=["node", "rep", "label", "hub"])

    rows = durable(large.select("node", "n", "rep", "label").join(sketches, "rep"), "large")
    total = rows.count()
    met = lookup(rows, _profiles(rows, total), ["node"], _hot(total))
    return met.select("node", "rep", "label", "sketch", "common", "hubs", "hub_reps", "hub_labels").mapInArrow(
        walk, "node long, rep long, label long, hub long")


class _Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = x = self.up.get(self.up[x], self.up[x])
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _leaf_links(leaves: DataFrame) -> DataFrame:
    """Loose links (u, v) inside each small node, as a spanning forest over its labels."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            off = members.offsets.to_numpy()
            flat = members.values
            reps, labels, lanes = flat.field(0).to_numpy(), flat.field(1).to_numpy(), _lanes(flat.field(2))
            two = off[:-1][np.diff(off) == 2]
            close = (lanes[two] == lanes[two + 1]).sum(axis=1) >= LOOSE_LEAF
            u, v = list(reps[two[close]]), list(reps[two[close] + 1])
            for lo, hi in zip(off[:-1], off[1:], strict=True):
                if hi - lo <= 2:
                    continue
                own, tag, forest = lanes[lo:hi], labels[lo:hi], _Union()
                for i in range(hi - lo - 1):
                    near = np.flatnonzero(((own[i + 1 :] == own[i]).sum(axis=1) >= LOOSE_LEAF) & (tag[i + 1 :] != tag[i])) + i + 1
                    for j in near:
                        if forest.join(int(tag[i]), int(tag[j])):
                            u.append(reps[lo + i])
                            v.append(reps[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows = leaves.groupBy("node").agg(F.collect_list(F.struct("rep", "label", "sketch")).alias("members"))
    return rows.select("members").mapInArrow(compare, "u long, v long")


def _deep_links(reps: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): members of a deep path that agree loosely with its first member."""
    rows = roots.select("rep", F.explode("deep").alias("node"))
    firsts = rows.groupBy("node").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1").select("node", "first")
    pairs = rows.join(firsts, "node").where("rep <> first").select("rep", "first").distinct()
    a = reps.select("rep", "sketch")
    b = reps.select(F.col("rep").alias("first"), F.col("sketch").alias("other"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = (_lanes(batch.column(2)) == _lanes(batch.column(3))).sum(axis=1) >= LOOSE_DEEP
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(close)), batch.column(1).filter(pa.array(close))], names=["u", "v"])

    return pairs.join(a, "rep").join(b, "first").select("rep", "first", "sketch", "other").mapInArrow(agree, "u long, v long")


def loose_links(reps: DataFrame) -> DataFrame:
    """(u, v) whose components contain every pair that the trees find similar."""
    roots = durable(_roots(reps), "roots")
    links = [durable(_deep_links(reps, roots), "deep-links")]
    known = durable(components(links[0]), "known").select(F.col("id").alias("rep"), F.col("component").alias("known"))
    rows = (roots.join(known, "rep", "left").withColumn("label", F.coalesce("known", "rep"))
            .select(F.explode("nodes").alias("node"), "rep", "label"))
    sketches = reps.select("rep", "sketch")
    rows = durable(rows, "nodes")
    for level in range(1, DEPTH + 1):
        sizes = (rows.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .where("n > 1 and lo < hi").select("node", "n"))
        live = durable(rows.join(sizes, "node").select("node", "rep", "label", "n"), "live")
        small, large = live.where(f"n <= {LEAF}"), live.where(f"n > {LEAF}")
        if level == DEPTH:
            small = small.select("node", "rep", "label").unionByName(_tiles(large))
        links.append(durable(_leaf_links(small.join(sketches, "rep")), "leaf-links"))
        if level == DEPTH or large.isEmpty():
            break
        walked = durable(_branched(large, sketches), "walked")
        links.append(walked.where("hub is not null").select(F.col("rep").alias("u"), F.col("hub").alias("v")))
        rows = walked.where("hub is null").select("node", "rep", "label")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _tiles(large: DataFrame) -> DataFrame:
    """Nodes still large at the last level, as all pairs of blocks of about LEAF rows."""
    g = F.ceil(F.col("n") / LEAF)
    return (large.withColumns({"g": g, "own": F.pmod(F.xxhash64("rep"), g)})
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
            .select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "label"))


def _hubs(groups: DataFrame, reps: DataFrame) -> DataFrame:
    """(comp, hub): the member whose tokens agree most often with the commonest ones."""
    some = 16
    tokens = F.transform(F.sequence(F.lit(0), F.lit(some - 1)), lambda i: F.struct(i.alias("lane"), F.substring("sketch", i * 2 + 1, F.lit(2)).alias("token")))
    cells = groups.join(reps.select("rep", "sketch"), "rep").select("comp", "rep", F.explode(tokens).alias("t")).select("comp", "rep", "t.*")
    common = (cells.groupBy("comp", "lane", "token").agg(F.count("*").alias("n"))
              .groupBy("comp", "lane").agg(F.max_by("token", F.struct("n", "token")).alias("token")))
    agree = cells.join(common, ["comp", "lane", "token"]).groupBy("comp", "rep").agg(F.count("*").alias("n"))
    return agree.groupBy("comp").agg(F.max_by("rep", F.struct("n", -F.col("rep"))).alias("hub"))


def _confirm_hub(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, comp, hub, linked) for rows with the texts of member and hub."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub_set = None, None
        for batch in batches:
            linked = []
            for hub, text, words in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(),
                                        doc_words(batch.column(3).to_pylist(), lower=True), strict=True):
                if hub != last:
                    last, hub_set = hub, shingle_set(next(doc_words([text], lower=True)), width)
                own = shingle_set(words, width)
                common = len(np.intersect1d(own, hub_set, assume_unique=True))
                linked.append(bool(similar(common, len(own), len(hub_set), percent)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(linked, pa.bool_())], names=["rep", "comp", "hub", "linked"])

    return pairs.select("rep", "comp", "hub", "text", "hub_text").mapInArrow(check, "rep long, comp long, hub long, linked boolean")


def _confirm_blocks(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): confirmed links of the lone members in each tile, as a spanning forest."""

    def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [shingle_set(w, width) for w in doc_words([t for _, _, t in group], lower=True)]
        size = np.array([len(s) for s in sets])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        forest = _Union()
        linked = [i for i, r in enumerate(group) if r[1]]
        for i in linked[1:]:
            forest.join(linked[0], i)
        for i in (i for i, r in enumerate(group) if not r[1]):
            mark = np.zeros(len(names), dtype=np.int64)
            mark[flat[starts[i] : starts[i] + size[i]]] = 1
            for j in np.flatnonzero(similar(np.add.reduceat(mark[flat], starts), size, size[i], percent)):
                if j != i and forest.join(i, int(j)):
                    yield group[i][0], group[j][0]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for _, group in groupby(stream, key=lambda r: r[0]):
            found = list(links([r[1:] for r in group]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    dealt = rows.select("tile", "rep", "linked", "text").repartition("tile").sortWithinPartitions("tile", "rep")
    return dealt.mapInArrow(check, "u long, v long")


def confirmed_links(docs: DataFrame, reps: DataFrame, loose: DataFrame, id_col: str, text_col: str, width: int,
                    percent: int) -> DataFrame:
    """(u, v) of similar full sets; their components are those of all similar pairs."""
    found = durable(components(loose), "loose-groups")
    groups = durable(found.select(F.col("id").alias("rep"), F.col("component").alias("comp"))
                     .unionByName(found.select(F.col("component").alias("rep"), F.col("component").alias("comp")).distinct()), "groups")
    hubs = durable(_hubs(groups, reps), "hubs")
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    texts = durable(read.where("text is not null").join(groups, "rep").join(hubs, "comp").select("rep", "comp", "hub", "text"), "group-texts")
    hub_texts = texts.where("rep = hub").select("hub", F.col("text").alias("hub_text"))
    star = durable(_confirm_hub(texts.where("rep <> hub").join(hub_texts, "hub"), width, percent), "hub-links")
    sure = star.where("linked").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    sizes = reps.select("rep", "n")
    open_groups = (star.join(sizes, "rep").groupBy("comp").agg(
        F.sum(F.when(~F.col("linked"), F.col("n")).otherwise(0)).alias("lone"),
        F.sum(F.when(F.col("linked"), F.col("n")).otherwise(0)).alias("tied"), F.count("*").alias("members"))
        .where("lone > 0 and members > 1"))
    lone_blocks, tied_blocks = F.ceil(F.col("lone") / BLOCK_SHINGLES), F.ceil(F.col("tied") / BLOCK_SHINGLES)
    whole = F.col("lone") + F.col("tied") <= BLOCK_SHINGLES
    spread = open_groups.select("comp", F.when(whole, 0).otherwise(lone_blocks).alias("gu"), tied_blocks.alias("gt"))
    own = F.pmod(F.xxhash64("rep"), F.greatest(F.when(F.col("linked"), F.col("gt")).otherwise(F.col("gu")), F.lit(1)))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    none = F.array().cast("array<bigint>")
    lone_tiles = F.concat(
        F.transform(upto("gu"), lambda j: F.xxhash64("comp", F.lit("uu"), F.least("own", j), F.greatest("own", j))),
        F.when(F.col("gt") > 0, F.transform(upto("gt"), lambda j: F.xxhash64("comp", F.lit("ut"), "own", j))).otherwise(none))
    tied_tiles = F.transform(upto("gu"), lambda i: F.xxhash64("comp", F.lit("ut"), i, "own"))
    tiles = F.when(F.col("gu") == 0, F.array(F.xxhash64("comp"))).when(F.col("linked"), tied_tiles).otherwise(lone_tiles)
    rows = (star.join(spread, "comp").withColumn("own", own).select("rep", "linked", F.explode(tiles).alias("tile"))
            .join(texts.select("rep", "text"), "rep"))
    return sure.unionByName(_confirm_blocks(rows, width, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when their sets of ``width``-word shingles (A-Z lower-cased, words
    between ASCII white space) share at least ``percent`` of their union. Null, empty and
    blank texts have no shingles and are linked with nothing. Rows that share an id count
    as one document; rows without id are kept, with a null component, and link nothing.
    Ids are integers. Other columns are not read.
    """
    prints = durable(fingerprints(docs, id_col, text_col, width), "fingerprints")
    reps = durable(prints.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "representatives")
    links = durable(confirmed_links(docs, reps, loose_links(reps), id_col, text_col, width, percent), "links")
    # a document in several rows has several sets: they belong together
    twins = prints.where("n > 0").select("doc_id", "a", "b").join(reps.select("a", "b", "rep"), ["a", "b"]).where("doc_id <> rep")
    same = twins.join(prints.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1"), "doc_id")
    edges = links.unionByName(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    names = durable(components(edges), "components")
    classes = reps.join(names, reps["rep"] == names["id"], "left").select("a", "b", F.coalesce("component", "rep").alias("component_id"))
    known = prints.where("n > 0").join(classes, ["a", "b"], "left")
    rest = prints.where("n = 0").withColumn("component_id", F.col("doc_id"))
    out = known.select("doc_id", "n", "component_id").unionByName(rest.select("doc_id", "n", "component_id"))
    of = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` does not keep, all columns intact."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))  # its columns may have any names
    return rows.join(gone, F.col("doc")[id_col] == F.col("gone"), "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
