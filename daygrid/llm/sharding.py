"""Shards of nearly equal bytes by Karmarkar-Karp differencing, equal texts kept together.

A partial partition is a row of shard sums. The two with the largest spread are combined,
the largest sums of one upon the smallest of the other, until one is left; walking back
through the combinations gives each group its shard. All groups of a corpus never meet in
one task: while more than ``TOP`` items are left, those below a fixed share of all bytes
are dealt by hash to buckets of about ``FAN``, each bucket is differenced into bundles, and
the bundles are the items of the next level. Larger items pass on as they are, so that the
last level can set them off against each other, and so does a fixed number of small ones,
drawn by hash, with which it can level what bundles of nearly equal size leave uneven.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.operators.skew import lookup
from daygrid.session import durable

#: Items of the last level, items of a bucket, bundles of a level and of a bucket.
TOP, FAN, BUNDLES, WAYS = 1 << 14, 1 << 14, 1 << 12, 1 << 8
#: An item with a LARGE-th of all bytes is not bundled, nor are about FILL others of a level;
#: a group with a LARGE-th of all bytes or rows is looked up by broadcast.
LARGE, FILL = 1 << 12, 1 << 12
LAW = "bytes"


def differencing(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The bin (0 to ``ways`` - 1) of every item; equal spreads are combined in order of the items."""
    n = len(sizes)
    if n == 0 or ways == 1:
        return np.zeros(n, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def taken() -> tuple[int, np.ndarray]:
        _, k = heapq.heappop(heap)
        if k >= n:
            return k, sums.pop(k)
        row = np.zeros(ways, dtype=np.int64)
        row[-1] = sizes[k]
        return k, row

    made = []
    while len(heap) > 1:
        (a, x), (b, y) = taken(), taken()
        both = x + y[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order] - both[order[0]]
        sums[n + len(made)] = both
        heapq.heappush(heap, (-int(both[-1]), n + len(made)))
        made.append((a, b, order.astype(np.int32)))
    bins = {heap[0][1]: np.arange(ways, dtype=np.int32)}
    out = np.zeros(n, dtype=np.int64)
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        own = bins.pop(n + k)
        for child, place in ((a, order), (b, ways - 1 - order)):
            if child < n:
                out[child] = own[np.flatnonzero(place == ways - 1)[0]]
            else:
                bins[child] = np.empty_like(own)
                bins[child][place] = own
    if n == 1:
        out[0] = ways - 1
    return out


def _binned(ways: int, name: str):
    """A bucket's items (level, x, y, size, bucket) with their bins, whatever order they come in."""

    def run(items: pa.Table) -> pa.Table:
        items = items.sort_by([("size", "descending"), ("level", "ascending"), ("x", "ascending"), ("y", "ascending")])
        bins = differencing(items.column("size").to_numpy(), ways)
        return items.append_column(name, pa.array(bins, pa.int64()))

    return run


def shards_of(groups: DataFrame, shards: int) -> DataFrame:
    """(x, y, shard) for distinct (x, y) with a size; the driver sees three numbers a level."""
    schema = "level int, x long, y long, size long, bucket long"
    now = durable(groups.select(F.lit(0).alias("level"), "x", "y", "size"), "shard-items")
    n, total = now.agg(F.count("*"), F.sum("size")).first()
    dealt: list[DataFrame] = []
    while n > TOP:
        large = (F.col("size") >= total / LARGE) | (F.pmod(F.xxhash64("y", "x", "level"), F.lit(n)) < FILL)
        buckets = -(-n // FAN)
        ways = min(WAYS, max(2, -(-BUNDLES // buckets)))
        small = now.where(~large).withColumn("bucket", F.pmod(F.xxhash64("x", "y", "level"), F.lit(buckets)))
        dealt.append(durable(small.groupBy("bucket").applyInArrow(_binned(ways, "bin"), f"{schema}, bin long"), "bundled"))
        bundles = dealt[-1].groupBy("bucket", "bin").agg(F.sum("size").alias("size")).select(
            F.lit(len(dealt)).alias("level"), F.col("bucket").alias("x"), F.col("bin").alias("y"), "size")
        now = durable(now.where(large).unionByName(bundles), "shard-items")
        n = now.count()
    last = now.withColumn("bucket", F.lit(0).cast("long")).groupBy("bucket").applyInArrow(_binned(shards, "shard"), f"{schema}, shard long")
    known = durable(last.select("level", "x", "y", F.col("shard").cast("int").alias("shard")), "shards")
    for level in range(len(dealt), 0, -1):
        above = known.where(F.col("level") == level).select(F.col("x").alias("bucket"), F.col("y").alias("bin"), "shard")
        below = dealt[level - 1].select("level", "x", "y", "bucket", "bin").join(above, ["bucket", "bin"]).select("level", "x", "y", "shard")
        known = durable(known.where(F.col("level") < level).unionByName(below), "shards")
    return known.select("x", "y", "shard")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc, x, y, size): the row as a struct, a 128-bit name of its text, its bytes and 8."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(text).alias("x"),
                       F.xxhash64(F.lit(1), text).alias("y"), (F.octet_length(text) + F.lit(8).cast("long")).alias("size"),
                       F.crc32(text.cast("binary")).alias("crc"))


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with their shard, by groups of equal (x, y)."""
    groups = durable(rows.groupBy("x", "y").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "text-groups")
    total, n = groups.agg(F.sum("size"), F.sum("n")).first()
    hot = (F.col("bytes") >= (total or 0) / LARGE) | (F.col("n") >= (n or 0) / LARGE)
    sizes = groups.select("x", "y", F.col("size").alias("bytes"), "n")
    side = durable(shards_of(groups, shards).join(sizes, ["x", "y"]), "shard-of-group")
    return lookup(rows, side, ["x", "y"], hot)


def _sub(rows: DataFrame, shards: int):
    """How many parts a shard is numbered in, and the part of a row."""
    parts = -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    return F.pmod(F.xxhash64("doc_id", "x", "y"), F.lit(parts)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus 8. Rows of equal texts share a shard;
    null counts as the empty text. The law is ``bytes``: shard sizes are as equal as whole
    groups allow, and a group above a shard's share has a shard nearly of its own.
    ``slot`` counts from 0 without gaps inside a shard, the same for any layout of the
    input but for rows that are equal in id and text. ``grown_shard`` is null: differencing
    has no law for one more shard. Rows without id are placed like any other; repeated
    rows are placed once each. An empty table gives no rows.
    """
    rows = durable(_keyed(docs, text_col).select(F.col("doc")[id_col].alias("doc_id"), "x", "y", "size", "crc"), "text-sizes")
    placed = durable(_placed(rows, shards).select("doc_id", "x", "y", "size", "crc", "shard", _sub(rows, shards).alias("sub")), "placed")
    counts = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "sub").orderBy("doc_id", "x", "y")
    return (placed.withColumn("at", F.row_number().over(inside)).join(starts, ["shard", "sub"])
            .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard",
                    (F.col("start") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """``docs`` as Parquet folders ``shard=0`` onwards, every row in the shard that
    ``shard_documents`` names; a shard is written by as many tasks as it has parts. A
    column of that name is replaced."""
    rows = durable(_keyed(docs, text_col), "keyed-texts")
    placed = _placed(rows, shards).withColumn("doc_id", F.col("doc")[id_col])
    keep = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() != "shard"]
    out = placed.withColumn("_sub", _sub(rows, shards)).repartition("shard", "_sub")
    out.select(*keep, "shard").write.mode("errorifexists").partitionBy("shard").parquet(path)
