"""Line deduplication across documents, in DataFrame operations only.

Line hashes are range-partitioned by (hash, salt) with a secondary order by document and
position; each group streams its rows and its first document keeps the line. The salt
spreads a line that a third of the corpus holds over as many groups as there are shuffle
partitions; the winners of the groups (one document per group) meet in a second, small
round. What comes out is a run-length keep bitmap per document, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daygrid.session import durable

#: ASCII white space, and the letters that are folded.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(SPACES))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_id, _row, _lines, _pos, _h1, _h2) of every line whose key is long enough."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.split(ascii_lower(text), "\n")
    key = F.btrim(F.col("_line"), F.lit(SPACES))
    return (
        docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_row"), lines.alias("_all"))
        .select("_id", "_row", F.size("_all").alias("_lines"), F.posexplode("_all").alias("_pos", "_line"))
        .select("_id", "_row", "_lines", "_pos", key.alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_row", "_lines", "_pos", F.xxhash64("_key").alias("_h1"),
                F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per document that loses lines: (_id, _row, n_lines, n_dropped, keep).

    ``keep`` is the keep bitmap as runs (first, length) of kept lines; a document
    without a row keeps every line. ``_row`` is the hash of the text: rows that share an
    id and differ in text have bitmaps of their own, equal rows share one. A line is
    dropped when a smaller id holds its key; all copies inside the first document stay.
    A null id is larger than every id, and all such rows count as one document. Null
    and empty texts are one empty line, which is shorter than any key.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = durable(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    order = (F.col("_id").isNull(), F.col("_id"), F.col("_pos"))
    salted = Window.partitionBy("_h1", "_h2", "_salt").orderBy(*order)
    whole = Window.partitionBy("_h1", "_h2").orderBy(*order)
    first = (
        lines.withColumn("_salt", F.pmod(F.xxhash64("_id", "_row"), F.lit(parts)))
        .repartitionByRange(parts, "_h1", "_h2", "_salt")
        .withColumn("_first", F.first("_id").over(salted))
    )
    mine = F.col("_first").eqNullSafe(F.col("_id"))
    final = first.where(mine).withColumn("_first", F.first("_id").over(whole))
    dropped = first.where(~mine).unionByName(final.where(~mine))
    found = dropped.groupBy("_id", "_row", "_lines").agg(F.collect_set("_pos").alias("_drop"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("_lines") - 1), F.col("_drop"))
    heads = F.filter("_kept", lambda x, i: (i == 0) | (F.col("_kept")[F.greatest(i - 1, F.lit(0))] != x - 1))
    tails = F.filter("_kept", lambda x, i: (i == F.size("_kept") - 1)
                     | (F.col("_kept")[F.least(i + 1, F.size("_kept") - 1)] != x + 1))
    return (
        found.withColumn("_kept", kept)
        .withColumns({"_heads": heads, "_tails": tails})
        .select("_id", "_row", F.col("_lines").cast("long").alias("n_lines"),
                F.size("_drop").cast("long").alias("n_dropped"),
                F.zip_with("_heads", "_tails", lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("length")))
                .alias("keep"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_lines, n_dropped, kept_text) per row of ``docs``; ``doc`` is the row itself,
    as a struct, so that its columns may have any names."""
    side = bitmaps.select(F.col("_id").alias("_bid"), F.col("_row").alias("_brow"), "n_dropped", "keep")
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    rest = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(F.col("lines"), r["first"] + 1, r["length"]))), "\n")
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
        .withColumns({"_id": F.col("doc")[id_col], "_row": F.xxhash64(text)})
        .join(side, F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_row") == F.col("_brow")), "left")
        .withColumn("lines", F.split(text, "\n"))
        .select("doc", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
                F.when(F.col("keep").isNull(), text).otherwise(rest).alias("kept_text"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                count_col: str | None = None) -> DataFrame:
    """``docs`` with the text of every row reduced to its kept lines; a null text stays
    null. Rows all of whose lines stand in documents before them have nothing left and go.
    ``count_col``, if given, takes the new length in characters."""
    done = apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
    kept = F.when(F.col("doc")[text_col].isNotNull(), F.col("kept_text"))
    fresh = {text_col: kept} | ({count_col: F.length(kept).cast("long")} if count_col in docs.columns else {})
    return done.where("n_dropped < n_lines").select(*[fresh.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
