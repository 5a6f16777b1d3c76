"""Readers for static tables, directories of series files and conversation exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.functions.recode import number
from daygrid.session import durable

# Texts that stand for a missing cell.
MISSING_TEXTS = ("NA", "", "nan", "NaN", "null", "N/A")


def read_static(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; "NA" and blanks become null.

    Columns are bound by header name, not by position: a text read comes first and
    the declared types are cast from it. Text that does not fit its type is null.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = read_static_raw(spark, path, blanks=False)
    have = {c.lower(): c for c in raw.columns}

    def cast(f: T.StructField) -> Column:
        if f.name.lower() not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = F.col("`" + have[f.name.lower()] + "`")
        value = F.when(~F.trim(text).isin(*MISSING_TEXTS), text)
        if isinstance(f.dataType, T.StringType):
            return value.alias(f.name)
        if isinstance(f.dataType, T.NumericType):
            return number(value).try_cast(f.dataType).alias(f.name)
        return F.trim(value).try_cast(f.dataType).alias(f.name)

    return raw.select(*[cast(f) for f in wanted])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder: the first line alone is read."""
    return spark.read.option("header", True).csv(path).columns


def read_static_raw(spark: SparkSession, path: str, blanks: bool = True) -> DataFrame:
    """Every column as text, nothing inferred; empty cells stay empty strings."""
    names = header_of(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.fillna("") if blanks else df


def _cells(line: Column) -> Column:
    """Split a CSV line at commas outside quotes and unquote the cells."""
    # outside quotes a comma becomes a separator: parts between quotes alternate
    by_quote = F.split(line, '"')
    marked = F.transform(by_quote, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit("\x1f"))).otherwise(p))
    cells = F.split(F.array_join(marked, '"'), "\x1f")
    return F.transform(cells, lambda c: F.regexp_replace(F.trim(c), r'^"|"$', ""))


def read_series_lines(spark: SparkSession, path: str, entity: str = "stem") -> DataFrame:
    """(entity_id, file, line, header, cells): lines of many CSV files, each with its
    own header.

    A schema given to the CSV reader is bound by position, which would shift values
    in files that lack a column; so lines are read as text and meet the header of
    their file. Within a file, (split start, row number in the split) is the line
    order, and the smallest of them is the header. Files are read in splits, so one
    very large file does not end up in one task. Entities come from the file stem
    or from an ``entity_id=`` folder; other names are skipped. The lines are stored on
    the way, so that no file is opened twice.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).where(F.trim("value") != "").select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
        ).alias("line"),
    )
    pattern = r"/([^/]+)\.csv$" if entity == "stem" else r"/entity_id=([^/]+)/"
    name = F.regexp_extract("file", pattern, 1)
    named = durable(lines.withColumn("entity_id", name.try_cast("long")).where(F.col("entity_id").isNotNull()), "text-lines")
    # only the first split of a file can hold its header: one row per file remains
    # and its header is split once
    headers = named.where("line.start = 0").groupBy("file").agg(
        F.min_by("value", "line").alias("_header"), F.min("line").alias("_first")
    ).select("file", "_first", _cells(F.col("_header")).alias("header"))
    body = named.join(headers, "file").where(F.col("line") > F.col("_first"))
    return body.select("entity_id", "file", "line", "header", _cells(F.col("value")).alias("cells"))


def series_cells(lines: DataFrame) -> DataFrame:
    """(entity_id, file, line, raw_day, channel, raw): one row per cell, still text."""
    named = F.arrays_zip(
        F.slice("header", 2, F.greatest(F.size("header") - 1, F.lit(0))).alias("channel"),
        F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("raw"),
    )
    cells = lines.select("entity_id", "file", "line", F.col("cells")[0].alias("raw_day"), F.explode(named).alias("c"))
    return cells.select("entity_id", "file", "line", "raw_day", "c.channel", "c.raw").where(
        F.col("channel").isNotNull()
    )


def read_series_dir(spark: SparkSession, path: str, entity: str = "stem", only: DataFrame | None = None) -> DataFrame:
    """Directory of per-entity CSV files as (entity_id, day, channel, value).

    Unparseable cells become null; lines with an unparseable day are dropped. ``only``
    names the files (``file``) to take; by default all are.
    """
    return series_values(read_series_lines(spark, path, entity), only)


def series_values(lines: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(entity_id, day, channel, value) of lines already read, as ``read_series_dir`` gives them."""
    cells = series_cells(lines if only is None else lines.join(only.select("file"), "file", "left_semi"))
    day = number(F.col("raw_day")).try_cast("int")
    return cells.select("entity_id", day.alias("day"), "channel", number(F.col("raw")).alias("value")).where(
        F.col("day").isNotNull()
    )


def series_headers(lines: DataFrame) -> DataFrame:
    """(file, pos, column) of the measure columns, for the column checks."""
    one = lines.groupBy("file").agg(F.any_value("header").alias("header"))
    measures = F.expr("slice(header, 2, greatest(size(header) - 1, 0))")
    return one.select("file", F.posexplode(measures).alias("pos", "column"))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; columns a frame lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def headers_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, header) of every CSV file under ``paths``: one distributed read for all of them."""
    first = spark.read.text(list(paths)).where(F.trim("value") != "").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row")).where("start = 0")
    return first.groupBy("file").agg(F.min_by("value", "row").alias("_h")).select("file", _cells(F.col("_h")).alias("header"))


def read_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files with different columns as one table: all headers are found in one job, and
    files that share a header are one read, so the plan grows with the number of layouts,
    not of files."""
    found = headers_of(spark, paths).groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect()
    frames = []
    for r in found:  # the files are those that the caller named
        schema = T.StructType([T.StructField(n, T.StringType()) for n in r["header"]])
        frames.append(spark.read.schema(schema).option("header", True).csv([unquote(f) for f in r["files"]]))
    return union_by_name(frames)


def read_export_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): whole text of every exported conversation file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
