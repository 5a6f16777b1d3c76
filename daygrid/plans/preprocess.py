"""Validation and recoding of a raw static table and raw series files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.functions.recode import number
from daygrid.operators import columns as C
from daygrid.operators import quality as Q
from daygrid.session import durable
from daygrid.sources import readers

Recoding = Mapping[str, Callable[[Column], Column]]


def recode_static(raw: DataFrame, recoding: Recoding) -> DataFrame:
    """Recoded text columns; columns a table lacks are passed over. "NA" becomes null."""
    missing = [c for c in raw.columns if raw.schema[c].dataType.simpleString() == "string"]
    clean = raw.withColumns(
        {c: F.when(~F.trim(F.col(C.q(c))).isin(*readers.MISSING_TEXTS), F.col(C.q(c))) for c in missing}
    )
    return clean.withColumns({c: rule(F.col(C.q(c))) for c, rule in recoding.items() if c in raw.columns})


def standardize_static(
    raw: DataFrame, recoding: Recoding, names: Mapping[str, str], integers: Sequence[str] = (), numbers: Sequence[str] = (),
) -> DataFrame:
    """Recoded, renamed and typed static table: one projection over the raw one.

    ``recoding`` maps raw columns to the functions that recode them, ``names`` raw to new
    names; ``integers`` and ``numbers`` are new names.
    """
    named = C.rename_columns(recode_static(raw, recoding), names)
    typed = C.cast_nullable_int(named, [c for c in integers if c in named.columns])
    return typed.withColumns({c: number(F.col(C.q(c))) for c in numbers if c in named.columns})


@dataclass
class SeriesReport:
    """Findings per file and the verdict on each file."""

    column_findings: DataFrame
    count_findings: DataFrame
    bad_cells: DataFrame
    day_findings: DataFrame
    verdicts: DataFrame


def validate_series(
    lines: DataFrame, expected: Sequence[str], lo: int = -15, hi: int = 30,
    rows_with_header: int | None = None,
) -> SeriesReport:
    """All checks of the series files over one set of lines.

    Pass stored lines (``daygrid.session.durable``): several checks read them.
    """
    cells = readers.series_cells(lines)
    heads = readers.series_headers(lines)
    columns = Q.check_columns(heads, expected)
    files = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("header") - 1).alias("n_columns")
    )
    counts = Q.check_counts(files, len(expected), lo, hi, rows_with_header or hi - lo + 2)
    bad = Q.check_cells(cells)
    placed = Q.with_position(lines.select("file", "line", number(F.col("cells")[0]).try_cast("int").alias("day")), "file", "line")
    days = Q.check_day_grid(placed, lo, hi, entity="file", position="position")
    found = Q.union_findings(
        columns.select("file", "severity"), counts.select("file", "severity"),
        bad.select("file", F.lit("error").alias("severity")),
        days.select("file", F.lit("warning").alias("severity")),
    )
    return SeriesReport(columns, counts, bad, days, Q.file_verdicts(files, found))


def validate_and_process(
    spark: SparkSession, path: str, expected: Sequence[str], lo: int = -15, hi: int = 30, entity: str = "stem", **options,
) -> tuple[SeriesReport, DataFrame]:
    """Validate the series files of a folder and process those that are valid.

    Fails if no file is valid; the report says why.
    """
    lines = durable(readers.read_series_lines(spark, path, entity), "lines")
    report = validate_series(lines, expected, lo, hi)
    if not Q.any_valid(report.verdicts):
        raise ValueError(f"no valid series file in {path}")
    return report, process_series(spark, path, entity=entity, valid=report.verdicts.where("valid"), lines=lines, **options)


def process_series(
    spark: SparkSession, path: str, drop: Mapping[str, Iterable[int]] | None = None,
    renumber: Sequence[str] = (), entity: str = "stem", valid: DataFrame | None = None, lines: DataFrame | None = None,
) -> DataFrame:
    """Series files as a long table without the dropped channels, numbering closed up.
    ``valid``, if given, names the files (``file``) to take; ``lines`` are those of the
    folder, where they are read already."""
    series = readers.read_series_dir(spark, path, entity, valid) if lines is None else readers.series_values(lines, valid)
    kept = C.drop_channels(series, C.indexed_names(drop)) if drop else series
    return C.rename_channels(kept, C.renumber_channels(kept, renumber)) if renumber else kept
