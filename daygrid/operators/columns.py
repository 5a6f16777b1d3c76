"""Column-level operators: renaming, dropping, aligning, selecting and coercing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.functions.recode import number
from daygrid.operators import wide
from daygrid.operators.wide import q

# Columns that are labels or identify a row.
LABEL_COLUMNS = ("ID", "Infection", "CRS", "ICANS", "E_ICAHT", "L_ICAHT")
LEAKAGE_WORDS = ("infection", "crs", "icans", "icaht", "grade", "label", "target", "outcome", "result")


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Explicit new names; elsewhere blanks become underscores."""
    return df.toDF(*[mapping.get(c, c.replace(" ", "_")) for c in df.columns])


def indexed_names(wanted: Mapping[str, Iterable[int]]) -> list[str]:
    return [f"{prefix}{i:03d}" for prefix, indices in wanted.items() for i in indices]


def drop_by_prefix_index(
    df: DataFrame, wanted: Mapping[str, Iterable[int]], also: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Drop ``<prefix><3-digit index>`` columns; absent ones come back as warnings."""
    names = [*indexed_names(wanted), *also]
    return df.drop(*[n for n in names if n in df.columns]), [n for n in names if n not in df.columns]


def drop_channels(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same for the long form: a filter that a Parquet scan can use."""
    return series.where(~F.col("channel").isin(list(names)))


def absent_channels(series: DataFrame, names: Sequence[str]) -> list[str]:
    """Which of ``names`` the long form lacks: the warnings of a drop."""
    have = {r["channel"] for r in series.where(F.col("channel").isin(list(names))).select("channel").distinct().collect()}
    return [n for n in names if n not in have]


def renumbered(columns: Sequence[str], prefix: str) -> dict[str, str]:
    """Old to new names so that the numbers of one prefix run 001, 002, …

    Names whose remainder is no number are left out, hence kept.
    """
    pattern = re.compile(re.escape(prefix) + r"\s*([+-]?\d+)\s*")
    numbered = [(int(m[1]), c) for c in columns if (m := pattern.fullmatch(c))]
    ordered = [c for _, c in sorted(numbered, key=lambda pair: pair[0])]
    return {c: f"{prefix}{i:03d}" for i, c in enumerate(ordered, 1)}


def renumber_prefix(df: DataFrame, prefix: str) -> DataFrame:
    new = renumbered(df.columns, prefix)
    return df.toDF(*[new.get(c, c) for c in df.columns])


def renumber_channels(channels: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Channel dimension (one row per channel) with its gap-free name ``new_channel``."""
    prefix = F.coalesce(
        *[F.when(F.col("channel").startswith(p), F.lit(p))
          for p in sorted(prefixes, key=len, reverse=True)]
    )
    rest = F.expr("substring(channel, length(_prefix) + 1)").try_cast("int")
    parts = channels.select("channel").distinct().withColumn("_prefix", prefix).withColumn("_n", rest)
    order = Window.partitionBy("_prefix").orderBy("_n", "channel")
    numbered = parts.where(F.col("_n").isNotNull()).withColumn(
        "new_channel",
        F.concat("_prefix", F.lpad(F.row_number().over(order).cast("string"), 3, "0")),
    )
    kept = parts.where(F.col("_n").isNull()).withColumn("new_channel", F.col("channel"))
    return numbered.unionByName(kept).select("channel", "new_channel")


def rename_channels(series: DataFrame, renames: DataFrame) -> DataFrame:
    joined = series.join(renames, "channel")
    return joined.withColumn("channel", F.col("new_channel")).drop("new_channel")


def constant_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, is_constant): at most one distinct non-null value, one pass, no distinct."""
    names = [
        c for c in columns or df.columns
        if not isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType))
    ]
    return wide.distinct_at_most_one(df, names)


class ConstantColumnDropper:
    """Learns constant columns on one frame and drops them from any frame."""

    def __init__(self, columns: Sequence[str] | None = None):
        self.columns = columns
        self.constant_columns: list[str] = []

    def fit(self, df: DataFrame) -> ConstantColumnDropper:
        rows = constant_flags(df, self.columns).where("is_constant").collect()
        found = {r["column"] for r in rows}
        self.constant_columns = [c for c in df.columns if c in found]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.constant_columns)


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_count, missing_pct, n_rows): flags are added up in vectors, so that no
    row of the data is multiplied and the plan does not grow with the columns."""
    names = list(columns) if columns is not None else df.columns
    missing = F.col("n_rows") - F.col("filled")
    return wide.filled_counts(df, names).select(
        "column", missing.alias("missing_count"), F.try_divide(missing * F.lit(100.0), F.col("n_rows")).alias("missing_pct"), "n_rows")


@dataclass
class MissingFilter:
    df: DataFrame
    report: DataFrame
    above: list[str]
    dropped: list[str] = field(default_factory=list)


def filter_by_missing(
    df: DataFrame,
    threshold_pct: float = 20.0,
    drop: bool = True,
    scope: str = "baseline",
    exclude: Sequence[str] = (),
) -> MissingFilter:
    """Drop (or only report) columns whose null share exceeds the threshold strictly.

    Scope "baseline" looks at ``baseline_*``; "static" at all others except labels.
    """
    if scope == "baseline":
        names = [c for c in df.columns if c.startswith("baseline_")]
    else:
        skip = {*LABEL_COLUMNS, *exclude}
        names = [c for c in df.columns if not c.startswith("baseline_") and c not in skip]
    report = missing_by_column(df, names)
    over = {r["column"] for r in report.where(F.col("missing_pct") > threshold_pct).collect()}
    above = [c for c in names if c in over]
    dropped = above if drop else []
    return MissingFilter(df.drop(*dropped), report, above, dropped)


@dataclass
class Alignment:
    train: DataFrame
    test: DataFrame
    dropped: list[str]
    only_train: list[str]
    only_test: list[str]
    not_found: list[str]


def align_columns(
    train: DataFrame, test: DataFrame, drop: Sequence[str] | None = None,
    keep: Sequence[str] | None = None,
) -> Alignment:
    """Drop columns from both frames only where both have them."""
    if drop is None and keep is None:
        raise ValueError("give columns to drop or columns to keep")
    targets = [c for c in train.columns if c not in set(keep)] if keep is not None else list(drop)
    both = [c for c in targets if c in train.columns and c in test.columns]
    return Alignment(
        train.drop(*both),
        test.drop(*both),
        both,
        [c for c in targets if c in train.columns and c not in test.columns],
        [c for c in targets if c in test.columns and c not in train.columns],
        [c for c in targets if c not in train.columns and c not in test.columns],
    )


def select_features(
    train: DataFrame, test: DataFrame, wanted: Sequence[str], minimum: int = 10,
    exclude: Sequence[str] = LABEL_COLUMNS,
) -> list[str]:
    """Wanted columns present on both sides, topped up in column order to ``minimum``."""
    shared = [c for c in wanted if c in train.columns and c in test.columns]
    if len(shared) < len(wanted) and len(shared) < minimum:
        spare = [
            c for c in train.columns
            if c not in shared and c not in exclude and c in test.columns
        ]
        shared += spare[: minimum - len(shared)]
    return shared


def drop_leakage(
    df: DataFrame, extra: Sequence[str] = (), words: Sequence[str] = LEAKAGE_WORDS
) -> tuple[DataFrame, list[str]]:
    """Drop labels and ids; name the remaining columns that look like outcomes."""
    gone = {*LABEL_COLUMNS, *extra}
    kept = df.drop(*[c for c in df.columns if c in gone])
    return kept, [c for c in kept.columns if any(w in c.lower() for w in words)]


def require_not_null(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every column present, and the others with the first missing column.

    A row is reported under the first column (in the given order) that it lacks.
    """
    reason = F.coalesce(*[F.when(F.col(q(c)).isNull(), F.lit(c)) for c in columns])
    return df.dropna(subset=list(columns)), df.withColumn("missing_column", reason).where(
        F.col("missing_column").isNotNull()
    )


def drop_unmeasured(features: DataFrame, count: str = "total_nonmiss") -> DataFrame:
    return features.where(F.col(count) > 0)


def split_by_dtype(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and other columns, by schema alone."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return numeric, [c for c in df.columns if c not in numeric]


def dtype_counts(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in df.schema:
        out[f.dataType.simpleString()] = out.get(f.dataType.simpleString(), 0) + 1
    return out


def coerce_numeric(df: DataFrame, columns: Sequence[str], day: str | None = None) -> DataFrame:
    """Unparseable text becomes null; rows with an unparseable day are dropped."""
    out = df.withColumns({c: number(F.col(q(c))) for c in columns})
    if day is not None:
        out = out.withColumn(day, number(F.col(q(day)))).where(F.col(q(day)).isNotNull())
    return out


def cast_nullable_int(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(F.col(q(c))).try_cast("int") for c in columns})


def resolve_column(df: DataFrame, name: str, first: bool = False, contains: str | None = None) -> str:
    """Find a column by exact name, by name without case, as the first one, or as
    the first whose name contains a word."""
    if name in df.columns:
        return name
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    if contains:
        for c in df.columns:
            if contains.lower() in c.lower():
                return c
    if first:
        return df.columns[0]
    raise ValueError(f"no column like {name!r} in {df.columns}")


def prefix_columns(df: DataFrame, prefix: str = "s_", keep: Sequence[str] = ()) -> DataFrame:
    return df.toDF(*[c if c in keep else f"{prefix}{c}" for c in df.columns])


class Binarizer(Transformer):
    """Threshold step for use inside an ML pipeline."""

    def __init__(self, columns, threshold: float = 2, suffix: str | None = None):
        super().__init__()
        self.columns, self.threshold, self.suffix = columns, threshold, suffix

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from daygrid.functions.labels import binarize

        return binarize(dataset, self.columns, self.threshold, self.suffix)
