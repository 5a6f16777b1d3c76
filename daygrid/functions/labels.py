"""Binary targets from ordinal grades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.functions.recode import over_threshold


def binarize(
    df: DataFrame,
    columns: str | Sequence[str] | Mapping[str, float],
    threshold: float = 2,
    suffix: str | None = None,
) -> DataFrame:
    """Replace (or, with a suffix, accompany) grades by "more than the threshold"."""
    if isinstance(columns, str):
        rules: dict[str, float] = {columns: threshold}
    elif isinstance(columns, Mapping):
        rules = dict(columns)
    elif isinstance(columns, (list, tuple)):
        rules = dict.fromkeys(columns, threshold)
    else:
        raise TypeError(f"columns must be a name, a list or a mapping, not {type(columns)}")
    for name in rules:
        if name not in df.columns:
            raise ValueError(f"no column {name!r}; columns are {df.columns}")
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise TypeError(f"column {name!r} is not numeric")
    return df.withColumns(
        {f"{c}{suffix or ''}": over_threshold(F.col(c), t) for c, t in rules.items()}
    )


def label_from_window(
    static: DataFrame,
    graded_days: DataFrame | None,
    lo: int = 3,
    hi: int = 5,
    severe: int = 3,
    entity: str = "entity_id",
    grade: str = "grade",
    static_fallbacks: Sequence[str] = ("max_grade", "grade"),
) -> DataFrame:
    """Label 1 when any day of [lo, hi] reaches the severe grade.

    Entities without graded days fall back to the first non-null static grade,
    and to 0 when there is none.
    """
    known = [F.col(f"_s.{c}") for c in static_fallbacks if c in static.columns]
    fallback = F.coalesce(*[(c >= severe).cast("int") for c in known], F.lit(0)) if known else F.lit(0)
    base = static.select(entity, F.struct(*[c for c in static_fallbacks if c in static.columns]).alias("_s"))
    if graded_days is None:
        return base.select(entity, fallback.alias("label"))
    hits = graded_days.groupBy(entity).agg(
        F.coalesce(
            F.max(F.when(F.col("day").between(lo, hi) & (F.col(grade) >= severe), 1)), F.lit(0)
        ).alias("_hit")
    )
    joined = base.join(hits, entity, "left")
    return joined.select(entity, F.coalesce(F.col("_hit"), fallback).alias("label"))


def toxicity_targets(df: DataFrame, grades: Sequence[str], threshold: float = 2) -> DataFrame:
    """Per grade whether it was severe; any severe, the maximum grade, the number severe."""
    flags = {f"{g}_severe": over_threshold(F.col(g), threshold) for g in grades}
    out = df.withColumns(flags)
    each = [F.coalesce(F.col(f), F.lit(0)) for f in flags]
    known = reduce(lambda a, b: a | b, [F.col(g).isNotNull() for g in grades])
    total = reduce(lambda a, b: a + b, each)
    return out.withColumns(
        {
            "any_severe": F.when(known, (total > 0).cast("int")),
            "max_grade": F.greatest(*[F.col(g) for g in grades]),
            "n_severe": F.when(known, total),
        }
    )
