"""Static table beside window features of the series: one row per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrid.operators import series as S
from daygrid.operators.columns import prefix_columns


def series_features(
    series: DataFrame, channels: Sequence[str], stats: Sequence[str] = S.STATS, lo: int = -15, hi: int = 2,
    clustered: bool = False,
) -> DataFrame:
    """Wide window features and measurement intensity per entity.

    The series is shuffled once, by entity: the trapezoids, the per-channel
    aggregate, the intensity and the pivot all work within that partitioning. A series
    that is stored by entity (``clustered``) is not shuffled at all.
    """
    rows = S.by_entity(S.in_window(series, lo, hi), clustered)
    per_entity = Window.partitionBy(S.ENTITY)
    day = F.when(F.col(S.VALUE).isNotNull(), F.col(S.DAY))  # at most one per day of the window
    metered = rows.withColumns(
        {
            "total_nonmiss": F.count(S.VALUE).over(per_entity),
            "days_with_any": F.size(F.collect_set(day).over(per_entity)).cast("long"),
        }
    )
    keep = ["total_nonmiss", "days_with_any"]
    points = S.with_steps(metered)
    features = S.aggregate_points(points, [*S.KEYS, *keep])
    return S.pivot_features(features, channels, stats, keep=keep)


def feature_table(
    static: DataFrame, series: DataFrame, channels: Sequence[str],
    stats: Sequence[str] = S.STATS, lo: int = -15, hi: int = 2, entity: str = S.ENTITY,
    clustered: bool = False,
) -> DataFrame:
    """Nothing of the static side is lost; entities without series get nulls."""
    named = prefix_columns(static, "s_", keep=[entity])
    return named.join(series_features(series, channels, stats, lo, hi, clustered), entity, "left")
