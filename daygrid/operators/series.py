"""Day-indexed series: windows, carry-forward, as-of rows and window features.

The canonical form is long: ``(entity_id, day, channel, value)`` with one row per
(entity, day, channel); ``daily`` makes it so. Every operator restricts to a day
window first, so a group never holds more rows than the window has days, however
unevenly the raw rows are spread over entities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY, DAY, CHANNEL, VALUE = "entity_id", "day", "channel", "value"
KEYS = [ENTITY, CHANNEL]


def daily(raw: DataFrame, value: str | Column = VALUE) -> DataFrame:
    """Mean value per (entity, day, channel); partial sums absorb hot entities."""
    expr = F.col(value) if isinstance(value, str) else value
    return raw.groupBy(ENTITY, DAY, CHANNEL).agg(F.avg(expr).alias(VALUE))


def in_window(df: DataFrame, lo: int, hi: int, day: str = DAY) -> DataFrame:
    """Inclusive day range; reaches a Parquet scan as a pushed filter."""
    return df.where(F.col(day).between(lo, hi))


def by_entity(rows: DataFrame, clustered: bool = False) -> DataFrame:
    """``rows`` dealt by entity; ``clustered`` says that they lie so already."""
    return rows if clustered else rows.repartition(ENTITY)


def observed(series: DataFrame, lo: int, hi: int) -> DataFrame:
    return in_window(series, lo, hi).where(F.col(VALUE).isNotNull())


def densify(series: DataFrame, lo: int, hi: int, channels: Sequence[str] | None = None) -> DataFrame:
    """One row per (entity, channel, day of the window); absent days get null.

    The pairs are those with rows in the window, or every listed channel of the
    entities that have any.
    """
    inside = in_window(series, lo, hi)
    if channels is None:
        pairs = inside.select(*KEYS).distinct()
    else:
        pairs = inside.select(ENTITY).distinct().withColumn(
            CHANNEL, F.explode(F.array(*[F.lit(c) for c in channels]))
        )
    grid = pairs.withColumn(DAY, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return grid.join(inside, [ENTITY, CHANNEL, DAY], "left")


def forward_fill(series: DataFrame, lo: int, hi: int) -> DataFrame:
    """Last non-null value up to each day of the window, as column ``filled``."""
    window = (
        Window.partitionBy(*KEYS).orderBy(DAY)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return in_window(series, lo, hi).withColumn("filled", F.last(VALUE, ignorenulls=True).over(window))


def baseline_long(series: DataFrame, start: int = -15, cutoff: int = 0) -> DataFrame:
    """Last observed value per (entity, channel) in [start, cutoff].

    Sorting, filling forward and taking the last row is the same as taking the
    value of the latest non-null day, which aggregates without a sort.
    """
    return in_window(series, start, cutoff).groupBy(*KEYS).agg(
        F.max_by(VALUE, F.when(F.col(VALUE).isNotNull(), F.col(DAY))).alias(VALUE),
        F.max(DAY).alias("last_day"),
    )


def baseline(
    series: DataFrame, channels: Sequence[str], start: int = -15, cutoff: int = 0
) -> DataFrame:
    """Wide form: ``baseline_<channel>`` and ``baseline_gap_days`` per entity.

    The gap counts from the entity's last row of the window, filled or not.
    """
    last = baseline_long(series, start, cutoff)
    gap = Window.partitionBy(ENTITY)
    wide = (
        last.withColumn("baseline_gap_days", F.lit(cutoff) - F.max("last_day").over(gap))
        .groupBy(ENTITY, "baseline_gap_days").pivot(CHANNEL, list(channels)).agg(F.first(VALUE))
    )
    return wide.withColumnsRenamed({c: f"baseline_{c}" for c in channels})


def to_wide(series: DataFrame, channels: Sequence[str]) -> DataFrame:
    return series.groupBy(ENTITY, DAY).pivot(CHANNEL, list(channels)).agg(F.first(VALUE))


def last_row_before(wide: DataFrame, cutoff: int = 0) -> DataFrame:
    """Whole last row with day < cutoff, unfilled, as ``baseline_*`` plus the gap."""
    measures = [c for c in wide.columns if c not in (ENTITY, DAY)]
    row = wide.where(F.col(DAY) < cutoff).groupBy(ENTITY).agg(
        F.max(DAY).alias("_day"), F.max_by(F.struct(*measures), DAY).alias("_row")
    )
    return row.select(
        ENTITY,
        *[F.col(f"_row.`{c}`").alias(f"baseline_{c}") for c in measures],
        (F.lit(cutoff) - F.col("_day")).alias("baseline_gap_days"),
    )


def with_steps(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trapezoid from the previous observed point to each observed one; rows without
    a value stay and have no trapezoid."""
    before = (
        Window.partitionBy(*keys).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    )
    day = F.when(F.col(VALUE).isNotNull(), F.col(DAY))
    width = F.col(DAY) - F.last(day, ignorenulls=True).over(before)
    area = (F.col(VALUE) + F.last(VALUE, ignorenulls=True).over(before)) / 2 * width
    return rows.withColumn("_step", area)


def window_features(
    series: DataFrame,
    lo: int,
    hi: int,
    ddof: int = 0,
    min_points: int = 2,
    slope_default: float | None = None,
    peak_min_points: int = 1,
    clustered: bool = False,
) -> DataFrame:
    """Per (entity, channel): count, mean, median, std, min, max, slope, auc,
    time_to_peak, last_value over the observed points of [lo, hi].

    A channel that has rows but no value counts 0 and is null otherwise. ``ddof``
    picks population (0) or sample (1) deviation; with 1, a single point gives null
    unless ``slope_default`` is set, which then fills both std and slope (the
    two-window flavour writes 0 there). One shuffle by entity serves the window,
    the aggregate and a later pivot; a series that is stored by entity needs none.
    """
    points = with_steps(by_entity(in_window(series, lo, hi), clustered))
    return aggregate_points(points, KEYS, ddof, min_points, slope_default, peak_min_points)


def _median() -> Column:
    """Median of the few values one window of a channel holds (as many as days).

    Much lighter than a percentile aggregate, which keeps a hash map per group.
    """
    values = F.sort_array(F.collect_list(VALUE))
    low, high = F.floor((F.size(values) - 1) / 2), F.floor(F.size(values) / 2)
    return (F.get(values, low.cast("int")) + F.get(values, high.cast("int"))) / 2


def aggregate_points(
    points: DataFrame, keys: Sequence[str] = KEYS, ddof: int = 0, min_points: int = 2,
    slope_default: float | None = None, peak_min_points: int = 1,
) -> DataFrame:
    """One row per key with every statistic of ``STATS`` over its points."""
    n = F.count(VALUE)
    seen_day = F.when(F.col(VALUE).isNotNull(), F.col(DAY))
    std = F.stddev_pop(VALUE) if ddof == 0 else F.stddev_samp(VALUE)
    slope = F.regr_slope(F.col(VALUE), F.col(DAY).cast("double"))
    if slope_default is not None:
        fill = F.when(n > 0, F.lit(slope_default))
        std, slope = F.coalesce(std, fill), F.coalesce(slope, fill)
    elif min_points > 2:
        slope = F.when(n >= min_points, slope)
    peak = F.max_by(DAY, F.when(F.col(VALUE).isNotNull(), F.struct(F.col(VALUE), -F.col(DAY))))
    return points.groupBy(*keys).agg(
        n.alias("count"),
        F.avg(VALUE).alias("mean"),
        _median().alias("median"),
        std.alias("std"),
        F.min(VALUE).alias("min"),
        F.max(VALUE).alias("max"),
        slope.alias("slope"),
        F.sum("_step").alias("auc"),
        F.when(n >= peak_min_points, peak).alias("time_to_peak"),
        F.max_by(VALUE, seen_day).alias("last_value"),
    )


STATS = ["count", "mean", "median", "std", "min", "max", "slope", "auc", "time_to_peak", "last_value"]


def strict_slope(series: DataFrame, lo: int, hi: int) -> DataFrame:
    """Slope that is null as soon as one value of the window is missing."""
    slope = F.regr_slope(F.col(VALUE), F.col(DAY).cast("double"))
    return in_window(series, lo, hi).groupBy(*KEYS).agg(
        F.when(F.count(VALUE) == F.count(F.lit(1)), slope).alias("slope")
    )


def carried_auc(series: DataFrame, lo: int, hi: int) -> DataFrame:
    """Trapezoid area over every day of [lo, hi] after carrying values forward and
    writing 0 before the first one.

    On a unit grid the carried curve is a step function, so the area is the sum of
    value × days until the next observation, less half of both ends: no day rows
    are generated.
    """
    order = Window.partitionBy(*KEYS).orderBy(DAY)
    inside = in_window(series, lo, hi)
    spans = inside.where(F.col(VALUE).isNotNull()).withColumn(
        "_until", F.coalesce(F.lead(DAY).over(order), F.lit(hi + 1))
    )
    area = F.sum(F.col(VALUE) * (F.col("_until") - F.col(DAY)))
    first = F.coalesce(F.max(F.when(F.col(DAY) == lo, F.col(VALUE))), F.lit(0.0))
    last = F.max_by(VALUE, DAY)
    found = spans.groupBy(*KEYS).agg((area - (first + last) / 2).alias("auc"))
    pairs = inside.select(*KEYS).distinct()
    return pairs.join(found, KEYS, "left").withColumn("auc", F.coalesce("auc", F.lit(0.0)))


def intensity(series: DataFrame, lo: int, hi: int) -> DataFrame:
    """Per entity: non-missing cells and days with any measurement in the window.

    A set of days holds no more than the window does, in partial aggregates too.
    """
    day = F.when(F.col(VALUE).isNotNull(), F.col(DAY))
    return in_window(series, lo, hi).groupBy(ENTITY).agg(
        F.count(VALUE).alias("total_nonmiss"), F.size(F.collect_set(day)).cast("long").alias("days_with_any")
    )


def multi_window_features(
    series: DataFrame, windows: dict[str, tuple[int, int]], clustered: bool = False, **options
) -> DataFrame:
    """Window features for several named, disjoint windows in one pass."""
    name = None
    for label, (lo, hi) in windows.items():
        hit = F.col(DAY).between(lo, hi)
        name = F.when(hit, F.lit(label)) if name is None else name.when(hit, F.lit(label))
    lo = min(a for a, _ in windows.values())
    hi = max(b for _, b in windows.values())
    tagged = observed(series, lo, hi).withColumn("window", name).where(F.col("window").isNotNull())
    points = with_steps(by_entity(tagged, clustered), [*KEYS, "window"])
    settings = {"ddof": 1, "min_points": 2, "slope_default": 0.0, "peak_min_points": 1, **options}
    return aggregate_points(points, [*KEYS, "window"], **settings)


def pivot_features(
    features: DataFrame, channels: Sequence[str], stats: Sequence[str], window: str | None = None,
    windows: Sequence[str] = (), keep: Sequence[str] = (),
) -> DataFrame:
    """One row per entity, columns ``<channel>[_<window>]_<stat>``, in one pivot.

    ``keep`` names columns that are constant per entity.
    """
    key = F.col(CHANNEL) if window is None else F.concat_ws("_", CHANNEL, window)
    values = list(channels) if window is None else [f"{c}_{w}" for c in channels for w in windows]
    aggs = [F.first(s).alias(s) for s in stats]
    wide = features.withColumn("_key", key).groupBy(ENTITY, *keep).pivot("_key", values).agg(*aggs)
    if len(stats) == 1:
        wide = wide.withColumnsRenamed({v: f"{v}_{stats[0]}" for v in values})
    return wide
