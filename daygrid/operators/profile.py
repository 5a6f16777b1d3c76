"""Profiles: value counts, descriptions, missingness, availability, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.operators.columns import missing_by_column, q
from daygrid.operators.running import exact_quantiles
from daygrid.session import bounded, durable


def melted(df: DataFrame, columns: Sequence[str], as_type: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, variable, value) with all values cast to one type."""
    typed = df.select(*[F.col(q(k)) for k in keep], *[F.col(q(c)).cast(as_type).alias(c) for c in columns])
    return typed.unpivot([F.col(q(k)) for k in keep], [F.col(q(c)) for c in columns], "variable", "value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value, n, pct): null is no value, but counts in the denominator."""
    long = melted(df, columns, "string").where(F.col("value").isNotNull())
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.try_divide(F.col("n") * F.lit(100.0), n_rows))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n, mean, median, std, min, max) over non-null values, median exact."""
    long = melted(df, columns, "double").where(F.col("value").isNotNull())
    moments = long.groupBy("variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    median = exact_quantiles(long, ["variable"], "value", {"median": 0.5})
    return moments.join(median, "variable").select("variable", "n", "mean", "median", "std", "min", "max")


def ordered_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts in value order (the result, not the data, is sorted)."""
    rows = df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def event_rates(df: DataFrame, grades: Sequence[str], severe: int = 3) -> DataFrame:
    """Per grade column: valid, missing, any event (> 0), severe event counts and rates."""
    long = melted(df, grades, "double")
    out = long.groupBy("variable").agg(
        F.count("value").alias("n_valid"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.count_if(F.col("value") > 0).alias("n_any"),
        F.count_if(F.col("value") >= severe).alias("n_severe"),
    )
    return out.withColumns(
        {
            "any_rate": F.try_divide(F.col("n_any") * F.lit(100.0), F.col("n_valid")),
            "severe_rate": F.try_divide(F.col("n_severe") * F.lit(100.0), F.col("n_valid")),
        }
    )


def level_ratio(df: DataFrame, column: str, first: str, second: str) -> DataFrame:
    """Counts of two levels and their ratio, null when the second is absent."""
    counts = df.agg(
        F.count_if(F.col(column) == first).alias("n_first"),
        F.count_if(F.col(column) == second).alias("n_second"),
    )
    return counts.withColumn("ratio", F.try_divide(F.col("n_first").cast("double"), F.col("n_second")))


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: missing count and %, and "k/n", most missing first."""
    found = missing_by_column(df, columns)
    text = F.format_string("%d/%d", F.col("missing_count"), F.col("n_rows"))
    return found.withColumn("ratio", text).orderBy(F.desc("missing_pct"), "column")


def channel_missing(series: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Missing share of every channel over all entity-days on record.

    The long form leaves out absent cells, so the denominator is the number of
    distinct (entity, day) rows. ``groups`` (channel, group) is a small dimension.
    """
    n_days = series.select("entity_id", "day").distinct().agg(F.count(F.lit(1)))
    filled = series.groupBy("channel").agg(F.count("value").alias("n_filled"))
    if groups is not None:
        filled = groups.join(filled, "channel", "left").withColumn("n_filled", F.coalesce("n_filled", F.lit(0)))
    rows = filled.withColumn("n_rows", n_days.scalar())
    missing = F.col("n_rows") - F.col("n_filled")
    return rows.withColumns(
        {"missing_count": missing, "missing_pct": F.try_divide(missing * F.lit(100.0), F.col("n_rows"))}
    )


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Filled share of all cells."""
    found = missing_by_column(df, columns)
    return found.agg(
        F.sum("n_rows").alias("n_cells"), F.sum("missing_count").alias("n_missing")
    ).withColumn(
        "completeness_pct",
        F.try_divide((F.col("n_cells") - F.col("n_missing")) * F.lit(100.0), F.col("n_cells")),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column and as % of rows.

    Exact: two partial aggregates over (variable, value). Approximate: one pass of
    sketches, nothing shuffled but the sketches.
    """
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    long = melted(df, columns, "string")
    if approximate:
        counts = long.groupBy("variable").agg(F.approx_count_distinct("value").alias("n_distinct"))
    else:
        counts = (
            long.groupBy("variable", "value").agg(F.lit(1).alias("one"))
            .groupBy("variable").agg(F.count("value").alias("n_distinct"))
        )
    return counts.withColumn("pct", F.try_divide(F.col("n_distinct") * F.lit(100.0), n_rows))


def availability(
    series: DataFrame, groups: dict[str, Sequence[str]], lo: int, hi: int, cohort_size: int
) -> DataFrame:
    """(group, day, fraction, missing_pct): entities with any value of the group that
    day over the configured cohort size; days and groups without data stay as 0.

    The missing share is cut, not rounded, to a whole percent.
    """
    pairs = [F.lit(x) for g, members in groups.items() for c in members for x in (c, g)]
    tagged = series.where(F.col("day").between(lo, hi) & F.col("value").isNotNull()).withColumn(
        "group", F.try_element_at(F.create_map(*pairs), F.col("channel"))
    )
    # (group, day, entity) first: partial aggregates absorb hot entities and days
    seen = (
        tagged.where(F.col("group").isNotNull()).groupBy("group", "day", "entity_id")
        .agg(F.lit(1).alias("one")).groupBy("group", "day").agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.explode(F.array(*[F.lit(g) for g in groups]))
    grid = series.sparkSession.range(1).select(names.alias("group")).withColumn(
        "day", F.explode(F.sequence(F.lit(lo), F.lit(hi)))
    )
    share = F.coalesce(F.col("n"), F.lit(0)) / F.lit(float(cohort_size))
    return grid.join(seen, ["group", "day"], "left").select(
        "group", "day", share.alias("fraction"), ((1 - share) * 100).cast("int").alias("missing_pct")
    )


def availability_matrix(long: DataFrame, lo: int, hi: int, value: str = "fraction") -> DataFrame:
    return long.groupBy("group").pivot("day", list(range(lo, hi + 1))).agg(F.first(value))


def crosstab(df: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """(variable, value, group, observed, expected) with empty cells kept.

    The counted cells are stored once, as every test on them reads them several
    times; margins and the grid of cells then come from that small table. A
    variable may have many values: they are spread by (variable, value), and only
    the few group totals travel to them.
    """
    long = melted(df.where(F.col(q(group)).isNotNull()), variables, "string", keep=[group])
    cells = durable(
        long.where(F.col("value").isNotNull()).groupBy("variable", "value", group).agg(
            F.count(F.lit(1)).alias("observed")
        ), "cells",
    )
    by_group = cells.groupBy("variable", group).agg(F.sum("observed").alias("_col"))
    total = by_group.groupBy("variable").agg(F.sum("_col").alias("_all"))
    sides = bounded(by_group.join(total, "variable"))
    by_value = cells.groupBy("variable", "value").agg(F.sum("observed").alias("_row"))
    full = by_value.join(sides, "variable").join(cells, ["variable", "value", group], "left")
    return full.select(
        "variable", "value", group, F.coalesce("observed", F.lit(0)).alias("observed"),
        (F.col("_row") * F.col("_col") / F.col("_all").cast("double")).alias("expected"),
    )


def class_weight(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Negatives, positives and their ratio (1 when there are no positives)."""
    counts = df.groupBy(*by).agg(
        F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos")
    )
    ratio = F.coalesce(F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")), F.lit(1.0))
    return counts.withColumn("pos_weight", ratio)


def histogram(
    df: DataFrame, columns: Sequence[str], method: str = "sqrt", min_bins: int = 5, max_bins: int = 20
) -> DataFrame:
    """(variable, bin, lo, hi, n): equal-width bins, right end closed in the last one.

    Bin number by the square root or Sturges rule, clamped; "unit" gives one bin
    per whole number.
    """
    long = melted(df, columns, "double").where(F.col("value").isNotNull())
    ends = long.groupBy("variable").agg(
        F.min("value").alias("_min"), F.max("value").alias("_max"), F.count(F.lit(1)).alias("_n")
    )
    if method == "unit":
        start, width = F.floor("_min"), F.lit(1.0)
        bins = (F.floor("_max") - F.floor("_min") + 1).cast("int")
        shaped = ends.select("variable", start.cast("double").alias("_lo"), width.alias("_w"), bins.alias("_bins"))
    else:
        raw = F.floor(F.sqrt("_n")) if method == "sqrt" else F.floor(F.log2("_n") + 1)
        bins = F.greatest(F.lit(min_bins), F.least(F.lit(max_bins), raw)).cast("int")
        # equal values get a unit-wide range around them
        flat = F.col("_min") == F.col("_max")
        lo = F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min"))
        hi = F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max"))
        shaped = ends.select("variable", lo.alias("_lo"), ((hi - lo) / bins).alias("_w"), bins.alias("_bins"))
    at = F.floor((F.col("value") - F.col("_lo")) / F.col("_w")).cast("int")
    # one row per variable: a broadcast of len(columns) rows
    binned = long.join(F.broadcast(shaped), "variable").select(
        "variable", F.least(at, F.col("_bins") - 1).alias("bin")
    )
    counts = binned.groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = shaped.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)))
    edge = F.col("_lo") + F.col("bin") * F.col("_w")
    return grid.join(counts, ["variable", "bin"], "left").select(
        "variable", "bin", edge.alias("lo"), (edge + F.col("_w")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def fold_summary(metrics: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and population deviation of per-fold metrics."""
    aggs: list[Column] = []
    for v in values:
        aggs += [F.avg(v).alias(f"mean_{v}"), F.stddev_pop(v).alias(f"std_{v}")]
    return metrics.groupBy(*by).agg(*aggs)


def top_n(df: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """Largest n rows with a name as tie-break: a per-task top-k, no full sort."""
    return df.orderBy(F.desc(by), name).limit(n)
