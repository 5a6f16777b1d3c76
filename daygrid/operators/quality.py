"""Data-quality checks; every check returns its findings as rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.functions.recode import is_numeric_or_missing, number, parse_date
from daygrid.operators.columns import q
from daygrid.operators.running import running_row_sums, running_sums
from daygrid.session import durable


@dataclass(frozen=True)
class Rule:
    """What one column may hold: kind is integer, float, category, number_category or date.

    ``lo`` and ``hi`` are the possible range, ``usual`` the range that is met in practice:
    values outside the first are errors, outside the second warnings.
    """

    column: str
    kind: str
    lo: float | None = None
    hi: float | None = None
    categories: tuple[str, ...] = ()
    usual: tuple[float, float] | None = None


# Channels per group of the series files.
CHANNEL_GROUPS = {
    "CBC": 24,
    "Inflammatory Biomarker": 9,
    "VCN": 1,
    "Lymphocyte Subsets": 11,
    "Coagulation": 8,
    "Electrolytes": 6,
    "Biochemistry": 28,
    "Vital Signs": 6,
}


def channel_names(groups: dict[str, int] = CHANNEL_GROUPS) -> list[str]:
    return [f"{g}{i:03d}" for g, n in groups.items() for i in range(1, n + 1)]


def check_cells(raw: DataFrame, raw_value: str = "raw") -> DataFrame:
    """Cells that are neither missing nor numeric."""
    return raw.where(~is_numeric_or_missing(F.col(raw_value)))


def check_columns(headers: DataFrame, expected: Sequence[str], file: str = "file") -> DataFrame:
    """Missing (error), extra (warning) and misplaced (warning) columns per file.

    ``headers`` holds (file, pos, column), pos from 0. Only expected names are
    gathered per file, so a group is no longer than the expectation.
    """
    want = F.array(*[F.lit(c) for c in expected])
    place = F.array_position(want, F.col("column")) - 1
    tagged = headers.withColumn("_place", F.when(place >= 0, place))
    extra = tagged.where(F.col("_place").isNull()).select(
        file, F.lit("extra_column").alias("kind"), F.lit("warning").alias("severity"), "column"
    )
    per_file = tagged.groupBy(file).agg(
        F.collect_set(F.when(F.col("_place").isNotNull(), F.col("column"))).alias("_have"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("_place").isNull() | (F.col("_place") != F.col("pos"))).alias("_moved"),
    )
    missing = per_file.select(
        file, F.explode(F.array_except(want, "_have")).alias("column")
    ).select(file, F.lit("missing_column").alias("kind"), F.lit("error").alias("severity"), "column")
    moved = per_file.where(
        (F.size("_have") == len(expected)) & (F.col("_n") == len(expected)) & (F.col("_moved") > 0)
    ).select(
        file, F.lit("wrong_order").alias("kind"), F.lit("warning").alias("severity"),
        F.lit(None).cast("string").alias("column"),
    )
    return missing.unionByName(extra).unionByName(moved)


def check_counts(
    files: DataFrame, expected_columns: int, lo: int, hi: int, expected_rows_with_header: int,
    file: str = "file",
) -> DataFrame:
    """Column and row counts against the configured numbers.

    ``files`` holds (file, n_columns, n_rows); a configured total that disagrees
    with the day range is itself a warning on every file.
    """
    days = hi - lo + 1
    rules = [
        ("column_count", "error", expected_columns, F.col("n_columns")),
        ("data_rows", "error", days, F.col("n_rows")),
        ("rows_with_header", "error", expected_rows_with_header, F.col("n_rows") + 1),
        ("configured_rows", "warning", expected_rows_with_header, F.lit(days + 1)),
    ]
    findings = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"), F.lit(severity).alias("severity"),
                F.lit(want).cast("long").alias("expected"), got.cast("long").alias("actual"),
            )
            for name, severity, want, got in rules
        ]
    )
    return files.select(file, F.inline(findings)).where("expected <> actual")


def check_day_grid(
    rows: DataFrame, lo: int, hi: int, entity: str = "entity_id", day: str = "day",
    position: str | None = None,
) -> DataFrame:
    """Entities whose days are not exactly lo…hi (in row order when a position is given).

    Counting replaces gathering the days: n rows, all in range, none twice, and at
    its place. ``first_gap`` is the first absent day.
    """
    width = hi - lo + 1
    inside = F.col(day).between(lo, hi)
    per_day = rows.groupBy(entity, F.when(inside, F.col(day)).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.count_if(F.col(day) != F.col(position) + lo) if position else F.lit(0)).alias("_moved"),
    )
    # at most one row per day of the grid is left per entity
    found = per_day.groupBy(entity).agg(
        F.sum("_n").cast("long").alias("n_rows"),
        F.count("_d").cast("long").alias("n_days"),
        F.sum(F.when(F.col("_d").isNull(), F.col("_n")).otherwise(0)).cast("long").alias("n_outside"),
        F.sum("_moved").cast("long").alias("n_misplaced"),
        F.array_except(F.sequence(F.lit(lo), F.lit(hi)), F.collect_set("_d")).alias("_gaps"),
    )
    return found.where(
        (F.col("n_rows") != width) | (F.col("n_days") != width) | (F.col("n_misplaced") > 0)
    ).select(entity, "n_rows", "n_days", "n_outside", "n_misplaced",
             F.array_min("_gaps").alias("first_gap"))


def with_position(lines: DataFrame, file: str, line: str) -> DataFrame:
    """``lines`` with ``position`` 0, 1, … within each file, in line order.

    ``line`` is the (start, row) of the reader, or a number that is unique in its file. Rows
    are numbered inside the split that read them (inside a bucket of numbers), and every
    split starts from the rows of those before it, so that no task orders more than a split,
    however long a file is.
    """
    if not isinstance(lines.schema[line].dataType, T.StructType):
        counted = running_row_sums(lines.withColumn("_one", F.lit(1).cast("long")), [file], line, {"_one": "position"})
        return counted.withColumn("position", F.col("position") - 1).drop("_one")
    split = [F.col(file).alias("_file"), F.col(f"{line}.start").alias("_start")]
    counts = lines.groupBy(*split).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_file", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_file", "_start").orderBy(F.col(line))
    placed = lines.withColumns({"_file": F.col(file), "_start": F.col(f"{line}.start")}).withColumn("_at", F.row_number().over(inside) - 1)
    return placed.join(before, ["_file", "_start"]).withColumn("position", F.col("_before") + F.col("_at")).drop("_file", "_start", "_at", "_before")


def check_entity_count(df: DataFrame, expected: int, entity: str = "entity_id") -> DataFrame:
    found = df.select(entity).distinct().agg(F.count(F.lit(1)).alias("actual"))
    return found.select(
        F.lit(expected).cast("long").alias("expected"), "actual",
        (F.col("actual") != expected).alias("warning"),
    )


def _rule_issue(rule: Rule) -> Column:
    raw = F.col(q(rule.column)).cast("string")
    text = F.trim(raw)
    n = number(raw)
    present = raw.isNotNull() & (text != "")
    if rule.kind in ("integer", "float"):
        value = n.try_cast("long") if rule.kind == "integer" else n
        issue = F.when(value.isNull(), "type_error").when(
            ~value.between(rule.lo, rule.hi), "range_error"
        )
        if rule.usual is not None:
            issue = issue.when(~value.between(*rule.usual), "range_warning")
    elif rule.kind == "category":
        issue = F.when(~text.isin(*rule.categories), "categorical_error")
    elif rule.kind == "number_category":
        plain = F.when(n == n.try_cast("long"), n.try_cast("long").cast("string"))
        ok = F.coalesce(plain, text).isin(*rule.categories)
        issue = F.when(~ok, "categorical_error")
    elif rule.kind == "date":
        issue = F.when(parse_date(raw).isNull(), "date_format_error")
    else:
        raise ValueError(f"unknown rule kind {rule.kind!r}")
    return F.struct(
        F.lit(rule.column).alias("column"), raw.alias("value"),
        F.when(present, issue).alias("issue"),
    )


def check_rules(df: DataFrame, rules: Sequence[Rule], row_id: str) -> DataFrame:
    """(row id, column, value, issue) for every broken rule, in one pass."""
    used = [r for r in rules if r.column in df.columns]
    found = F.filter(F.array(*[_rule_issue(r) for r in used]), lambda s: s["issue"].isNotNull())
    return df.select(F.col(q(row_id)).alias("row_id"), F.inline(found))


def check_id_continuity(df: DataFrame, column: str) -> DataFrame:
    """Findings on ids that should run 1, 2, 3, … : bad_start, gap (first only), duplicate.

    ``expected`` and ``actual`` follow the sorted list: the first place where the
    id differs from its position.
    """
    ids = df.select(number(F.col(q(column))).try_cast("long").alias("id"))
    # the three kinds of finding each read the distinct ids
    run = durable(running_sums(ids, [], "id", {"n": F.lit(1)}), "ids")
    place = F.col("cum_n") - F.col("n") + 1
    broken = F.when(F.col("id") != place, F.struct(place.alias("p"), F.col("id").alias("a"))).when(
        F.col("n") > 1, F.struct((place + 1).alias("p"), F.col("id").alias("a"))
    )
    first = run.agg(F.min("id").alias("lo"), F.min(broken).alias("b"))
    start = first.where("lo <> 1").select(
        F.lit("bad_start").alias("issue"), F.lit(1).cast("long").alias("expected"),
        F.col("lo").alias("actual"),
    )
    gap = first.where("b is not null").select(
        F.lit("gap").alias("issue"), F.col("b.p").cast("long").alias("expected"),
        F.col("b.a").alias("actual"),
    )
    twice = run.where("n > 1").select(
        F.lit("duplicate").alias("issue"), F.lit(None).cast("long").alias("expected"),
        F.col("id").alias("actual"),
    )
    return start.unionByName(gap).unionByName(twice)


def issue_counts(issues: DataFrame, by: Sequence[str] = ("issue",)) -> DataFrame:
    return issues.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def first_examples(
    issues: DataFrame, k: int = 5, by: Sequence[str] = ("issue",),
    order: Sequence[str] = ("row_id", "column"),
) -> DataFrame:
    """First k issues of each type; the row_number filter becomes a per-task top-k."""
    window = Window.partitionBy(*by).orderBy(*order)
    return issues.withColumn("example", F.row_number().over(window)).where(F.col("example") <= k)


def file_verdicts(files: DataFrame, issues: DataFrame, file: str = "file") -> DataFrame:
    """Per file: error and warning counts and whether it is valid (no error).

    Warnings of valid files are kept.
    """
    per_file = issues.groupBy(file).agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    )
    return files.select(file).distinct().join(per_file, file, "left").select(
        file,
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
        F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"),
        (F.coalesce("n_errors", F.lit(0)) == 0).alias("valid"),
    )


def any_valid(verdicts: DataFrame) -> bool:
    """Gate between validation and processing: at least one valid file."""
    return not verdicts.where("valid").isEmpty()


def check_partition_integrity(
    static: DataFrame, series_ids: DataFrame, group: str, known: Sequence[str],
    entity: str = "entity_id",
) -> DataFrame:
    """Per group: entities, with series, without. Groups outside ``known`` count as other."""
    present = F.when(F.col(group).isin(list(known)), F.col(group)).otherwise("other")
    flagged = with_series_flag(static, series_ids, entity)
    return flagged.groupBy(present.alias(group)).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if("has_series").alias("n_with_series"),
        F.count_if(~F.col("has_series")).alias("n_without_series"),
    )


def with_series_flag(static: DataFrame, series_ids: DataFrame, entity: str = "entity_id") -> DataFrame:
    ids = series_ids.select(entity).distinct().withColumn("has_series", F.lit(True))
    return static.join(ids, entity, "left").withColumn("has_series", F.coalesce("has_series", F.lit(False)))


def check_folds(assignment: DataFrame, total: int | None = None) -> DataFrame:
    """Per fold: sizes, ids on both sides, ids on neither.

    ``assignment`` holds (fold, role, id) with role train or val. Complete means
    train and val together cover every id of the whole table exactly once.
    """
    per_id = assignment.groupBy("fold", "id").agg(
        F.count_if(F.col("role") == "train").alias("_t"), F.count_if(F.col("role") == "val").alias("_v")
    )
    per_fold = per_id.groupBy("fold").agg(
        F.count_if(F.col("_t") > 0).alias("n_train"),
        F.count_if(F.col("_v") > 0).alias("n_val"),
        F.count_if((F.col("_t") > 0) & (F.col("_v") > 0)).alias("n_overlap"),
        F.count(F.lit(1)).alias("n_ids"),
    )
    if total is not None:
        everyone = F.lit(total)
    else:
        everyone = assignment.select("id").distinct().agg(F.count(F.lit(1))).scalar()
    return per_fold.withColumn("ok", (F.col("n_overlap") == 0) & (F.col("n_ids") == everyone))


def monitor_variables(
    entities: DataFrame, series: DataFrame, variables: Sequence[str], lo: int = -15, hi: int = 0
) -> DataFrame:
    """Per entity and variable: has data in the window, or why not, and the observed days.

    Reasons: patient_file_not_found, no_data_in_time_window, value_is_nan.
    """
    inside = F.col("day").between(lo, hi)
    per_entity = series.groupBy("entity_id").agg(
        F.min(F.when(inside, F.col("day"))).alias("first_day"),
        F.max(F.when(inside, F.col("day"))).alias("last_day"),
        *[
            F.max(F.when(inside & (F.col("channel") == v) & F.col("value").isNotNull(), True))
            .alias(f"_has_{i}")
            for i, v in enumerate(variables)
        ],
    ).withColumn("_file", F.lit(True))
    names = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.coalesce(F.col(f"_has_{i}"), F.lit(False)).alias("has_data"))
            for i, v in enumerate(variables)
        ]
    )
    joined = entities.select("entity_id").distinct().join(per_entity, "entity_id", "left")
    rows = joined.select("entity_id", "first_day", "last_day", "_file", F.inline(names))
    reason = (
        F.when(F.col("has_data"), None).when(F.col("_file").isNull(), "patient_file_not_found")
        .when(F.col("first_day").isNull(), "no_data_in_time_window").otherwise("value_is_nan")
    )
    return rows.select("entity_id", "variable", "has_data", reason.alias("reason"), "first_day", "last_day")


def monitor_summary(monitored: DataFrame) -> DataFrame:
    return monitored.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(~F.col("has_data")).alias("n_empty"),
        F.count_if(F.col("reason") == "patient_file_not_found").alias("n_no_file"),
        F.count_if(F.col("reason") == "no_data_in_time_window").alias("n_no_window"),
        F.count_if(F.col("reason") == "value_is_nan").alias("n_nan"),
    )


def union_findings(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
