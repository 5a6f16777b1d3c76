"""Group comparisons, baseline tables, correlations and intervals.

All variables of a test go through one melted pass; what reaches the p-value
helpers is one row per variable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.functions.pvalues import chi2_p, fisher_p, normal_p, t_p
from daygrid.functions.recode import count_pct_text, mean_sd_text, median_iqr_text
from daygrid.operators.columns import q
from daygrid.operators.profile import crosstab, melted
from daygrid.operators.running import attach, quantile_picks, running_sums
from daygrid.session import bounded, durable


def _shape() -> list[Column]:
    return [F.count("value").alias("n"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis")]


def _judged(moments: DataFrame, alpha: float) -> DataFrame:
    jb = F.col("n") / 6.0 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4)
    # the upper tail of chi-square with two degrees of freedom is exp(-x/2)
    return moments.withColumn("statistic", jb).withColumn(
        "p_value", F.exp(-F.col("statistic") / 2)
    ).withColumn("is_normal", F.col("p_value") > alpha)


def normality(df: DataFrame, variables: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Jarque-Bera per variable: one pass of moments, any number of rows."""
    long = melted(df, variables, "double").where(F.col("value").isNotNull())
    return _judged(long.groupBy("variable").agg(*_shape()), alpha)


def _two_groups(df: DataFrame, group: str, levels: Sequence) -> DataFrame:
    a, b = levels
    return df.withColumn("_g", F.when(F.col(q(group)) == a, 1).when(F.col(q(group)) == b, 2)).where(
        F.col("_g").isNotNull()
    )


def _group_moments() -> list[Column]:
    v = F.col("value")
    one, two = (F.when(F.col("_g") == g, v) for g in (1, 2))
    return [F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("m1"), F.avg(two).alias("m2"),
            F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2")]


def _t_of_moments() -> tuple[Column, Column]:
    """t and its degrees of freedom over the columns of ``_group_moments``."""
    dof = (F.col("n1") + F.col("n2") - 2).cast("double")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    return t, dof


def t_test(df: DataFrame, variables: Sequence[str], group: str, levels: Sequence) -> DataFrame:
    """Two-sample t test with pooled variance."""
    long = melted(_two_groups(df, group, levels), variables, "double", keep=["_g"])
    m = long.where(F.col("value").isNotNull()).groupBy("variable").agg(*_group_moments())
    t, dof = _t_of_moments()
    out = m.select("variable", F.lit("t").alias("test"), t.alias("statistic"), dof.alias("df"))
    return out.withColumn("p_value", t_p("statistic", "df"))


def _rank_moments() -> list[Column]:
    """Rank sum, sizes and ties over running sums of ``n`` (all rows) and ``a`` (first group)."""
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    return [F.sum(F.col("a") * rank).alias("r1"), F.max("total_a").alias("n1"),
            (F.max("total_n") - F.max("total_a")).alias("n2"), F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("ties")]


def _u_of_moments() -> tuple[Column, Column]:
    """U and z over the columns of ``_rank_moments``."""
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    return u, F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sigma)


def _u_p(z: str) -> Column:
    return F.when(F.col(z).isNotNull(), F.when(F.col(z) > 0, normal_p(z)).otherwise(1.0))


def _counted(g: int) -> Column:
    return (F.col("_g") == g).cast("double")


def mann_whitney(df: DataFrame, variables: Sequence[str], group: str, levels: Sequence) -> DataFrame:
    """Two-sided Mann-Whitney U with tie and continuity correction; z and p are null where
    they are undefined (one row, or all values equal)."""
    long = melted(_two_groups(df, group, levels), variables, "double", keep=["_g"])
    run = running_sums(long, ["variable"], "value", {"n": F.lit(1).cast("double"), "a": _counted(1)})
    u, z = _u_of_moments()
    out = run.groupBy("variable").agg(*_rank_moments()).select(
        "variable", F.lit("mann_whitney").alias("test"), u.alias("statistic"), z.alias("z")
    )
    return out.withColumn("p_value", _u_p("z"))


def chi_square(
    df: DataFrame, variables: Sequence[str], group: str, yates: bool = True,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Pearson chi-square; 2×2 tables get Yates' correction unless switched off."""
    found = crosstab(df, variables, group) if cells is None else cells
    shape = found.groupBy("variable").agg(
        F.count(F.lit(1)).alias("_cells"), F.count_distinct("value").alias("_rows")
    )
    dof = (F.col("_rows") - 1) * (F.col("_cells") / F.col("_rows") - 1)
    diff = F.abs(F.col("observed") - F.col("expected"))
    cut = F.least(F.lit(0.5), diff) if yates else F.lit(0.0)
    small = F.when(F.col("df") == 1, diff - cut).otherwise(diff)
    joined = found.join(shape.select("variable", dof.cast("double").alias("df")), "variable")
    out = joined.groupBy("variable", "df").agg(
        F.sum(F.try_divide(small * small, F.col("expected"))).alias("statistic")
    )
    return out.select("variable", F.lit("chi_square").alias("test"), "statistic", "df").withColumn(
        "p_value", chi2_p("statistic", "df")
    )


def cochran_rule(cells: DataFrame) -> DataFrame:
    """Whether the chi-square approximation holds: no E < 1 and 80 % of cells with E >= 5."""
    out = cells.groupBy("variable").agg(
        F.min("expected").alias("min_expected"),
        (F.count_if(F.col("expected") >= 5) / F.count(F.lit(1))).alias("share_ge_5"),
    )
    return out.withColumn("ok", (F.col("min_expected") >= 1) & (F.col("share_ge_5") >= 0.8))


def fisher_exact(cells: DataFrame) -> DataFrame:
    """Fisher's exact test of the 2×2 tables among the cells, with the odds ratio.

    The ends of a variable's values and groups pick the four cells, so variables
    with many values are never gathered.
    """
    group = [c for c in cells.columns if c not in ("variable", "value", "observed", "expected")][0]
    named = cells.select("variable", "value", F.col(group).cast("string").alias("g"), "observed")
    ends = named.groupBy("variable").agg(
        F.min("value").alias("_v1"), F.max("value").alias("_v2"), F.min("g").alias("_g1"),
        F.max("g").alias("_g2"), F.count(F.lit(1)).alias("_n"),
    ).where("_n = 4 and _v1 <> _v2 and _g1 <> _g2")

    def cell(value: str, side: str) -> Column:
        here = (F.col("value") == F.col(value)) & (F.col("g") == F.col(side))
        return F.sum(F.when(here, F.col("observed")).otherwise(0))

    four = named.join(ends, "variable").groupBy("variable").agg(
        cell("_v1", "_g1").alias("a"), cell("_v1", "_g2").alias("b"),
        cell("_v2", "_g1").alias("c"), cell("_v2", "_g2").alias("d"),
    )
    odds = F.try_divide((F.col("a") * F.col("d")).cast("double"), F.col("b") * F.col("c"))
    return four.select(
        "variable", F.lit("fisher").alias("test"), odds.alias("statistic"),
        fisher_p("a", "b", "c", "d").alias("p_value"),
    )


def baseline_table(
    df: DataFrame, group: str, levels: Sequence, continuous: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """"Table 1": per variable (and level) the overall and per-group summary text, the
    test chosen by type, normality and expected counts, and its p-value."""
    parts = [
        p for p in (
            _continuous_rows(df, group, levels, continuous) if continuous else None,
            _categorical_rows(df, group, levels, categorical) if categorical else None,
        ) if p is not None
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _continuous_rows(df, group, levels, continuous, alpha: float = 0.05) -> DataFrame:
    """One pass of moments for every variable, and one order of the values of those alone
    that are not normal: it gives their ranks and the quartiles of all parts."""
    two = _two_groups(df, group, levels)
    long = melted(two, continuous, "double", keep=["_g"]).where(F.col("value").isNotNull())
    moments = long.groupBy("variable").agg(
        *_shape(), *_group_moments(), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    t, dof = _t_of_moments()
    judged = bounded(_judged(moments, alpha).withColumns({"_t": t, "_dof": dof}).drop("statistic", "p_value"))
    normal = F.coalesce("is_normal", F.lit(False))
    ranked = running_sums(
        long.join(judged.where(~normal).select("variable"), "variable", "left_semi"), ["variable"], "value",
        {"n": F.lit(1).cast("double"), "a": _counted(1), "b": _counted(2)})
    picks, quartiles = [], []
    for part in ("n", "a", "b"):
        found, out = quantile_picks("value", part, {f"{part}_{name}": p for name, p in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))})
        picks += found
        quartiles += out
    u, z = _u_of_moments()
    ranks = ranked.groupBy("variable").agg(*_rank_moments(), *picks).select("variable", z.alias("_z"), *quartiles)
    rows = judged.join(ranks, "variable", "left")

    def text(size: str, mean: str, sd: Column, part: str) -> Column:
        middle = median_iqr_text(*[F.col(f"{part}_{name}") for name in ("med", "q1", "q3")])
        return F.when(F.col(size) > 0, F.when(normal, mean_sd_text(F.col(mean), sd)).otherwise(middle))

    return rows.select(
        "variable", F.lit(None).cast("string").alias("level"), F.lit("continuous").alias("type"),
        text("n", "m", F.col("sd"), "n").alias("overall"), text("n1", "m1", F.sqrt("v1"), "a").alias("group_1"),
        text("n2", "m2", F.sqrt("v2"), "b").alias("group_2"),
        F.when(normal, "t").otherwise("mann_whitney").alias("test"),
        F.when(normal, t_p("_t", "_dof")).otherwise(_u_p("_z")).alias("p_value"),
    )


def _categorical_rows(df, group, levels, categorical) -> DataFrame:
    two = _two_groups(df, group, levels)
    cells = crosstab(two, categorical, "_g")
    count = F.col("observed")
    wide = cells.groupBy("variable", "value").agg(
        F.sum(count).alias("n0"), F.sum(F.when(F.col("_g") == 1, count)).alias("n1"),
        F.sum(F.when(F.col("_g") == 2, count)).alias("n2"),
    )
    whole = Window.partitionBy("variable")
    texts = {
        name: count_pct_text(F.col(c), F.sum(c).over(whole))
        for name, c in (("overall", "n0"), ("group_1", "n1"), ("group_2", "n2"))
    }
    chi = chi_square(two, categorical, "_g", cells=cells)
    exact = fisher_exact(cells).select("variable", F.col("p_value").alias("_pf"))
    rule = cochran_rule(cells).select("variable", "min_expected")
    tests = chi.join(rule, "variable").join(exact, "variable", "left")
    use_exact = F.col("_pf").isNotNull() & (F.col("min_expected") < 5)
    return wide.select("variable", F.col("value").alias("level"), *[t.alias(n) for n, t in texts.items()]).join(
        tests, "variable"
    ).select(
        "variable", "level", F.lit("categorical").alias("type"), "overall", "group_1", "group_2",
        F.when(use_exact, "fisher").otherwise("chi_square").alias("test"),
        F.when(use_exact, F.col("_pf")).otherwise(F.col("p_value")).alias("p_value"),
    )


def compare(df: DataFrame, variables: Sequence[str], group: str, levels: Sequence, kind: str = "continuous",
            ) -> DataFrame:
    """One row per variable with the test its type and distribution call for."""
    rows = baseline_table(
        df, group, levels, variables if kind == "continuous" else [],
        variables if kind != "continuous" else [],
    )
    return rows.select("variable", "test", "p_value").distinct()


def adjust_p(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """Bonferroni and Benjamini-Hochberg over the tested variables.

    The input has one row per variable, so its size is the width of a table; the
    two short windows over it do not grow with the data.
    """
    whole = Window.partitionBy(F.lit(0))
    m = F.count(p).over(whole)
    order = whole.orderBy(F.asc_nulls_last(p))
    ranked = tests.withColumn("_m", m).withColumn(
        "_r", F.when(F.col(p).isNotNull(), F.count(p).over(order.rangeBetween(Window.unboundedPreceding, 0)))
    )
    back = whole.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    return ranked.withColumns(
        {
            "p_bonferroni": F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("_m"))),
            "p_bh": F.when(
                F.col(p).isNotNull(),
                F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(back)),
            ),
        }
    ).drop("_m", "_r")


#: Columns whose ranks are looked up by broadcast, each of at most ``bounded`` rows.
BROADCAST_COLUMNS = 32


def rank_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns replaced by their tie-averaged ranks.

    All columns are ranked in one pass over their distinct values. A column with few
    distinct values meets its ranks by broadcast, so that its cells never move; the cells of
    the others meet theirs in one join of the long form and return in one shuffle by row.
    """
    rows = durable(df.select(*[F.col(q(c)).cast("double").alias(c) for c in columns])
                   .withColumn("_id", F.monotonically_increasing_id()), "rows")
    tally = melted(rows, columns, "double").groupBy("variable", "value").agg(F.count("*").alias("n"))
    run = running_sums(tally, ["variable"], "value", {"n": F.col("n")})
    ranks = durable(run.select("variable", "value", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank")), "ranks")
    sizes = {r["variable"]: r["count"] for r in ranks.groupBy("variable").count().collect()}  # one number per column
    small = sorted((c for c in columns if sizes.get(c, 0) <= 20_000), key=lambda c: sizes.get(c, 0))[:BROADCAST_COLUMNS]
    large = [c for c in columns if c not in small]
    out = rows
    for i, c in enumerate(small):
        side = bounded(ranks.where(F.col("variable") == c).select(F.col("value").alias(f"_v{i}"), F.col("avg_rank").alias(f"_r{i}")))
        out = out.join(side, F.col(q(c)) == F.col(f"_v{i}"), "left").drop(c, f"_v{i}").withColumnRenamed(f"_r{i}", c)
    if large:
        long = melted(rows, large, "double", keep=["_id"])
        met = attach(long, ranks, ["variable", "value"]).groupBy("_id").pivot("variable", list(large)).agg(F.first("avg_rank"))
        out = attach(out.drop(*large), met, ["_id"])
    return out.select(*[F.col(q(c)) for c in columns])


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(i, j, left, right, r) for i <= j; columns must be imputed first.

    One Gram-matrix pass over the rows (over ranks for Spearman); what returns is
    columns² numbers. Constant columns correlate 0 with others and 1 with themselves.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    rows = rank_columns(df, columns) if method == "spearman" else df.select(
        *[F.col(q(c)).cast("double").alias(c) for c in columns]
    )
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(rows).select("_v")
    matrix = Correlation.corr(vectors, "_v", "pearson").first()[0].toArray()
    values = [
        (i, j, columns[i], columns[j],
         1.0 if i == j else (0.0 if matrix[i, j] != matrix[i, j] else float(matrix[i, j])))
        for i in range(len(columns)) for j in range(i, len(columns))
    ]
    return df.sparkSession.createDataFrame(values, "i int, j int, left string, right string, r double")


def correlated_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.9) -> list[str]:
    """Columns j with |r| above the limit against any earlier column i."""
    over = correlation_matrix(df, columns).where((F.col("i") < F.col("j")) & (F.abs("r") > limit))
    hit = {r["right"] for r in over.select("right").distinct().collect()}
    return [c for c in columns if c in hit]


def prune_correlated(df: DataFrame, columns: Sequence[str], limit: float = 0.9) -> DataFrame:
    return df.drop(*correlated_columns(df, columns, limit))


def mean_ci(df: DataFrame, value: str, by: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """Mean ± z standard errors."""
    se: Column = F.stddev_samp(value) / F.sqrt(F.count(value))
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), se.alias("se"))
    return out.withColumns({"lower": F.col("mean") - z * F.col("se"), "upper": F.col("mean") + z * F.col("se")})
