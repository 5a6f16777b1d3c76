"""Queries for statistical comparisons and feature preparation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from daygrid.operators import neighbours, prep, splits, stats
from daygrid.plans.bindings import FOLDS, STATIC
from daygrid.plans.registry import query

LONG = """
, long AS (SELECT 'acctbal' AS variable, CASE WHEN sex = 'male' THEN 1 ELSE 2 END AS g, acctbal AS v FROM static
           UNION ALL SELECT 'age', CASE WHEN sex = 'male' THEN 1 ELSE 2 END, CAST(age AS DOUBLE) FROM static)"""
MOMENTS = """
, m AS (SELECT variable, count(v) AS n, avg(v) AS mu FROM long GROUP BY 1),
k AS (SELECT l.variable, m.n, avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4
      FROM long l JOIN m ON m.variable = l.variable WHERE v IS NOT NULL GROUP BY 1, 2)"""
NONE = "none AS (SELECT 1)"


@query("normality", "T1s", LONG + MOMENTS + """
, s AS (SELECT variable, n, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM k),
j AS (SELECT *, n / 6.0 * (pow(skewness, 2) + pow(kurtosis, 2) / 4) AS statistic FROM s)
SELECT variable, n, skewness, kurtosis, statistic, exp(-statistic / 2) AS p_value, exp(-statistic / 2) > 0.05 AS is_normal FROM j""",
       STATIC, "skewness kurtosis statistic p_value")
def normality(t):
    return stats.normality(t.static, ["acctbal", "age"])


T_SQL = LONG + """
, g AS (SELECT variable, count(v) FILTER (WHERE g = 1) AS n1, count(v) FILTER (WHERE g = 2) AS n2, avg(v) FILTER (WHERE g = 1) AS m1,
               avg(v) FILTER (WHERE g = 2) AS m2, var_samp(v) FILTER (WHERE g = 1) AS v1, var_samp(v) FILTER (WHERE g = 2) AS v2 FROM long GROUP BY 1),
t AS (SELECT variable, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (CAST(1 AS DOUBLE) / n1 + CAST(1 AS DOUBLE) / n2)) AS statistic,
             CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM g)"""


@query("t_test", "T2", T_SQL + " SELECT variable, 't' AS test, statistic, df FROM t", STATIC, "statistic df")
def t_test(t):
    return stats.t_test(t.static, ["acctbal", "age"], "sex", ["male", "female"]).drop("p_value")


# the t distribution of whole degrees of freedom is a finite sum over powers of the cosine
T_P_SQL = T_SQL + """
, a AS (SELECT *, atan(abs(statistic) / sqrt(df)) AS angle, CAST(df AS BIGINT) AS nu FROM t),
e AS (SELECT variable, sum(exp(CASE WHEN nu % 2 = 0 THEN lgamma(j + 0.5) - lgamma(j + 1) - 0.5 * ln(pi()) + 2 * j * ln(cos(angle))
                                    ELSE lgamma(j + 1) + 0.5 * ln(pi()) - ln(2) - lgamma(j + 1.5) + (2 * j + 1) * ln(cos(angle)) END)) AS terms
      FROM (SELECT *, unnest(range(0, CASE WHEN nu % 2 = 0 THEN nu // 2 ELSE (nu - 1) // 2 END)) AS j FROM a) AS x GROUP BY 1)
SELECT a.variable, 't' AS test, statistic, df,
       1 - CASE WHEN nu % 2 = 0 THEN sin(angle) * terms ELSE 2 / pi() * (angle + sin(angle) * coalesce(terms, 0)) END AS p_value
FROM a LEFT JOIN e ON e.variable = a.variable"""


@query("t_test_with_p", "T2", T_P_SQL, STATIC, "statistic df p_value")
def t_test_with_p(t):
    return stats.t_test(t.static, ["acctbal", "age"], "sex", ["male", "female"])


def normal_tail(z: str) -> str:
    """Two-sided normal tail in SQL, as one less the alternating series of the middle; beyond
    6 it has no digit among the six that are compared."""
    term = f"(CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * j + 1) * ln({z}) - j * ln(2) - lgamma(j + 1) - ln(2 * j + 1))"
    series = f"list_sum(list_transform(range(0, 100), lambda j: {term}))"
    return f"CASE WHEN {z} > 6 THEN 0 WHEN {z} > 0 THEN least(1, 1 - 2 / sqrt(2 * pi()) * {series}) ELSE 1 END"


def chi2_tail(x: str, df: str) -> str:
    """Upper chi-square tail in SQL: a finite sum for whole degrees of freedom, beside the
    normal tail where they are odd."""
    half = f"({x} / CAST(2 AS DOUBLE))"
    even = f"list_sum(list_transform(range(0, {df} // 2), lambda i: exp(i * ln({half}) - {half} - lgamma(i + 1))))"
    odd = f"coalesce(list_sum(list_transform(range(1, ({df} + 1) // 2), lambda i: exp((i - 0.5) * ln({half}) - {half} - lgamma(i + 0.5)))), 0)"
    return f"CASE WHEN {x} <= 0 THEN 1 WHEN {df} % 2 = 0 THEN {even} ELSE {normal_tail(f'sqrt({x})')} + {odd} END"


U_SQL = LONG + """
, r AS (SELECT variable, g, v, (rank() OVER o + rank() OVER o + count(*) OVER (PARTITION BY variable, v) - 1) / CAST(2 AS DOUBLE) AS rk,
               count(*) OVER (PARTITION BY variable, v) AS t FROM long WHERE v IS NOT NULL WINDOW o AS (PARTITION BY variable ORDER BY v)),
s AS (SELECT variable, CAST(count(*) FILTER (WHERE g = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE g = 2) AS DOUBLE) AS n2,
             sum(rk) FILTER (WHERE g = 1) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma FROM s)"""


@query("mann_whitney", "T3 W9", U_SQL + """
SELECT variable, 'mann_whitney' AS test, u AS statistic, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma AS z FROM u""",
       STATIC, "statistic z")
def mann_whitney(t):
    return stats.mann_whitney(t.static, ["acctbal", "age"], "sex", ["male", "female"]).drop("p_value")


@query("mann_whitney_with_p", "T3 W9", U_SQL + f"""
, z AS (SELECT variable, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma AS z FROM u)
SELECT variable, 'mann_whitney' AS test, u AS statistic, z, {normal_tail("z")} AS p_value FROM z""", STATIC, "statistic z p_value")
def mann_whitney_with_p(t):
    return stats.mann_whitney(t.static, ["acctbal", "age"], "sex", ["male", "female"])


@query("mann_whitney_large", "T3", """
, long AS (SELECT 'l_extendedprice' AS variable, CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS g, l_extendedprice AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')
           UNION ALL SELECT 'l_quantity', CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R'))
""" + U_SQL[U_SQL.index(", r AS"):] + """
SELECT variable, u AS statistic, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma AS z FROM u""", NONE, "statistic z")
def mann_whitney_large(t):
    return stats.mann_whitney(t.lineitem, ["l_extendedprice", "l_quantity"], "l_returnflag", ["A", "R"]).select(
        "variable", "statistic", "z"
    )


CELLS = """
, long AS (SELECT 'segment' AS variable, segment AS value, sex AS g FROM static
           UNION ALL SELECT 'crs', CAST(crs AS VARCHAR), sex FROM static WHERE crs IS NOT NULL
           UNION ALL SELECT 'old', CASE WHEN age >= 65 THEN 'yes' ELSE 'no' END, sex FROM static WHERE age IS NOT NULL),
cells AS (SELECT r.variable, r.value, c.g, count(l.g) AS o, max(r.k) * max(c.k) / CAST(max(n.k) AS DOUBLE) AS e
          FROM (SELECT variable, value, count(*) AS k FROM long GROUP BY 1, 2) AS r
          JOIN (SELECT variable, g, count(*) AS k FROM long GROUP BY 1, 2) AS c ON c.variable = r.variable
          JOIN (SELECT variable, count(*) AS k FROM long GROUP BY 1) AS n ON n.variable = r.variable
          LEFT JOIN long l ON l.variable = r.variable AND l.value = r.value AND l.g = c.g GROUP BY 1, 2, 3)"""


def with_old(t):
    old = F.when(F.col("age") >= 65, "yes").when(F.col("age").isNotNull(), "no")
    return t.static.withColumn("old", old)


@query("chi_square", "T4 A21", CELLS + """
, d AS (SELECT variable, (count(DISTINCT value) - 1) * (count(DISTINCT g) - 1) AS df FROM cells GROUP BY 1)
SELECT c.variable, 'chi_square' AS test, CAST(d.df AS DOUBLE) AS df,
       sum(pow(abs(o - e) - CASE WHEN d.df = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS statistic
FROM cells c JOIN d ON d.variable = c.variable GROUP BY 1, 3""", STATIC, "statistic df")
def chi_square(t):
    return stats.chi_square(with_old(t), ["segment", "crs", "old"], "sex").drop("p_value")


@query("chi_square_with_p", "T4", CELLS + f"""
, d AS (SELECT variable, (count(DISTINCT value) - 1) * (count(DISTINCT g) - 1) AS df FROM cells GROUP BY 1),
x AS (SELECT c.variable, d.df, sum(pow(o - e, 2) / e) AS statistic FROM cells c JOIN d ON d.variable = c.variable GROUP BY 1, 2)
SELECT variable, 'chi_square' AS test, CAST(df AS DOUBLE) AS df, statistic, {chi2_tail("statistic", "df")} AS p_value FROM x""",
       STATIC, "statistic df p_value")
def chi_square_with_p(t):
    return stats.chi_square(with_old(t), ["segment", "crs", "old"], "sex", yates=False)


@query("cochran_rule", "T6", CELLS + """
SELECT variable, min(e) AS min_expected, count(*) FILTER (WHERE e >= 5) / CAST(count(*) AS DOUBLE) AS share_ge_5,
       min(e) >= 1 AND count(*) FILTER (WHERE e >= 5) / CAST(count(*) AS DOUBLE) >= 0.8 AS ok FROM cells GROUP BY 1""",
       STATIC, "min_expected share_ge_5")
def cochran_rule(t):
    return stats.cochran_rule(stats.crosstab(with_old(t), ["segment", "crs", "old"], "sex"))


@query("fisher_exact", "T5", CELLS + """
SELECT variable, 'fisher' AS test,
       max(CASE WHEN value = 'no' AND g = 'female' THEN o END) * CAST(max(CASE WHEN value = 'yes' AND g = 'male' THEN o END) AS DOUBLE)
         / (max(CASE WHEN value = 'no' AND g = 'male' THEN o END) * max(CASE WHEN value = 'yes' AND g = 'female' THEN o END)) AS statistic
FROM cells WHERE variable = 'old' GROUP BY 1""", STATIC, "statistic")
def fisher_exact(t):
    return stats.fisher_exact(stats.crosstab(with_old(t), ["segment", "old"], "sex")).drop("p_value")


@query("fisher_exact_with_p", "T5", CELLS + """
, q AS (SELECT max(CASE WHEN value = 'no' AND g = 'female' THEN o END) AS a, max(CASE WHEN value = 'no' AND g = 'male' THEN o END) AS b,
               max(CASE WHEN value = 'yes' AND g = 'female' THEN o END) AS c, max(CASE WHEN value = 'yes' AND g = 'male' THEN o END) AS d
        FROM cells WHERE variable = 'old'),
k AS (SELECT CAST(unnest(generate_series(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT))) AS DOUBLE) AS k, q.* FROM q),
l AS (SELECT *, -(lgamma(k + 1) + lgamma(a + c - k + 1) + lgamma(a + b - k + 1) + lgamma(d - a + k + 1)) AS lp FROM k),
m AS (SELECT *, max(lp) OVER () AS top, max(CASE WHEN k = a THEN lp END) OVER () AS seen FROM l)
SELECT 'old' AS variable, 'fisher' AS test, any_value(a) * CAST(any_value(d) AS DOUBLE) / (any_value(b) * any_value(c)) AS statistic,
       sum(exp(lp - top)) FILTER (WHERE lp <= seen + 1e-7) / sum(exp(lp - top)) AS p_value FROM m""", STATIC, "statistic p_value")
def fisher_exact_with_p(t):
    return stats.fisher_exact(stats.crosstab(with_old(t), ["segment", "old"], "sex"))


@query("baseline_table", "T7 F15", CELLS + """
, text AS (SELECT variable, value AS level, 'categorical' AS type,
    printf('%d (%.1f%%)', CAST(sum(o) AS BIGINT), sum(o) * CAST(100 AS DOUBLE) / sum(sum(o)) OVER w) AS overall,
    printf('%d (%.1f%%)', CAST(sum(o) FILTER (WHERE g = 'male') AS BIGINT), sum(o) FILTER (WHERE g = 'male') * CAST(100 AS DOUBLE) / sum(sum(o) FILTER (WHERE g = 'male')) OVER w) AS group_1,
    printf('%d (%.1f%%)', CAST(sum(o) FILTER (WHERE g = 'female') AS BIGINT), sum(o) FILTER (WHERE g = 'female') * CAST(100 AS DOUBLE) / sum(sum(o) FILTER (WHERE g = 'female')) OVER w) AS group_2,
    'chi_square' AS test FROM cells WHERE variable <> 'old' GROUP BY 1, 2 WINDOW w AS (PARTITION BY variable)),
num AS (SELECT 'age' AS variable, CAST(NULL AS VARCHAR) AS level, 'continuous' AS type,
    printf('%.1f (%.1f-%.1f)', quantile_cont(CAST(age AS DOUBLE), 0.5), quantile_cont(CAST(age AS DOUBLE), 0.25), quantile_cont(CAST(age AS DOUBLE), 0.75)) AS overall,
    printf('%.1f (%.1f-%.1f)', quantile_cont(CAST(age AS DOUBLE), 0.5) FILTER (WHERE sex = 'male'), quantile_cont(CAST(age AS DOUBLE), 0.25) FILTER (WHERE sex = 'male'), quantile_cont(CAST(age AS DOUBLE), 0.75) FILTER (WHERE sex = 'male')) AS group_1,
    printf('%.1f (%.1f-%.1f)', quantile_cont(CAST(age AS DOUBLE), 0.5) FILTER (WHERE sex = 'female'), quantile_cont(CAST(age AS DOUBLE), 0.25) FILTER (WHERE sex = 'female'), quantile_cont(CAST(age AS DOUBLE), 0.75) FILTER (WHERE sex = 'female')) AS group_2,
    'mann_whitney' AS test FROM static)
SELECT * FROM text UNION ALL SELECT * FROM num""", STATIC)
def baseline_table(t):
    return stats.baseline_table(t.static, "sex", ["male", "female"], ["age"], ["segment", "crs"]).drop("p_value")


def one_digit(x: str) -> str:
    """A number with one digit after the point, halves upwards."""
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(28, 10)), 1) AS DECIMAL(28, 1)) AS VARCHAR)"


def _median_text(part: str) -> str:
    q1, med, q3 = (one_digit(f"quantile_cont(v, {x}) {part}") for x in (0.25, 0.5, 0.75))
    return f"{med} || ' (' || {q1} || '-' || {q3} || ')'"


def _mean_text(part: str) -> str:
    return one_digit(f"avg(v) {part}") + " || ' ± ' || " + one_digit(f"stddev_samp(v) {part}")


def _share_text(count: str) -> str:
    return f"{count} || ' (' || " + one_digit(f"{count} * CAST(100 AS DOUBLE) / sum({count}) OVER (PARTITION BY variable)") + " || '%)'"


_PARTS = {"overall": "", "group_1": "FILTER (WHERE g = 1)", "group_2": "FILTER (WHERE g = 2)"}
SPLIT_TABLE_SQL = """
, halves AS (SELECT *, CASE WHEN row_number() OVER w <= round(count(*) OVER (PARTITION BY region) * CAST(0.3 AS DOUBLE)) THEN 2 ELSE 1 END AS half
             FROM static WINDOW w AS (PARTITION BY region ORDER BY md5(concat('42-', entity_id)))),
long AS (SELECT 'acctbal' AS variable, half AS g, CAST(acctbal AS DOUBLE) AS v FROM halves
         UNION ALL SELECT 'age', half, CAST(age AS DOUBLE) FROM halves)""" + MOMENTS + """
, j AS (SELECT variable, exp(-(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) / 2) > 0.05 AS is_normal FROM k)""" \
    + T_P_SQL[T_P_SQL.index(", g AS"):T_P_SQL.index("SELECT a.variable")].rstrip() + """
, tp AS (""" + T_P_SQL[T_P_SQL.index("SELECT a.variable"):] + ")" + U_SQL[U_SQL.index(", r AS"):] + f"""
, z AS (SELECT variable, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma AS z FROM u),
up AS (SELECT variable, {normal_tail("z")} AS p_value FROM z),
texts AS (SELECT variable, {", ".join(f"{_median_text(f)} AS med_{n}, {_mean_text(f)} AS mean_{n}" for n, f in _PARTS.items())}
          FROM long WHERE v IS NOT NULL GROUP BY 1),
num AS (SELECT variable, CAST(NULL AS VARCHAR) AS level, 'continuous' AS type,
               {", ".join(f"CASE WHEN is_normal THEN mean_{n} ELSE med_{n} END AS {n}" for n in _PARTS)},
               CASE WHEN is_normal THEN 't' ELSE 'mann_whitney' END AS test, CASE WHEN is_normal THEN tp.p_value ELSE up.p_value END AS p_value
        FROM texts JOIN j USING (variable) JOIN tp USING (variable) JOIN up USING (variable)),
kinds AS (SELECT 'segment' AS variable, segment AS value, half AS g FROM halves
          UNION ALL SELECT 'crs', CAST(crs AS VARCHAR), half FROM halves WHERE crs IS NOT NULL UNION ALL SELECT 'sex', sex, half FROM halves),
c AS (SELECT variable, value, count(*) AS n0, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 2) AS n2 FROM kinds GROUP BY 1, 2),
margins AS (SELECT variable, sum(n0) AS s0, sum(n1) AS s1, sum(n2) AS s2, count(*) - 1 AS df FROM c GROUP BY 1),
each AS (SELECT variable, df, abs(n1 - n0 * s1 / CAST(s0 AS DOUBLE)) AS d1, n0 * s1 / CAST(s0 AS DOUBLE) AS e1, abs(n2 - n0 * s2 / CAST(s0 AS DOUBLE)) AS d2,
                n0 * s2 / CAST(s0 AS DOUBLE) AS e2 FROM c JOIN margins USING (variable)),
chi AS (SELECT variable, df, sum(pow(d1 - CASE WHEN df = 1 THEN least(0.5, d1) ELSE 0 END, 2) / e1
                               + pow(d2 - CASE WHEN df = 1 THEN least(0.5, d2) ELSE 0 END, 2) / e2) AS x FROM each GROUP BY 1, 2),
cat AS (SELECT variable, value AS level, 'categorical' AS type, {", ".join(f"{_share_text(f'n{i}')} AS {n}" for i, n in enumerate(_PARTS))} FROM c)
SELECT * FROM num UNION ALL
SELECT cat.*, 'chi_square' AS test, {chi2_tail("x", "df")} AS p_value FROM cat JOIN chi USING (variable)"""


@query("baseline_table_by_split", "T7", SPLIT_TABLE_SQL, STATIC, "p_value")
def baseline_table_by_split(t):
    split = splits.stratified_split(t.static, "entity_id", "region", 0.3)
    return stats.baseline_table(split, "split", ["train", "test"], ["age", "acctbal"], ["segment", "crs", "sex"])


@query("compared_variables", "T2 T3 T7", LONG + MOMENTS + """
SELECT variable, CASE WHEN exp(-(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)) / 2) > 0.05
                      THEN 't' ELSE 'mann_whitney' END AS test, true AS has_p FROM k""", STATIC)
def compared_variables(t):
    chosen = stats.compare(t.static, ["age", "acctbal"], "sex", ["male", "female"])
    return chosen.select("variable", "test", F.col("p_value").between(0, 1).alias("has_p"))


@query("adjusted_p", "T8", """
, tests AS (SELECT l_shipmode AS variable, p FROM (
    SELECT p_brand AS l_shipmode, (count(*) * 7 % 101) / CAST(1000 AS DOUBLE) AS p FROM part GROUP BY 1) AS x),
r AS (SELECT variable, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM tests)
SELECT variable, p AS p_value, least(1, p * m) AS p_bonferroni,
       least(1, min(p * m / r) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_bh FROM r""", NONE,
       "p_value p_bonferroni p_bh")
def adjusted_p(t):
    tests = t.part.groupBy(F.col("p_brand").alias("variable")).agg(
        ((F.count(F.lit(1)) * 7 % 101) / 1000.0).alias("p_value")
    )
    return stats.adjust_p(tests)


def _corr_sql(fn: str, cols: list[str]) -> str:
    parts = [
        f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, '{a}' AS \"left\", '{b}' AS \"right\", "
        + ("CAST(1 AS DOUBLE)" if i == j else fn.format(a=a, b=b)) + " AS r FROM src"
        + (" LIMIT 1" if i == j else "")
        for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j
    ]
    return " UNION ALL ".join(f"SELECT * FROM ({p}) AS q{n}" for n, p in enumerate(parts))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pearson_matrix", "T9", ", src AS (SELECT * FROM lineitem) " + _corr_sql("corr({a}, {b})", MEASURES), NONE, "r")
def pearson_matrix(t):
    return stats.correlation_matrix(t.lineitem, MEASURES)


RANKED = ", ".join(
    f"(rank() OVER (ORDER BY {c}) * 2 + count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in MEASURES
)


@query("spearman_matrix", "T10", f", src AS (SELECT {RANKED} FROM lineitem) " + _corr_sql("corr({a}, {b})", MEASURES), NONE, "r")
def spearman_matrix(t):
    return stats.correlation_matrix(t.lineitem, MEASURES, "spearman")


@query("pruned_columns", "T9", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
       doubles="l_quantity l_extendedprice l_discount l_tax")
def pruned_columns(t):
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *measures).withColumn("double_quantity", F.col("l_quantity") * 2 + 1)
    return stats.prune_correlated(rows, [*measures, "double_quantity"], 0.9)


@query("mean_interval", "T11", """
, s AS (SELECT segment, avg(acctbal) AS mean, stddev_samp(acctbal) / sqrt(count(acctbal)) AS se FROM static GROUP BY 1)
SELECT *, mean - 1.96 * se AS lower, mean + 1.96 * se AS upper FROM s""", STATIC, "mean se lower upper")
def mean_interval(t):
    return stats.mean_ci(t.static, "acctbal", ["segment"])


SPLIT = STATIC + """,
sides AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY segment ORDER BY md5(concat('42-', entity_id)))
                              <= round(count(*) OVER (PARTITION BY segment) * CAST(0.3 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM static)"""


def sides(t):
    return splits.stratified_split(t.static, "entity_id", "segment", 0.3, 42)


@query("median_imputed", "M1", """
, m AS (SELECT median(acctbal) AS a, median(age) AS g FROM sides WHERE split = 'train')
SELECT entity_id, coalesce(acctbal, a) AS acctbal, coalesce(CAST(age AS DOUBLE), g) AS age FROM sides, m""", SPLIT, "acctbal age")
def median_imputed(t):
    rows = sides(t)
    medians = prep.learn_medians(rows.where("split = 'train'"), ["acctbal", "age"])
    return prep.impute(rows.withColumn("age", F.col("age").cast("double")), medians).select("entity_id", "acctbal", "age")


@query("mode_imputed", "M2", """
, m AS (SELECT CAST(crs AS VARCHAR) AS v FROM sides WHERE split = 'train' AND crs IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT entity_id, coalesce(CAST(crs AS VARCHAR), v) AS crs, coalesce(CAST(icans AS VARCHAR), 'missing') AS icans FROM sides, m""", SPLIT)
def mode_imputed(t):
    rows = sides(t)
    modes = prep.learn_modes(rows.where("split = 'train'"), ["crs"])
    text = rows.select("entity_id", F.col("crs").cast("string"), F.col("icans").cast("string"))
    return prep.impute(text, {**modes, "icans": "missing"})


@query("standard_scaled", "M3", """
, m AS (SELECT avg(acctbal) AS a, stddev_pop(acctbal) AS s FROM sides WHERE split = 'train')
SELECT entity_id, (acctbal - a) / s AS acctbal FROM sides, m""", SPLIT, "acctbal")
def standard_scaled(t):
    rows = sides(t)
    return prep.scale(rows.select("entity_id", "acctbal"), prep.learn_scaling(rows.where("split = 'train'"), ["acctbal"]))


@query("one_hot", "M4", """
SELECT entity_id, CASE segment WHEN 'AUTOMOBILE' THEN 1 ELSE 0 END AS a, CASE segment WHEN 'BUILDING' THEN 1 ELSE 0 END AS b,
       CASE segment WHEN 'FURNITURE' THEN 1 ELSE 0 END AS f FROM sides""", SPLIT)
def one_hot(t):
    # two segments are unseen in training and must come out as all zeros
    train = t.static.where(F.col("segment").isin("AUTOMOBILE", "BUILDING", "FURNITURE"))
    coded = prep.one_hot(["segment"]).fit(train).transform(t.static)
    v = vector_to_array("segment_onehot")
    return coded.select("entity_id", *[v[i].cast("int").alias(n) for i, n in enumerate("abf")])


@query("dummy_columns", "M5", """
SELECT entity_id, CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS "segment_BUILDING", CASE WHEN segment = 'FURNITURE' THEN 1 ELSE 0 END AS "segment_FURNITURE",
       CASE WHEN segment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS "segment_HOUSEHOLD", CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 0 END AS "segment_MACHINERY"
FROM static""", STATIC)
def dummy_columns(t):
    rows = t.static.select("entity_id", "segment")
    return prep.dummies(rows, prep.levels_of(rows, ["segment"]))


@query("ordinal_encoded", "M6", """
, l AS (SELECT nation, CAST(dense_rank() OVER (ORDER BY nation) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT nation FROM sides WHERE split = 'train' AND region <> 'ASIA') AS d)
SELECT entity_id, coalesce(code, -1) AS nation FROM sides s LEFT JOIN l ON l.nation = s.nation""", SPLIT)
def ordinal_encoded(t):
    rows = sides(t)
    codes = prep.level_codes(rows.where("split = 'train' and region <> 'ASIA'"), ["nation"])
    return prep.ordinal_encode(rows.select("entity_id", "nation"), codes, ["nation"])


@query("ordinal_encoded_mode", "M6", """
, tr AS (SELECT nation FROM sides WHERE split = 'train' AND region <> 'ASIA'),
l AS (SELECT nation, CAST(dense_rank() OVER (ORDER BY nation) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT nation FROM tr) AS d),
m AS (SELECT code AS mode FROM l WHERE nation = (SELECT nation FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
SELECT entity_id, coalesce(code, mode) AS nation FROM sides s LEFT JOIN l ON l.nation = s.nation, m""", SPLIT)
def ordinal_encoded_mode(t):
    rows = sides(t)
    train = rows.where("split = 'train' and region <> 'ASIA'")
    codes = prep.level_codes(train, ["nation"])
    modes = prep.learn_modes(train, ["nation"])
    return prep.ordinal_encode(rows.select("entity_id", "nation"), codes, ["nation"], "mode", modes)


@query("part_name_codes", "M6 W2", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders""")
def part_name_codes(t):
    codes = prep.level_codes(t.orders, ["o_orderpriority"])
    coded = prep.ordinal_encode(t.orders.select("o_orderkey", "o_orderpriority"), codes, ["o_orderpriority"])
    return coded.withColumnRenamed("o_orderpriority", "code")


@query("prepared_features", "M7", """
, tr AS (SELECT * FROM sides WHERE split = 'train'),
md AS (SELECT median(acctbal) AS a, median(age) AS g FROM tr),
mode AS (SELECT CAST(crs AS VARCHAR) AS v FROM tr WHERE crs IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
sc AS (SELECT avg(coalesce(acctbal, a)) AS ma, stddev_pop(coalesce(acctbal, a)) AS sa,
              avg(coalesce(CAST(age AS DOUBLE), g)) AS mg, stddev_pop(coalesce(CAST(age AS DOUBLE), g)) AS sg FROM tr, md)
SELECT entity_id, split, (coalesce(acctbal, a) - ma) / sa AS acctbal, (coalesce(CAST(age AS DOUBLE), g) - mg) / sg AS age,
       CASE segment WHEN 'AUTOMOBILE' THEN 1 ELSE 0 END AS automobile, CASE segment WHEN 'MACHINERY' THEN 1 ELSE 0 END AS machinery,
       CASE WHEN coalesce(CAST(crs AS VARCHAR), v) = '0' THEN 1 ELSE 0 END AS crs_0, CASE WHEN coalesce(CAST(crs AS VARCHAR), v) = '5' THEN 1 ELSE 0 END AS crs_5
FROM sides, md, mode, sc""", SPLIT, "acctbal age")
def prepared_features(t):
    rows = sides(t)
    ready = prep.Preprocessor(["acctbal", "age"], ["segment", "crs"]).fit(rows.where("split = 'train'"))
    v = vector_to_array("features")
    # two numbers, five segments and six grades, in order
    named = {"acctbal": v[0], "age": v[1]} | {
        n: v[i].cast("int") for n, i in (("automobile", 2), ("machinery", 6), ("crs_0", 7), ("crs_5", 12))
    }
    return ready.transform(rows).select("entity_id", "split", *[c.alias(n) for n, c in named.items()])


@query("smote_counts", "M8", """
SELECT CAST(count(*) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 0) AS BIGINT) AS n_new, CAST(0 AS BIGINT) AS n_outside FROM folds""", FOLDS)
def smote_counts(t):
    rows = t.members.join(t.documents.select(F.col("doc_id").alias("id"), "n_chars", F.length("text").alias("size")), "id")
    minority = rows.withColumn("rare", 1 - F.col("y"))
    made = prep.smote(minority, "id", "rare", ["n_chars", "size"])
    ends = minority.where("rare = 1").agg(F.min("n_chars"), F.max("n_chars")).first()
    return made.agg(
        F.count(F.lit(1)).alias("n_new"), F.count_if(~F.col("n_chars").between(ends[0], ends[1])).alias("n_outside")
    )


@query("nearest_minority", "M8", """
, m AS (SELECT id, n_chars::DOUBLE AS a, length(text)::DOUBLE AS b, length(text) - length(replace(text, ' ', '')) AS c
        FROM folds JOIN documents ON id = doc_id WHERE y = 0),
d AS (SELECT p.id, q.id AS neighbour, pow(p.a - q.a, 2) + pow(p.b - q.b, 2) + pow(p.c - q.c, 2) AS square FROM m p JOIN m q ON p.id <> q.id)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY square, neighbour) AS INTEGER) AS rank, neighbour, square FROM d
QUALIFY row_number() OVER (PARTITION BY id ORDER BY square, neighbour) <= 5""", FOLDS, "square")
def nearest_minority(t):
    """The neighbours that synthetic rows are drawn towards: ids, not counts."""
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    docs = t.documents.select(F.col("doc_id").alias("id"), F.array("n_chars", F.length("text").cast("long"), blanks.cast("long")).alias("x"))
    rare = t.members.where("y = 0").join(docs, "id").select("id", F.transform("x", lambda v: v.cast("double")).alias("x"))
    return neighbours.nearest(rare, 5).select("id", "rank", "neighbour", "square")
