"""p-values for aggregated test statistics, as column expressions.

Upper tails are ratios of two integrals of the same unnormalised density: the tail's, and
the whole line's from its peak. Each runs outwards over a half-line, where the density only
falls, by double exponential quadrature over a fixed number of points. So no gamma or beta
function is needed, and very many degrees of freedom cost and err no more than few. Null and
undefined statistics have a null p-value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points on either side of the middle, and the step between them (abscissas -4 to 4).
POINTS, STEP = 128, 1 / 32
#: Equally likely tables may differ by rounding; places beyond REACH deviations and SPARE
#: steps from the mode have no probability that a double can hold.
TIE, REACH, SPARE = 1e-7, 40.0, 800


def _defined(x: str | Column) -> Column:
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(value), value)


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of the values, each computed once and not at every point of a sum."""
    held = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.transform(F.array(held), body)[0]


def _bounded(p: Column) -> Column:
    """Rounding may pass 0 and 1; null stays null."""
    return F.when(p > 1, 1.0).when(p < 0, 0.0).otherwise(p)


def _outwards(log_density: Callable[[Column], Column], start: Column, width: Column, sign: int = 1) -> Column:
    """Integral of exp(log_density) from ``start`` to infinity (to minus infinity for sign
    -1); ``width`` is the scale on which the density falls there."""

    def point(total: Column, i: Column) -> Column:
        x = i * F.lit(STEP)
        away = F.exp(F.lit(math.pi / 2) * F.sinh(x))
        weight = F.lit(STEP * math.pi / 2) * F.cosh(x) * away
        return total + weight * F.exp(log_density(start + sign * width * away))

    return width * F.aggregate(F.sequence(F.lit(-POINTS), F.lit(POINTS)), F.lit(0.0), point)


def normal_p(z: str | Column) -> Column:
    """Two-sided normal p-value."""
    tail = lambda x: _outwards(lambda v: -v * v / 2, x["u"], 1 / F.greatest(x["u"], F.lit(1.0)))
    return _bounded(_let(tail, u=F.abs(_defined(z))) / math.sqrt(math.pi / 2))


def t_p(t: str | Column, df: str | Column) -> Column:
    """Two-sided p-value of Student's t; the degrees of freedom need not be whole."""
    nu = _defined(df)

    def share(x: Column) -> Column:
        log_density = lambda v: -(x["nu"] + 1) / 2 * F.log1p(v * v / x["nu"])
        return _outwards(log_density, x["u"], x["width"]) / _outwards(log_density, F.lit(0.0), F.lit(1.0))

    far = F.greatest(F.abs(_defined(t)), F.lit(1.0))
    known = F.when(nu > 0, nu)
    return _bounded(_let(share, u=F.abs(_defined(t)), nu=known, width=(known / far + far) / (known + 1)))


def chi2_p(x: str | Column, df: str | Column) -> Column:
    """Upper tail of chi-square; 1 without degrees of freedom.

    In v = ln(x / df) the density is that of a (v - e**v), a = df / 2, with its peak at 0.
    """
    value, k = _defined(x), _defined(df)
    half = F.when(k > 0, k / 2)
    begin = F.ln(F.when(value > 0, value / F.when(k > 0, k)))

    def upper(y: Column) -> Column:
        log_density = lambda v: y["a"] * (v - F.expm1(v))
        whole = _outwards(log_density, F.lit(0.0), y["peak"]) + _outwards(log_density, F.lit(0.0), y["peak"], -1)
        return F.when(y["begin"] > 0, _outwards(log_density, y["begin"], y["width"]) / whole).otherwise(
            1 - _outwards(log_density, y["begin"], y["width"], -1) / whole)

    width = 1 / F.greatest(half * F.abs(F.expm1(begin)), F.sqrt(half))
    found = _let(upper, a=half, begin=begin, width=width, peak=F.sqrt(1 / half))
    return F.when((k <= 0) | (value <= 0), F.when(value.isNotNull(), 1.0)).otherwise(_bounded(found))


def fisher_p(a: str | Column, b: str | Column, c: str | Column, d: str | Column) -> Column:
    """Two-sided exact p-value of a 2x2 table: the share of the tables with its margins that
    are no likelier than it.

    Probabilities are taken relative to the likeliest table and walked from it by their
    ratios, some standard deviations to either side.
    """
    a, b, c, d = ((F.col(x) if isinstance(x, str) else x).cast("long") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    r, s, size = row.cast("double"), col.cast("double"), F.greatest(n, F.lit(2)).cast("double")
    lo, hi = F.greatest(F.lit(0), row + col - n), F.least(row, col)
    mode = F.least(hi, F.greatest(lo, F.floor((r + 1) * (s + 1) / (n + 2))))
    spread = F.sqrt(r / size * s / size * (n - row) * (n - col) / (size - 1))
    one = F.lit(1).cast("long")

    def up(x: Column, k: Column) -> Column:
        return (x["s"] - k) * (x["r"] - k) / ((k + 1) * (x["rest"] + k + 1))

    def down(x: Column, k: Column) -> Column:
        return k * (x["rest"] + k) / ((x["s"] - k + 1) * (x["r"] - k + 1))

    def walk(x: Column, limit: Column, end: Column, step: Column, ratio: Callable[[Column, Column], Column]) -> Column:
        def add(w: Column, k: Column) -> Column:
            return _let(lambda y: F.struct(y["term"].alias("term"), (w["total"] + y["term"]).alias("total"),
                                           (w["tail"] + F.when(y["term"] <= limit, y["term"]).otherwise(0.0)).alias("tail")),
                        term=w["term"] * ratio(x, k))

        start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"), F.lit(0.0).alias("tail"))
        return F.aggregate(F.sequence(x["mode"], end, step), start, add)

    def tails(x: Column, limit: Column) -> Column:
        right = walk(x, limit, F.least(x["hi"], x["mode"] + x["reach"]), one, up)
        left = walk(x, limit, F.greatest(x["lo"], x["mode"] - x["reach"]), -one, down)
        top = F.when(limit >= 1, 1.0).otherwise(0.0)
        return _let(lambda y: (y["right"]["tail"] + y["left"]["tail"] + top) / (y["right"]["total"] + y["left"]["total"] + 1),
                    right=right, left=left)

    def share(x: Column) -> Column:
        climbed = F.aggregate(F.sequence(F.least(x["a"], x["mode"]), F.greatest(x["a"], x["mode"]) - 1, one), F.lit(0.0),
                              lambda t, k: t + F.ln(up(x, k)))
        seen = F.when(x["a"] == x["mode"], 0.0).when(x["a"] < x["mode"], -climbed).otherwise(climbed)
        return F.when(F.abs(x["a"] - x["mode"]) > x["reach"], 0.0).otherwise(
            _let(lambda y: tails(x, y["limit"]), limit=F.exp(seen) * (1 + TIE)))

    found = _let(share, a=a, r=r, s=s, rest=(n - row - col).cast("double"), lo=lo, hi=hi, mode=mode,
                 reach=F.ceil(REACH * spread + SPARE))
    return F.when(n.isNotNull(), _bounded(found))
