"""Registered queries: a name, the Spark callable and, where SQL can state it, the oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.plans.bindings import Tables


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, so that summation order does not show.

    The nudge moves exact decimals off the rounding tie, where the last bit decides.
    """
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    fixed = {c: F.round(F.col(f"`{c}`") + F.lit(2e-10), digits) + F.lit(0.0) for c in doubles}
    return df.withColumns(fixed) if fixed else df


def query(name: str, covers: str, sql: str | None = None, with_: str = "", doubles: Sequence[str] | str = ()):
    """Register a query. ``with_`` are the binding CTEs, ``doubles`` the columns the
    oracle rounds like ``rounded`` does."""
    names = doubles.split() if isinstance(doubles, str) else list(doubles)
    text = None
    if sql is not None:
        # binding CTEs come first; a query's own CTEs follow with a leading comma
        body = sql.strip()
        inner = f"WITH {with_.strip()}{'' if body.startswith(',') else ' '}{body}" if with_ else body
        if names:
            nudge, zero = "CAST(2e-10 AS DOUBLE)", "CAST(0 AS DOUBLE)"
            fixed = [f'round(CAST("{c}" AS DOUBLE) + {nudge}, 6) + {zero} AS "{c}"' for c in names]
            text = f"SELECT * REPLACE ({', '.join(fixed)}) FROM ({inner}) AS answer"
        else:
            text = inner

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Entry(fn, tuple(covers.split()), text)
        return fn

    return keep


def run_query(name: str, spark, folder: str) -> DataFrame:
    return rounded(REGISTRY[name].run(Tables(spark, folder)))
