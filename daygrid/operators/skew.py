"""Lookups whose rows may share a few hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, side: DataFrame, keys: Sequence[str], hot: Column, how: str = "inner") -> DataFrame:
    """Join (``inner`` or ``left``) of ``rows`` with ``side``, which holds every key once.

    ``hot`` marks the keys of ``side`` that many rows share. The caller proves that few
    are hot (each holds at least a fixed share of all rows), so these are broadcast; the
    other keys meet their rows by shuffle, and no task gets more than that share. Both
    frames are read twice and should be stored tables. Null keys meet nothing. The joins
    keep one copy of the keys.
    """
    few, rest = side.where(hot), side.where(~hot)
    ids = F.broadcast(few.select(*keys))
    return rows.join(F.broadcast(few), list(keys)).unionByName(rows.join(ids, list(keys), "left_anti").join(rest, list(keys), how))
