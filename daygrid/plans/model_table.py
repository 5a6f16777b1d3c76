"""From a static table and series to a labelled, split and folded model table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from daygrid.functions.labels import binarize
from daygrid.operators import columns as C
from daygrid.operators import series as S
from daygrid.operators import splits
from daygrid.session import durable


def model_table(
    static: DataFrame, series: DataFrame, channels: Sequence[str], label: str,
    required: Sequence[str] = (), threshold: float = 2, test_share: float = 0.2, k: int = 5,
    max_missing_pct: float | None = 20.0, entity: str = "entity_id", seed: int = 42,
) -> DataFrame:
    """One row per entity: static columns, baseline observations, ``label`` as 0/1,
    ``split`` and, within the training rows, ``fold``.

    Entities without a label or a required value are left out before anything is
    learned. The joined table is stored once, since filters and splits read it.
    """
    kept, _ = C.require_not_null(static, [*required, label])
    joined = kept.join(S.baseline(series, channels), entity, "left")
    table = durable(binarize(joined, {label: threshold}), "model_table")
    if max_missing_pct is not None:
        table = C.filter_by_missing(table, max_missing_pct).df
    split = splits.stratified_split(table, entity, label, test_share, seed)
    train = split.where("split = 'train'")
    folds = splits.stratified_folds(train.select(entity, label), entity, label, k, seed).select(entity, "fold")
    return split.join(folds, entity, "left")
