"""Entity-level work on a static table and its series: partition, re-key, lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.operators.running import dense_numbers


def first_label(rows: DataFrame, entity: str, label: str, order: str) -> DataFrame:
    """Label of the entity's first row in the given order (a partial aggregate)."""
    return rows.groupBy(entity).agg(F.min_by(label, order).alias(label))


def id_map(static: DataFrame, entity: str = "entity_id", text: bool = False) -> DataFrame:
    """(old_id, new_id): sorted distinct ids numbered 1…n."""
    return dense_numbers(static, entity, "new_id", text=text).withColumnRenamed(entity, "old_id")


def rekey(df: DataFrame, mapping: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Replace ids through the map; rows of unmapped entities are left out.

    Hot entities sit on the data side only, where adaptive execution splits them.
    """
    joined = df.join(mapping, df[entity] == mapping["old_id"], "inner")
    return joined.withColumn(entity, F.col("new_id")).drop("old_id", "new_id")


def left_features(static: DataFrame, features: DataFrame, entity: str = "entity_id") -> DataFrame:
    return static.join(features, entity, "left")


def with_both(static: DataFrame, features: DataFrame, entity: str = "entity_id") -> DataFrame:
    return static.join(features, entity, "inner")


def only(rows: DataFrame, ids: DataFrame, entity: str = "entity_id") -> DataFrame:
    return rows.join(ids.select(entity), entity, "left_semi")


def excluding(rows: DataFrame, ids: DataFrame, entity: str = "entity_id") -> DataFrame:
    return rows.join(ids.select(entity), entity, "left_anti")


def without_series(static: DataFrame, series: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities that have no series rows."""
    return static.join(series.select(entity).distinct(), entity, "left_anti")


def partition_series(
    static: DataFrame, series: DataFrame, group: str, entity: str = "entity_id"
) -> DataFrame:
    """Series rows with their entity's group; entities outside the table are left out."""
    return series.join(static.select(entity, group), entity, "inner")


def features_union(frames: Sequence[tuple[str, DataFrame]], top: int) -> DataFrame:
    """Union of each model's top features, one column per model, 0 where absent.

    Every frame holds (feature, importance): as many rows as there are features.
    """
    named = [df.select("feature", "importance").withColumn("model", F.lit(m)) for m, df in frames]
    everything = named[0]
    for df in named[1:]:
        everything = everything.unionByName(df)
    best = None
    for df in named:
        head = df.orderBy(F.desc("importance"), "feature").limit(top).select("feature")
        best = head if best is None else best.unionByName(head)
    models = [m for m, _ in frames]
    wide = (
        everything.join(best.distinct(), "feature", "left_semi")
        .groupBy("feature").pivot("model", models).agg(F.first("importance")).fillna(0.0, models)
    )
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    return wide.withColumn("mean_importance", mean)
