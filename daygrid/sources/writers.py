"""Writers; every sink is written by the tasks in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.operators.cohort import partition_series
from daygrid.session import spread


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """CSV with header and empty nulls, or Parquet; folders are made as needed."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)
    else:
        writer.format(fmt).save(path)


def write_partitioned(
    static: DataFrame, series: DataFrame, path: str, group: str, known: Sequence[str],
    entity: str = "entity_id", fmt: str = "parquet",
) -> None:
    """One folder per group for the static rows and for the series of their entities.

    Rows are hashed by group and entity (and day), so a large group or a heavy entity
    is written by many tasks. Groups outside ``known`` are left out here and counted
    by the integrity check.
    """
    kept = static.where(F.col(group).isin(list(known)))
    placed = kept.repartition(group, entity)
    days = partition_series(kept, series, group, entity).repartition(group, entity, "day")
    for name, df in (("static", placed), ("series", days)):
        writer = df.write.mode("overwrite").partitionBy(group)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{path}/{name}")


def write_series_files(wide: DataFrame, path: str, entity: str = "entity_id") -> None:
    """One ``entity_id=<id>`` folder of CSV per entity, days in order within a file.

    Making a file costs more than its rows, so the entities are spread over all tasks, and
    each task moves its own files into place; the driver would move them one by one.
    """
    rows = spread(wide, entity).sortWithinPartitions(entity, "day")
    moved = rows.write.mode("overwrite").partitionBy(entity).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    moved.option("header", True).option("nullValue", "NA").csv(path)


def write_split(split: DataFrame, metadata: DataFrame, path: str) -> None:
    """Rows partitioned by ``split`` and one metadata row as JSON."""
    split.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_folds(folds: DataFrame, path: str) -> None:
    """(entity, fold): each fold's validation ids; its train ids are the other folds."""
    folds.write.mode("overwrite").partitionBy("fold").parquet(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per report table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_predictions(
    scored: DataFrame, path: str, entity: str = "entity_id", threshold: float = 0.5, fmt: str = "csv"
) -> DataFrame:
    """(id, label, probability, prediction); returns what was written."""
    out = scored.select(
        entity, F.col("y").alias("label"), F.col("score").alias("probability"),
        (F.col("score") >= threshold).cast("int").alias("prediction"),
    )
    write_table(out, path, fmt)
    return out
