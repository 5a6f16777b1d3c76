"""Leakage-free train/test splits and folds over entities.

Members are ordered by ``md5(seed-id)``, which does not depend on row order or
partitioning. A split is decided by comparing that hash with an exact threshold
per stratum: the hash of the member at the wanted rank. Thresholds come from
counts per (stratum, hash prefix) and a ranking inside the one prefix that holds
the cut, so entities are never sorted as a whole. The thresholds (a few rows per
stratum) are fetched like the result of a fit, and the assignment is a projection
behind a broadcast of them; with too many strata for that, it is a plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.session import bounded, durable

PREFIX = 4  # hex digits: 65,536 evenly filled buckets


def shuffle_key(entity: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(entity).cast("string")))


def _stratum(label: str | None) -> Column:
    """A name per label; null has one of its own, which no text can take."""
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")) if label else F.lit("all")


def members_of(entities: DataFrame, entity: str, label: str | None, seed: int) -> DataFrame:
    return entities.select(_stratum(label).alias("stratum"), shuffle_key(entity, seed).alias("hash"))


def hashes_at(members: DataFrame, ranks: DataFrame) -> DataFrame:
    """The hash of the member at each wanted rank of its stratum.

    ``members`` holds (stratum, hash); ``ranks`` holds (stratum, rank) and whatever
    names the cut.
    """
    prefix = F.substring("hash", 1, PREFIX)
    counts = members.groupBy("stratum", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    earlier = (
        Window.partitionBy("stratum").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    holding = bounded(
        placed.join(ranks, "stratum").where(
            (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n"))
        ).withColumn("place", F.col("rank") - F.col("before")).drop("n", "before", "rank")
    )
    near = members.withColumn("prefix", prefix).join(
        holding.select("stratum", "prefix").distinct(), ["stratum", "prefix"], "left_semi"
    )
    inside = Window.partitionBy("stratum", "prefix").orderBy("hash")
    ranked = near.withColumn("place", F.row_number().over(inside))
    return ranked.join(holding, ["stratum", "prefix", "place"]).drop("prefix", "place")


def shuffled(entities: DataFrame, entity: str, seed: int = 42) -> DataFrame:
    """Seeded permutation: sort by ``shuffle_key`` for the order."""
    return entities.withColumn("shuffle_key", shuffle_key(entity, seed))


def assign(
    entities: DataFrame, entity: str, label: str | None = None, test_share: float | None = None,
    k: int | None = None, seed: int = 42,
) -> DataFrame:
    """Adds ``split`` (when a test share is given) and ``fold`` 1…k (when k is given).

    The first round(n · share) members of each label are test. Folds cut each label's
    members into k near-equal runs, longer ones first. ``entities`` holds one row per
    entity; null labels form a stratum of their own.
    """
    members = members_of(entities, entity, label, seed)
    n = F.col("n")
    wanted = []
    if test_share is not None:
        share = F.round(n * F.lit(test_share)).cast("long")
        wanted.append(F.struct(F.lit("split").alias("kind"), share.alias("rank")))
    for i in range(1, k or 0):
        # runs of an uneven division: the first n % k are one longer
        upto = F.floor(n / k) * i + F.least(F.lit(i).cast("long"), n % k)
        wanted.append(F.struct(F.lit("fold").alias("kind"), upto.cast("long").alias("rank")))
    if not wanted:
        return entities.withColumn("fold", F.lit(1)) if k else entities
    sizes = members.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    ranks = sizes.select("stratum", F.inline(F.array(*wanted))).where("rank > 0")

    def cuts(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("hash"))))

    # a few hashes per stratum; ranks repeated by empty runs repeat their hash
    limits = bounded(
        hashes_at(members, ranks).groupBy("stratum").agg(cuts("split").alias("_split"), cuts("fold").alias("_fold"))
    ).withColumnRenamed("stratum", "_stratum")
    tagged = entities.withColumns({"_stratum": _stratum(label), "_hash": shuffle_key(entity, seed)})
    out = tagged.join(limits, "_stratum", "left")
    own = F.col("_hash")
    if test_share is not None:
        is_test = F.coalesce(own <= F.try_element_at("_split", F.lit(1)), F.lit(False))
        out = out.withColumn("split", F.when(is_test, "test").otherwise("train"))
    if k:
        below = F.size(F.filter(F.coalesce("_fold", F.array().cast("array<string>")), lambda c: c < own))
        out = out.withColumn("fold", (below + 1).cast("int"))
    return out.drop("_stratum", "_hash", "_split", "_fold")


def stratified_split(
    entities: DataFrame, entity: str, label: str | None, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``split``: each label keeps its share in test and in train."""
    return assign(entities, entity, label, test_share=test_share, seed=seed)


def stratified_folds(
    entities: DataFrame, entity: str, label: str | None, k: int = 5, seed: int = 42
) -> DataFrame:
    """Adds ``fold`` 1…k with each label spread evenly."""
    return assign(entities, entity, label, k=k, seed=seed)


def group_folds(rows: DataFrame, entity: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds by entity alone, ``(entity, fold)``.

    The entities are stored once: thresholds and assignment each read them.
    """
    return stratified_folds(durable(rows.select(entity).distinct(), "entities"), entity, None, k, seed)


def folds_for_rows(rows: DataFrame, entity: str, label: str, order: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified entity folds carried to all rows of each entity."""
    from daygrid.operators.cohort import first_label

    entities = durable(first_label(rows, entity, label, order), "entities")
    folds = stratified_folds(entities, entity, label, k, seed).select(entity, "fold")
    return rows.join(folds, entity)


def fold_roles(folds: DataFrame, entity: str, k: int) -> DataFrame:
    """(fold, role, id): every entity is validation in its fold and train in the others."""
    each = folds.withColumn("_f", F.explode(F.sequence(F.lit(1), F.lit(k))))
    role = F.when(F.col("_f") == F.col("fold"), "val").otherwise("train")
    return each.select(F.col("_f").alias("fold"), role.alias("role"), F.col(entity).alias("id"))


def split_metadata(split: DataFrame, label: str, seed: int, test_share: float) -> DataFrame:
    """One row describing a split, for writing next to it."""
    return split.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.count_if((F.col("split") == "train") & (F.col(label) == 1)).alias("n_train_pos"),
        F.count_if((F.col("split") == "test") & (F.col(label) == 1)).alias("n_test_pos"),
    ).withColumns({"seed": F.lit(seed), "test_share": F.lit(test_share)})
