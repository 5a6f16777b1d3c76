"""Feature preparation learned on training rows and applied to any rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.operators import neighbours, wide
from daygrid.operators.columns import constant_flags, q
from daygrid.operators.profile import melted
from daygrid.operators.running import dense_numbers, exact_quantiles
from daygrid.operators.splits import hashes_at, members_of, shuffle_key
from daygrid.session import bounded, durable


def learn_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians, one number per column; 0 where a column has no value at all."""
    long = melted(train, columns, "double")
    rows = exact_quantiles(long, ["variable"], "value", {"median": 0.5}).collect()
    found = {r["variable"]: r["median"] for r in rows}
    return {c: float(found.get(c) or 0.0) for c in columns}


def impute(df: DataFrame, values: Mapping[str, float | str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(q(c)), F.lit(v)) for c, v in values.items()})


def learn_modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest of equals."""
    counts = melted(train, columns, "string").where(F.col("value").isNotNull()).groupBy(
        "variable", "value"
    ).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("variable").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")
    )
    return {r["variable"]: r["mode"] for r in best.collect()}


@dataclass(frozen=True)
class Scaling:
    means: dict[str, float]
    sds: dict[str, float]


def learn_scaling(train: DataFrame, columns: Sequence[str]) -> Scaling:
    """Means and population deviations; a zero deviation scales by 1."""
    found = {r["column"]: r for r in wide.moments(train, list(columns)).collect()}
    return Scaling({c: found[c]["mean"] if c in found else 0.0 for c in columns}, {c: (found[c]["sd_pop"] if c in found else 0.0) or 1.0 for c in columns})


def scale(df: DataFrame, scaling: Scaling) -> DataFrame:
    return df.withColumns({c: (F.col(q(c)) - m) / scaling.sds[c] for c, m in scaling.means.items()})


def levels_of(train: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    """Sorted levels per column; refuses columns with more levels than a table can be wide."""
    pairs = melted(train, columns, "string").where(F.col("value").isNotNull()).distinct()
    rows = pairs.limit(limit * len(columns) + 1).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["variable"]].append(r["value"])
    wide = [c for c, v in out.items() if len(v) > limit]
    if wide or len(rows) > limit * len(columns):
        raise ValueError(f"more than {limit} levels in {wide or columns}")
    return {c: sorted(v, key=str.encode) for c, v in out.items()}


def dummies(df: DataFrame, levels: Mapping[str, Sequence[str]], drop_first: bool = True) -> DataFrame:
    """0/1 columns ``<column>_<level>``; the first level is dropped."""
    new: dict[str, Column] = {}
    for c, values in levels.items():
        for v in values[1 if drop_first else 0:]:
            new[f"{c}_{v}"] = F.coalesce((F.col(q(c)).cast("string") == v).cast("int"), F.lit(0))
    return df.withColumns(new).drop(*levels)


class OneHot:
    """One-hot vectors ``<column>_onehot`` over the levels of the train rows, in text order.

    The level dictionary is a stored table that meets the rows by join, so a column may have
    any number of levels: the driver sees their number alone. Unseen and null values become
    all-zero vectors.
    """

    def __init__(self, columns: Sequence[str]) -> None:
        self.columns = list(columns)
        self.codes: DataFrame | None = None
        self.sizes: dict[str, int] = {}
        self.encoder = None

    def fit(self, train: DataFrame) -> OneHot:
        self.codes = durable(level_codes(train, self.columns), "levels")
        found = {r["variable"]: r["n"] for r in self.codes.groupBy("variable").agg(F.count("*").alias("n")).collect()}
        self.sizes = {c: found.get(c, 0) for c in self.columns}
        # the index behind the last level, which stands for every other value, is the one left out
        widest = train.sparkSession.createDataFrame([tuple(float(self.sizes[c]) for c in self.columns)], [f"{c}_index" for c in self.columns])
        self.encoder = OneHotEncoder(inputCols=[f"{c}_index" for c in self.columns], outputCols=[f"{c}_onehot" for c in self.columns],
                                     dropLast=True).fit(widest)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, c in enumerate(self.columns):
            side = bounded(self.codes.where(F.col("variable") == c).select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}")))
            out = out.join(side, F.col(q(c)).cast("string") == F.col(f"_value{i}"), "left").withColumn(
                f"{c}_index", F.coalesce(F.col(f"_code{i}").cast("double"), F.lit(float(self.sizes[c])))).drop(f"_value{i}", f"_code{i}")
        return self.encoder.transform(out)


def one_hot(columns: Sequence[str]) -> OneHot:
    return OneHot(columns)


def level_codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value, code): levels in text order numbered from 0."""
    long = melted(train, columns, "string").where(F.col("value").isNotNull())
    numbered = dense_numbers(long, "value", "code", by=["variable"], text=True)
    return numbered.withColumn("code", (F.col("code") - 1).cast("int"))


def ordinal_encode(
    df: DataFrame, codes: DataFrame, columns: Sequence[str], unseen: str = "minus_one",
    modes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Replace levels by their codes; unseen ones by -1 or by the code of the train mode."""
    table = bounded(codes)
    out = df
    for c in columns:
        side = table.where(F.col("variable") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        joined = out.join(side, F.col(q(c)).cast("string") == F.col("_value"), "left")
        if unseen == "mode":
            fallback = codes.where((F.col("variable") == c) & (F.col("value") == (modes or {})[c]))
            miss = F.lit(fallback.first()["code"])
        else:
            miss = F.lit(-1)
        out = joined.withColumn(c, F.coalesce("_code", miss)).drop("_value", "_code")
    return out


class ColumnTransformer:
    """Scaled numerics beside one-hot categories in one vector, fitted on train only.

    Numerics are expected to be imputed with ``learn_medians`` and scaled with
    ``learn_scaling`` of the same train rows.
    """

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], output: str = "features") -> None:
        self.hot = OneHot(categorical) if categorical else None
        self.assembler = VectorAssembler(inputCols=[*numeric, *[f"{c}_onehot" for c in categorical]], outputCol=output)

    def fit(self, train: DataFrame) -> ColumnTransformer:
        if self.hot:
            self.hot.fit(train)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.assembler.transform(self.hot.transform(df) if self.hot else df)


def column_transformer(numeric: Sequence[str], categorical: Sequence[str], output: str = "features") -> ColumnTransformer:
    return ColumnTransformer(numeric, categorical, output)


@dataclass
class Preprocessor:
    """Constant dropping, imputation, scaling and encoding learned from train rows."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    medians: dict[str, float] | None = None
    modes: dict[str, str] | None = None
    scaling: Scaling | None = None
    model: object = None

    def fit(self, train: DataFrame) -> Preprocessor:
        flat = {r["column"] for r in constant_flags(train, [*self.numeric, *self.categorical]).where("is_constant").collect()}
        self.numeric = [c for c in self.numeric if c not in flat]
        self.categorical = [c for c in self.categorical if c not in flat]
        self.medians = learn_medians(train, self.numeric)
        self.modes = learn_modes(train, self.categorical) if self.categorical else {}
        filled = self._fill(train)
        self.scaling = learn_scaling(filled, self.numeric)
        self.model = column_transformer(self.numeric, self.categorical).fit(scale(filled, self.scaling))
        return self

    def _fill(self, df: DataFrame) -> DataFrame:
        text = df.withColumns({c: F.col(q(c)).cast("string") for c in self.categorical})
        return impute(impute(text, self.medians), self.modes)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(scale(self._fill(df), self.scaling))


def smote(
    df: DataFrame, entity: str, label: str, features: Sequence[str], k: int = 5, seed: int = 42,
) -> DataFrame:
    """Synthetic minority rows (label 1) until both classes are equal in number.

    Each is a random point on the line from a minority row to one of its k nearest
    neighbours in the minority, found exactly (``neighbours.nearest``). Rows that miss a
    feature serve neither way. Every other minority row serves equally often; the remainder goes to the rows first in seeded hash order. A
    synthetic row is no entity: its entity is null, and ``source`` names the row it began from.
    """
    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    kind = df.schema[entity].dataType
    minority = durable(df.where(F.col(label) == 1).select(
        F.col(entity).alias("id"), F.array(*[F.col(q(c)).cast("double") for c in features]).alias("x")
    ), "minority")
    minority = minority.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c)))
    new, have = counts["n"] - counts["p"], minority.count()
    if have < 2 or new <= 0:
        return df.select(F.lit(None).cast(kind).alias(entity), label, *features, F.col(entity).alias("source")).limit(0)
    near = neighbours.nearest(minority, k).groupBy("id", "x").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "y"))), lambda e: e["y"]).alias("near"))
    each, extra = divmod(new, have)
    times = F.lit(each)
    if extra:
        rank = df.sparkSession.range(1).select(F.lit("all").alias("stratum"), F.lit(extra).alias("rank"))
        limit = hashes_at(members_of(minority, "id", None, seed), rank).first()["hash"]
        times = times + (shuffle_key("id", seed) <= limit).cast("int")
    serving = near.withColumn("_times", times).where("_times > 0 and size(near) > 0")
    copies = serving.withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_times"))))

    def uniform(tag: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(f"{tag}{seed}"), "id", "_s"), F.lit(2**31)) / float(2**31)

    pick = F.floor(uniform("n") * F.size("near")).cast("int")
    mixed = F.zip_with("x", F.col("near")[pick], lambda a, b: a + (b - a) * uniform("g"))
    points = copies.select(F.lit(None).cast(kind).alias(entity), F.lit(1).alias(label), mixed.alias("_x"), F.col("id").alias("source"))
    return points.select(entity, label, *[F.col("_x")[i].alias(c) for i, c in enumerate(features)], "source")
