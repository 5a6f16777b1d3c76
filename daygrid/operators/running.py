"""Running sums, ranks, previous rows and exact quantiles without one-task sorts.

``Window.orderBy`` without a partition (or with a hot partition key) sorts every
row in a single task. Here the ordered key is first cut into contiguous buckets;
rows are ordered only inside (group, bucket), and each bucket starts from the
totals of the buckets before it. The bucket totals are at most ``buckets`` rows
per group. Cut points only balance the work: any cut points give the same result.

Rows whose group or key is null take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.session import durable

BUCKET = "_bucket"
INF = float("inf")


#: Keys that are looked at for each bucket, and the length of a text boundary.
PER_BUCKET, BOUNDARY = 16, 64


def default_buckets(df: DataFrame) -> int:
    return max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sampled(df: DataFrame, key: str, n: int) -> list:
    """About PER_BUCKET keys per bucket, chosen by their hashes: a count and a filter,
    no sketch to merge. That is for balance only; the sums are exact for any cuts."""
    keys = df.select(F.col(key).alias("k")).where("k is not null")
    share = min(1.0, PER_BUCKET * n / max(1, keys.count()))
    chosen = keys.where(F.pmod(F.xxhash64("k"), F.lit(2**31)) <= int(share * 2**31))
    return [r["k"] for r in chosen.distinct().collect()]


def numeric_cuts(df: DataFrame, key: str, buckets: int | None = None) -> list[float]:
    """At most ``buckets`` - 1 cut points over the distinct keys of ``df``."""
    n = buckets or default_buckets(df)
    if n <= 1:
        return []
    values = sorted(_sampled(df.select(F.col(key).cast("double").alias("_c")).where("not isnan(_c)"), "_c", n))
    step = max(1, -(-len(values) // n))
    return values[step::step]


def numeric_bucket(df: DataFrame, key: str, cuts: list[float]) -> DataFrame:
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    keyed = df.withColumn("_bucket_key", F.col(key).cast("double"))
    split = Bucketizer(
        splits=[-INF, *cuts, INF], inputCol="_bucket_key", outputCol=BUCKET, handleInvalid="keep"
    )
    return split.transform(keyed).drop("_bucket_key").withColumn(BUCKET, F.col(BUCKET).cast("int"))


def text_cuts(df: DataFrame, key: str, buckets: int | None = None) -> list[str]:
    """The same for texts; a boundary is the beginning of a text."""
    n = buckets or default_buckets(df)
    values = sorted(set(_sampled(df.select(F.left(F.col(key), F.lit(BOUNDARY)).alias("_c")), "_c", n)), key=str.encode)
    step = max(1, -(-len(values) // n))
    return values[step::step]


def text_bucket(df: DataFrame, key: str, cuts: list[str]) -> DataFrame:
    """Bucket number (cuts up to the key, in byte order as Spark sorts) by binary search in
    one array of cuts: the plan is the same for any number of buckets."""
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    held = F.lit(cuts)
    strides = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
    # a place beyond the last cut is null, and not moved to
    found = F.aggregate(strides, F.lit(0), lambda at, n: F.when(F.get(held, at + n - 1) <= F.col(key), at + n).otherwise(at))
    return df.withColumn(BUCKET, found)


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that keeps one copy of the keys; size and skew are left to AQE."""
    renamed = side.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in keys])
    return df.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _group(by: Sequence[str]) -> list:
    return [F.col(c) for c in by] or [F.lit(0)]


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: dict[str, Column],
    descending: bool = False,
    text: bool = False,
    buckets: int | None = None,
    once: bool = False,
) -> DataFrame:
    """One row per distinct (group, key) with each sum ``x``, ``cum_x`` up to and
    including the key and ``total_x`` over the group. With ``once``, repeated rows
    of a key count a single time (the sums must not differ between them).

    Ties collapse to one row before anything is ordered, so a single heavy key
    costs nothing beyond the partial aggregate.
    """
    names = list(sums)
    source = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, order]]))
    combine = F.max if once else F.sum
    # stored once: the cut points are taken where the work will be, on the distinct keys
    keys = durable(source.groupBy(*by, order).agg(*[combine(e).alias(n) for n, e in sums.items()]), "keys")
    if text:
        bucketed = text_bucket(keys, order, text_cuts(keys, order, buckets))
    else:
        bucketed = numeric_bucket(keys, order, numeric_cuts(keys, order, buckets))
    direction = F.desc if descending else F.asc
    across = Window.partitionBy(*_group(by))
    earlier = across.orderBy(direction(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*by, BUCKET).agg(*[F.sum(c).alias(c) for c in names]).select(
        *by,
        BUCKET,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in names],
        *[F.sum(c).over(across).alias(f"total_{c}") for c in names],
    )
    inside = (
        Window.partitionBy(*by, BUCKET).orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = attach(bucketed, offsets, [*by, BUCKET])
    return joined.select(
        *by,
        order,
        *names,
        *[(F.sum(c).over(inside) + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in names],
        *[f"total_{c}" for c in names],
    )


def average_ranks(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Tie-averaged rank of every distinct key within its group."""
    run = running_sums(df, by, order, {"n": F.lit(1)})
    return run.withColumn("avg_rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0)


def dense_numbers(df: DataFrame, key: str, name: str = "number", by: Sequence[str] = (),
                  text: bool = False) -> DataFrame:
    """1…n over the sorted distinct keys (of each group)."""
    run = running_sums(df, by, key, {"n": F.lit(1).cast("long")}, text=text, once=True)
    return run.select(*by, key, F.col("cum_n").alias(name))


def quantile_picks(value: str, n: str, probs: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Over rows of ``running_sums`` with a count ``n``: the aggregates that find the values
    beside each quantile, and the interpolated quantiles of what they find."""
    first, last = F.col(f"cum_{n}") - F.col(n), F.col(f"cum_{n}") - 1
    picks, outs = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col(f"total_{n}") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((first <= lo) & (lo <= last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi <= last), F.col(value))).alias(f"_hi_{name}"),
            F.max(at - lo).alias(f"_w_{name}"),
        ]
        lo_v, hi_v, w = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
        outs.append((lo_v + (hi_v - lo_v) * w).alias(name))
    return picks, outs


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact for groups of any size.

    ``percentile`` keeps every distinct value of a group in one task; this walks
    the running counts instead.
    """
    run = running_sums(df, by, value, {"n": F.lit(1)})
    picks, outs = quantile_picks(value, "n", probs)
    grouped = run.groupBy(*by).agg(*picks) if by else run.agg(*picks)
    return grouped.select(*by, *outs)


def with_bucket(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """Add the bucket column once, for several windows over the same order."""
    return numeric_bucket(df, order, numeric_cuts(df, order, buckets))


def with_previous(
    df: DataFrame, by: Sequence[str], order: str, previous: dict[str, str]
) -> DataFrame:
    """Columns of the preceding row of the group, for groups of any size.

    (group, order) must be unique. ``previous`` maps a source column to the new
    one. A bucket's first row looks at the last row of the bucket before it. A
    bucket column already present is used and kept.
    """
    given = BUCKET in df.columns
    bucketed = df if given else with_bucket(df, order)
    row = F.struct(*previous)
    tails = bucketed.groupBy(*by, BUCKET).agg(F.max_by(row, F.col(order)).alias("_tail"))
    across = Window.partitionBy(*_group(by)).orderBy(BUCKET)
    carried = tails.select(*by, BUCKET, F.lag("_tail").over(across).alias("_carry"))
    inside = Window.partitionBy(*by, BUCKET).orderBy(order)
    joined = attach(bucketed, carried, [*by, BUCKET]).withColumn(
        "_prev", F.coalesce(F.lag(row).over(inside), F.col("_carry"))
    )
    for field, name in previous.items():
        joined = joined.withColumn(name, F.col(f"_prev.{field}"))
    return joined.drop("_prev", "_carry", *([] if given else [BUCKET]))


def running_row_sums(
    df: DataFrame, by: Sequence[str], order: str, flags: dict[str, str]
) -> DataFrame:
    """Running sum of flag columns kept on every row; (group, order) must be unique.

    ``flags`` maps a source column to the name of its running sum. A bucket column
    already present is used and kept.
    """
    given = BUCKET in df.columns
    bucketed = df if given else with_bucket(df, order)
    totals = bucketed.groupBy(*by, BUCKET).agg(*[F.sum(c).alias(f"_s_{c}") for c in flags])
    earlier = (
        Window.partitionBy(*_group(by)).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *by, BUCKET,
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in flags],
    )
    inside = (
        Window.partitionBy(*by, BUCKET).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = attach(bucketed, offsets, [*by, BUCKET])
    for c, name in flags.items():
        joined = joined.withColumn(name, F.sum(c).over(inside) + F.col(f"_before_{c}"))
    return joined.drop(*([] if given else [BUCKET]), *[f"_before_{c}" for c in flags])
