"""Exact evaluation tables from scored rows.

Input rows carry ``y`` (0/1), ``score`` and the keys in ``by`` (model, split,
fold, subgroup …). Curves start from one row per distinct (keys, score), so ties
are exact and heavy ties are cheap; no group is ever sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.functions.recode import clip
from daygrid.operators.running import BUCKET, INF, default_buckets, numeric_bucket, numeric_cuts, running_sums
from daygrid.session import durable, spread

def _pos() -> Column:
    return (F.col("y") == 1).cast("long")


def _neg() -> Column:
    return (F.col("y") == 0).cast("long")


def curve(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score, from the highest down: positives and negatives at and above it."""
    return running_sums(scores, by, "score", {"pos": _pos(), "neg": _neg()}, descending=True)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _cell_metrics(cells: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    sens, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return cells.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
            "sensitivity": sens,
            "specificity": spec,
            "precision": _ratio(tp, tp + fp),
            "npv": _ratio(tn, tn + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "g_mean": F.sqrt(sens * spec),
        }
    )


def confusion(scores: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The four cells at score >= threshold and the metrics from them (0 when undefined)."""
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    cells = scores.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"),
    )
    return _cell_metrics(cells)


def roc_points(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(keys, threshold, fpr, tpr) for every distinct score, and the origin with null threshold."""
    run = curve(scores, by)

    def point(threshold: Column, fpr: Column, tpr: Column) -> Column:
        return F.struct(threshold.alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))

    here = point(
        F.col("score"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("total_neg")),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos")),
    )
    origin = point(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0))
    # the highest score of a key carries the origin along: no second pass for the keys
    highest = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    return run.select(*by, F.inline(F.when(highest, F.array(origin, here)).otherwise(F.array(here))))


def _areas() -> dict[str, Column]:
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cp, cn = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    p, n = F.max("total_pos"), F.max("total_neg")
    precision = F.try_divide(cp, cp + cn)
    before = F.coalesce(F.try_divide(cp - pos, cp - pos + cn - neg), F.lit(1.0))
    return {
        "auc": F.try_divide(F.sum(neg * (cp - pos / 2)), p * n),
        "pr_auc": F.try_divide(F.sum(pos * (precision + before) / 2), p),
        "average_precision": F.try_divide(F.sum(pos * precision), p),
    }


def auc(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a class is absent."""
    run = curve(scores, by)
    area = _areas()["auc"].alias("auc")
    return run.groupBy(*by).agg(area)


def pr_points(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    cp, cn = F.col("cum_pos").cast("double"), F.col("cum_neg")
    return curve(scores, by).select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(cp, cp + cn).alias("precision"), F.try_divide(cp, F.col("total_pos")).alias("recall"),
    )


def pr_auc(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trapezoid area under precision-recall, starting at (recall 0, precision 1)."""
    return curve(scores, by).groupBy(*by).agg(_areas()["pr_auc"].alias("pr_auc"))


def average_precision(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Step-wise area: precision weighted by the gain in recall."""
    return curve(scores, by).groupBy(*by).agg(_areas()["average_precision"].alias("average_precision"))


def brier(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))).alias("brier"))


def summary(scores: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Every scalar metric per key from one tally: cells, areas, Brier, class counts."""
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    hit = s >= threshold

    def over(flag, n):
        return F.sum(F.when(flag, n).otherwise(0))

    areas = _areas()
    total = F.max("total_pos") + F.max("total_neg")
    cells = curve(scores, by).groupBy(*by).agg(
        F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"),
        over(hit, pos).alias("tp"), over(~hit, neg).alias("tn"),
        over(hit, neg).alias("fp"), over(~hit, pos).alias("fn"),
        *[c.alias(name) for name, c in areas.items()],
        (F.sum(pos * F.pow(s - 1, F.lit(2.0)) + neg * F.pow(s, F.lit(2.0))) / total).alias("brier"),
    )
    return _cell_metrics(cells)


def calibration(scores: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """(keys, bin, n, prob_true, prob_pred) over right-closed uniform bins that hold rows;
    rows without score or label are in none."""
    known = scores.where(F.col("score").isNotNull() & F.col("y").isNotNull())
    p = clip(F.col("score"))
    number = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(p * bins))).cast("int")
    return known.groupBy(*by, number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("prob_true"), F.avg(p).alias("prob_pred")
    )


def calibration_error(scores: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean absolute gap over the non-empty bins (bins weigh the same)."""
    gap = F.abs(F.col("prob_true") - F.col("prob_pred"))
    return calibration(scores, by, bins).groupBy(*by).agg(F.avg(gap).alias("calibration_error"))


def _descending_bucket(df: DataFrame, col: Column, cuts: list[float], name: str) -> DataFrame:
    """Number of cut points strictly below the value (binary search in the JVM)."""
    ordered = sorted(cuts, reverse=True)
    split = Bucketizer(
        splits=[-INF, *[-c for c in ordered], INF], inputCol="_minus", outputCol="_at", handleInvalid="keep"
    )
    out = split.transform(df.withColumn("_minus", -col.cast("double")))
    return out.withColumn(name, (F.lit(len(cuts)) - F.col("_at")).cast("int")).drop("_minus", "_at")


def thresholds(lo: float = 0.01, hi: float = 0.99, n: int = 100) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n)]


def _dense(groups: DataFrame, by: Sequence[str], values: list[float], name: str) -> DataFrame:
    grid = F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_j", name)
    return groups.select(*by, grid)


def cut_counts(scores: DataFrame, by: Sequence[str], cuts: list[float]) -> DataFrame:
    """(keys, threshold, pos, neg, pos_above, neg_above): rows with score > threshold.

    Scores are counted by the number of thresholds below them: at most one row per
    threshold and key survives the map side, then a short reverse running sum.
    """
    counted = _descending_bucket(scores.where(F.col("score").isNotNull()), F.col("score"), cuts, "_k")
    tally = counted.groupBy(*by, "_k").agg(F.sum(_pos()).alias("_up"), F.sum(_neg()).alias("_un"))
    totals = tally.groupBy(*by).agg(F.sum("_up").alias("pos"), F.sum("_un").alias("neg"))
    above = tally.where("_k > 0").withColumn("_j", F.col("_k") - 1).drop("_k")
    down = Window.partitionBy(*by).orderBy(F.desc("_j")).rowsBetween(Window.unboundedPreceding, 0)
    frame = _dense(totals.select(*by), by, cuts, "threshold").join(totals, list(by)).join(
        above, [*by, "_j"], "left"
    )
    return frame.select(
        *by, "threshold", "pos", "neg",
        F.sum(F.coalesce("_up", F.lit(0))).over(down).alias("pos_above"),
        F.sum(F.coalesce("_un", F.lit(0))).over(down).alias("neg_above"),
    )


def decision_curve(scores: DataFrame, by: Sequence[str], grid: list[float] | None = None) -> DataFrame:
    """Net benefit of the model (score > t) and of treating all, per threshold."""
    n, t = F.col("pos") + F.col("neg"), F.col("threshold")
    odds = t / (1 - t)
    return cut_counts(scores, by, grid or thresholds()).select(
        *by, "threshold",
        (F.col("pos_above") / n - F.col("neg_above") / n * odds).alias("net_benefit"),
        (F.col("pos") / n - F.col("neg") / n * odds).alias("treat_all"),
    )


def interpolated_roc(scores: DataFrame, by: Sequence[str], n: int = 100) -> DataFrame:
    """(keys, grid, tpr): each key's ROC curve read off an even grid of fpr.

    Only the first and last curve point of every grid cell can bracket a grid
    point, so a curve shrinks to 2n rows by partial aggregation; the bracket is
    then found by carrying the last point forward and the next one back.
    """
    grid = [i * (1.0 / (n - 1)) for i in range(n)]
    points = roc_points(scores, by).where("fpr is not null and tpr is not null")
    placed = _descending_bucket(points, F.col("fpr"), grid, "_j")  # first grid point >= fpr
    point = F.struct("fpr", "tpr")
    cells = placed.groupBy(*by, "_j").agg(F.max(point).alias("_last"), F.min(point).alias("_first"))
    frame = _dense(cells.select(*by).distinct(), by, grid, "grid").join(cells, [*by, "_j"], "left")
    order = Window.partitionBy(*by).orderBy("_j")
    left = F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = frame.withColumns({"_l": left, "_r": right})
    slope = (F.col("_r.tpr") - F.col("_l.tpr")) / (F.col("_r.fpr") - F.col("_l.fpr"))
    at = F.when(F.col("_r").isNull(), F.col("_l.tpr")).otherwise(
        F.col("_l.tpr") + (F.col("grid") - F.col("_l.fpr")) * slope
    )
    return both.select(*by, "_j", "grid", F.when(F.col("_j") == 0, 0.0).otherwise(at).alias("tpr"))


def mean_roc(scores: DataFrame, by: Sequence[str], fold: str = "fold", n: int = 100) -> DataFrame:
    """Mean curve over folds with a band of one deviation, cut to [0, 1]."""
    each = interpolated_roc(scores, [*by, fold], n)
    mean = each.groupBy(*by, "_j", "grid").agg(F.avg("tpr").alias("_m"), F.stddev_pop("tpr").alias("std_tpr"))
    fixed = mean.withColumn("mean_tpr", F.when(F.col("_j") == n - 1, 1.0).otherwise(F.col("_m")))
    return fixed.select(
        *by, F.col("_j").alias("point"), F.col("grid").alias("fpr"), "mean_tpr", "std_tpr",
        F.greatest(F.col("mean_tpr") - F.col("std_tpr"), F.lit(0.0)).alias("lower"),
        F.least(F.col("mean_tpr") + F.col("std_tpr"), F.lit(1.0)).alias("upper"),
    )


def subgroup_auc(scores: DataFrame, by: Sequence[str], subgroup: str) -> DataFrame:
    return auc(scores, [*by, subgroup])


def split_gap(metrics: DataFrame, metric: str = "auc", split: str = "split") -> DataFrame:
    """Train minus test value of a metric per model."""
    sides = {s: F.max(F.when(F.col(split) == s, F.col(metric))).alias(f"{s}_{metric}") for s in ("train", "test")}
    both = metrics.where(F.col(split).isin(*sides)).groupBy("model").agg(*sides.values(), F.count_distinct(split).alias("_s"))
    gap = F.col(f"train_{metric}") - F.col(f"test_{metric}")
    return both.where("_s = 2").drop("_s").withColumn("gap", gap)


def best_models(metrics: DataFrame, metric: str = "auc", n: int = 3) -> DataFrame:
    return metrics.orderBy(F.desc(metric), "model").limit(n)


def poisson_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities, until the tail is below the resolution of the draw."""
    steps, term, total, k = [], math.exp(-1.0), 0.0, 0
    while not steps or 1.0 - total > 2.0**-52:
        total += term
        steps.append(total)
        k += 1
        term /= k
    return [s for s in steps if s < 1.0]


def _drawn(ids: Sequence[str | None], replicates: int, seed: int) -> np.ndarray:
    """The Poisson(1) weight of every row in every replicate, from a hash of both."""
    numbers = [str(r).encode() for r in range(1, replicates + 1)]
    out = bytearray()
    for i in ids:
        start = md5(f"{seed}-{i}-".encode() if i is not None else f"{seed}-".encode())
        for n in numbers:
            each = start.copy()
            each.update(n)
            out += each.digest()[:8]
    share = (np.frombuffer(bytes(out), dtype=">u8") >> np.uint64(12)).astype(np.float64) / 2.0**52
    return np.searchsorted(np.array(poisson_steps()), share, side="left").astype(np.int64).reshape(len(ids), replicates)


#: Rows whose weights are held at a time.
_ROWS = 256


class _Resampled:
    """One bucket of rows by falling score, for all replicates at once."""

    def __init__(self, replicates: int) -> None:
        self.pos, self.neg = np.zeros(replicates, dtype=np.int64), np.zeros(replicates, dtype=np.int64)
        self.pairs = np.zeros(replicates)
        self.score: float | None = None  # the tie that may go on
        self.tie = (self.pos.copy(), self.neg.copy())

    def _close(self, p: np.ndarray, n: np.ndarray) -> None:
        """Ties (a row each) whose rows are all known: a positive above counts 1, beside 1/2."""
        above = self.pos + np.cumsum(p, axis=0) - p
        self.pairs += (n * (above + p / 2.0)).sum(axis=0)
        self.pos, self.neg = self.pos + p.sum(axis=0), self.neg + n.sum(axis=0)

    def add(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        begin = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        p, n = (np.add.reduceat(weight * (y == k)[:, None], begin, axis=0) for k in (1, 0))
        if score[0] == self.score:
            p[0] += self.tie[0]
            n[0] += self.tie[1]
        elif self.score is not None:
            self._close(*(x[None] for x in self.tie))
        self._close(p[:-1], n[:-1])
        self.score, self.tie = score[-1], (p[-1], n[-1])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._close(*(x[None] for x in self.tie))
        return self.pos, self.neg, self.pairs


def _resampled_buckets(dealt: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(bucket, pos, neg, pairs) with a number per replicate in each list."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out() -> pa.RecordBatch:
            lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in zip(state.result(), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), *lists], names=[BUCKET, "pos", "neg", "pairs"])

        for batch in batches:
            bucket, score, y, salt = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
            ids = batch.column(3).to_pylist()
            edges = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(salt) != 0)) + 1), len(bucket)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo < hi and (bucket[lo], salt[lo]) != now:
                    if now is not None:
                        yield out()
                    now, state = (int(bucket[lo]), int(salt[lo])), _Resampled(replicates)
                for at in range(lo, hi, _ROWS):
                    part = slice(at, min(at + _ROWS, hi))
                    state.add(score[part], y[part], _drawn(ids[part], replicates, seed))
        if now is not None:
            yield out()

    rows = dealt.select(BUCKET, "score", F.col("y").cast("int"), F.col("_id").cast("string"), "_salt")
    # a row is a few bytes and costs ``replicates`` draws
    return spread(rows, BUCKET, "_salt").sortWithinPartitions(BUCKET, "_salt", F.desc("score")).mapInArrow(
        walk, f"{BUCKET} int, pos array<long>, neg array<long>, pairs array<double>")


def _known(scores: DataFrame, row_id: str) -> DataFrame:
    return scores.where(F.col("score").isNotNull() & F.col("y").isin(0, 1)).select(
        F.col(row_id).alias("_id"), F.col("score").cast("double").alias("score"), "y")


def bootstrap_auc_values(scores: DataFrame, row_id: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, value): AUC of each Poisson resample.

    The rows are shuffled once, by score bucket, and streamed by falling score; their
    weights are vectors with a place per replicate, and so are the sums that a bucket keeps.
    What the buckets pass on to each other is a vector of totals each. A score with a
    bucket's share of all rows is a bucket of its own, whose rows are dealt at will: they
    are one tie, so their totals say all.
    """
    known = _known(scores, row_id)
    buckets = default_buckets(known)
    counts = durable(known.groupBy("score").agg(F.count("*").alias("n")), "score-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r["score"] for r in counts.where(F.col("n") * buckets >= total).collect()]  # at most ``buckets``
    cuts = sorted({*numeric_cuts(counts.select("score"), "score", buckets), *hot, *(math.nextafter(h, INF) for h in hot)} - {INF, -INF})
    alone = [cuts.index(h) + 1 for h in hot if h in cuts]
    dealt = numeric_bucket(known, "score", cuts).withColumn(
        "_salt", F.when(F.col(BUCKET).isin(alone), F.pmod(F.xxhash64("_id"), F.lit(buckets))).otherwise(0).cast("int"))
    cells = _resampled_buckets(dealt, replicates, seed)
    parts = cells.select(BUCKET, F.posexplode(F.arrays_zip("pos", "neg", "pairs")).alias("_r", "_v")).select(
        BUCKET, (F.col("_r") + 1).alias("replicate"), "_v.*")
    flat = parts.groupBy(BUCKET, "replicate").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pairs")]).withColumn(
        "pairs", F.when(F.col(BUCKET).isin(alone), F.col("pos") * F.col("neg") / 2.0).otherwise(F.col("pairs")))
    earlier = Window.partitionBy("replicate").orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carried = flat.withColumn("_before", F.coalesce(F.sum("pos").over(earlier), F.lit(0)))
    pairs = F.sum(F.col("pairs") + F.col("neg") * F.col("_before"))
    return carried.groupBy("replicate").agg(F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg")).alias("value"))


def bootstrap_brier_values(scores: DataFrame, row_id: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, value): Brier score of each resample; every task passes on two sums per replicate."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, count = np.zeros(replicates), np.zeros(replicates, dtype=np.int64)
        for batch in batches:
            each = (batch.column(0).to_numpy() - batch.column(1).to_numpy()) ** 2
            ids = batch.column(2).to_pylist()
            for at in range(0, len(ids), _ROWS):
                weight = _drawn(ids[at : at + _ROWS], replicates, seed)
                loss += each[at : at + _ROWS] @ weight
                count += weight.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(1, replicates + 1), pa.int32()), pa.array(loss), pa.array(count)], names=["replicate", "loss", "n"])

    rows = _known(scores, row_id).select(F.col("score").cast("double"), F.col("y").cast("int"), F.col("_id").cast("string"))
    return rows.mapInArrow(walk, "replicate int, loss double, n long").groupBy("replicate").agg(
        F.try_divide(F.sum("loss"), F.sum("n")).alias("value"))


def bootstrap_ci(
    scores: DataFrame, row_id: str, metric: str = "auc", replicates: int = 1000,
    level: float = 0.95, seed: int = 42,
) -> DataFrame:
    """Mean and percentile interval of a metric over resamples (undefined ones left out)."""
    per = (bootstrap_brier_values if metric == "brier" else bootstrap_auc_values)(scores, row_id, replicates, seed)
    tail = (1 - level) / 2
    return per.agg(
        F.avg("value").alias("mean"),
        F.percentile("value", tail).alias("lower"),
        F.percentile("value", 1 - tail).alias("upper"),
        F.count("value").alias("n_replicates"),
    )
