"""Largest task per scenario on data with one hot key: python tools/skew.py [million rows].

A third of all rows belong to one entity, score, conversation or value. For each
scenario the event log gives the wall time, the shuffled bytes, and the largest
task's share of all task time, which would be near 1 for a plan that ends in one task.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from daygrid.operators import cohort, dialogue, evaluate, profile, quality, splits  # noqa: E402
from daygrid.operators import series as S  # noqa: E402
from daygrid.session import build_session  # noqa: E402


def uniform(tag: int):
    return F.pmod(F.xxhash64("id", F.lit(tag)), F.lit(2**31)) / float(2**31)


def scenarios(spark, rows: int):
    base = spark.range(0, rows, 1, 32)
    hot = F.col("id") % 3 == 0
    series = base.select(
        F.when(hot, 0).otherwise((uniform(1) * 50_000).cast("int")).alias("entity_id"),
        ((uniform(2) * 46).cast("int") - 15).alias("day"),
        F.concat(F.lit("c"), (uniform(3) * 20).cast("int").cast("string")).alias("channel"),
        uniform(4).alias("value"),
    )
    scores = base.select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("m"), (uniform(5) * 5).cast("int").cast("string"))).alias("model"),
        (uniform(6) < 0.2).cast("int").alias("y"),
        F.when(F.col("id") % 9 == 0, 0.5).otherwise(uniform(7)).alias("score"),
    )
    turns = base.select(
        F.when(hot, -1).otherwise((F.col("id") / 20).cast("long")).alias("conv_id"), F.col("id").alias("turn"),
        F.when(uniform(8) < 0.5, "user").otherwise("model").alias("role"),
    )
    keyed = base.select(F.when(hot, 0).otherwise((uniform(9) * rows / 4).cast("long")).alias("entity_id"), F.col("id").alias("v"))
    yield "window features", lambda: S.window_features(S.daily(series), -15, 2)
    yield "carried area", lambda: S.carried_auc(S.daily(series), -15, 2)
    yield "baseline", lambda: S.baseline_long(S.daily(series))
    yield "day grid", lambda: quality.check_day_grid(series, -15, 30)
    yield "auc", lambda: evaluate.auc(scores, ["model"])
    yield "all metrics", lambda: evaluate.summary(scores, ["model"])
    yield "decision curve", lambda: evaluate.decision_curve(scores, ["model"])
    yield "rounds", lambda: dialogue.with_rounds(turns)
    yield "re-key", lambda: cohort.rekey(keyed, cohort.id_map(keyed))
    yield "group folds", lambda: splits.group_folds(keyed, "entity_id", 5)
    yield "describe", lambda: profile.describe(scores, ["score"])
    yield "id continuity", lambda: quality.check_id_continuity(keyed, "entity_id")


def main() -> None:
    rows = int(float(sys.argv[1] if len(sys.argv) > 1 else 3) * 1_000_000)
    log = tempfile.mkdtemp(prefix="skew-")
    spark = build_session(
        "skew", "local[8]",
        **{"spark.sql.shuffle.partitions": "32", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.eventLog.enabled": "true", "spark.eventLog.dir": log, "spark.eventLog.rolling.enabled": "false",
           "spark.eventLog.compress": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    walls = {}
    for name, build in scenarios(spark, rows):
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        walls[name] = time.perf_counter() - start
    spark.stop()
    group_of, tasks, shuffled = {}, {}, {}
    for path in glob.glob(f"{log}/*"):
        for line in open(path):
            event = json.loads(line)
            if event["Event"] == "SparkListenerJobStart":
                for stage in event["Stage IDs"]:
                    group_of[stage] = (event.get("Properties") or {}).get("spark.jobGroup.id")
            elif event["Event"] == "SparkListenerTaskEnd":
                name, metrics = group_of.get(event["Stage ID"]), event.get("Task Metrics") or {}
                tasks.setdefault(name, []).append(metrics.get("Executor Run Time", 0) / 1000)
                written = (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                shuffled[name] = shuffled.get(name, 0) + written
    print(f"{'scenario':18}{'wall s':>8}{'task s':>8}{'largest s':>11}{'share':>7}{'shuffle MB':>12}")
    for name, wall in walls.items():
        t = tasks.get(name) or [0.0]
        print(f"{name:18}{wall:8.1f}{sum(t):8.1f}{max(t):11.2f}{max(t) / max(sum(t), 1e-9):7.3f}{shuffled.get(name, 0) / 2**20:12.1f}")


if __name__ == "__main__":
    main()
