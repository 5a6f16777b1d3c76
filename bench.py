"""Headline queries, median of three after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from daygrid.plans.catalog import run_query  # noqa: E402
from daygrid.session import build_session, release  # noqa: E402

HEADLINES = (
    "feature_table", "window_features", "baseline_last_observation", "carried_auc", "two_window_features",
    "availability", "large_description", "distinct_counts", "average_ranks", "mann_whitney_large",
    "dense_ids", "folds_for_rows", "group_folds", "rule_issues", "day_grid_check", "roc_auc", "fold_metrics",
    "decision_curve", "mean_roc", "conversation_rounds", "code_like_documents", "pearson_matrix",
    "spearman_matrix", "baseline_table", "bootstrap_auc", "smote_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        run_query(name, spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINES:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline query time, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "runs": runs,
    }))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
