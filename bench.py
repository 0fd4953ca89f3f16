"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set table folder and cores. A query is
timed from the call to the last row produced; rows go to the noop sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tabwise.queries import REGISTRY
from tabwise.session import build_session

HEADLINE = (
    "slice_mean", "slice_median", "aggregate_multi", "compare_dimension", "interesting_slices",
    "search_eq_in_gte", "search_contains_range", "validate_duplicates", "profile_counts", "profile_numeric",
    "profile_categorical", "rolling_mean", "rolling_std", "rolling_median", "rolling_slope", "rolling_weeks",
    "feature_matrix", "target_future_event", "interval_join", "asof_lookup", "lags", "time_to_next_event",
    "split_chronological", "split_random", "onehot", "roc_auc", "best_threshold", "metrics_regression",
    "error_slices", "search_predict_rank", "group_onehot", "top_drivers", "train_ridge_score",
    "train_logistic_score", "train_gbt_score", "tree_attribution",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # JVM warm-up
    times = {}
    for name in wanted:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
