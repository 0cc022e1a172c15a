"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from oddrows.session import local_session, release  # noqa: E402

HEADLINE = [
    "flagship_time_anomalies", "a9_dataset_profile", "a12_numeric_summary", "a18_spearman_matrix", "a11_duplicate_rows",
    "w3_streak_length", "running_row_index", "d7_flatline", "d10_domain_scores", "t3_weighted_combination", "t7_threshold_adaptive_gap",
    "t9_best_percentile", "e4_roc_auc", "i1_spike_single", "i6_temporal_block", "j9_cell_changes", "k3_stratified_cap",
    "d1_isolation_forest", "d2_one_class_svm", "d3_local_outlier_factor", "d4_knn_distance", "d5_autoencoder", "d6_lstm_autoencoder",
    "m2_score_statistics", "t13_full_detection",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    checks.load_all()
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # start the JVM's engines
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        # The no-op sink computes every row without moving any to the driver.
        checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        release()
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
