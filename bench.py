"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "decision_report",
    "features_batch",
    "features_online",
    "decision_bands",
    "validate_rows",
    "semi_join_counts",
    "describe_amount",
    "duplicate_rows",
    "average_precision",
    "best_f1",
    "class_report",
    "monitor_summary",
    "progress_batches",
    "ks_by_feature",
    "drift_summary",
    "ap_by_bucket",
    "gbt_scores",
    "gbt_explain",
    "stream_velocity",
    "stream_scoring",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from catalog.queries import QUERIES, fitted_model

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}

    def timed(name, work):
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    timed("train_20_rounds", lambda: fitted_model(spark, sf_dir))
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        # The noop sink computes every column of every row, unlike a count.
        timed(
            name,
            lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save(),
        )
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": {k: round(rows / v) for k, v in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
