"""Drift of a current window against a reference, with tables as the report."""

from __future__ import annotations

import argparse

from riskloom.operators.drift import check_drift, save_drift_report, two_samples
from riskloom.operators.registry import should_retrain
from riskloom.plans.session import session
from riskloom.settings import Settings


def main() -> None:
    settings = Settings.from_env()
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--reference", required=True, help="parquet snapshot of features")
    parser.add_argument("--current", required=True, help="parquet window of features")
    parser.add_argument("--report", help="folder of the report tables to append to")
    args = parser.parse_args()

    spark = session("monitor")
    summary, tests = check_drift(
        two_samples(spark.read.parquet(args.reference), spark.read.parquet(args.current)),
        settings.drift_threshold,
    )
    if args.report:
        save_drift_report(summary, tests, args.report)
        summary = spark.read.parquet(f"{args.report}/drift_summary")
    tests.show(truncate=False)
    should_retrain(summary.orderBy("timestamp")).show(truncate=False)


if __name__ == "__main__":
    main()
