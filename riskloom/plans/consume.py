"""Continuous scoring from the transactions topic to the decisions topic and table."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame

from riskloom.operators.explain import Explainer
from riskloom.operators.model import load_model
from riskloom.plans.session import session
from riskloom.settings import Settings
from riskloom.sources.topics import BATCH_RECORDS, read_topic
from riskloom.streaming.monitoring import start_monitor
from riskloom.streaming.progress import report_progress, stop_after
from riskloom.streaming.scoring import ScoringPaths, read_scored, scored_schema, start_scoring


def main() -> None:
    settings = Settings.from_env()
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--bootstrap", default=settings.kafka_bootstrap_servers)
    parser.add_argument("--models", required=True)
    parser.add_argument("--model-version", default=settings.model_version)
    parser.add_argument("--root", required=True, help="shared folder of decisions and state")
    parser.add_argument(
        "--max-per-batch", type=int, default=BATCH_RECORDS, help="bound of one micro-batch"
    )
    parser.add_argument("--max-messages", type=int, help="stop after about so many messages")
    parser.add_argument("--reference", help="parquet snapshot: watch alerts and drift against it")
    parser.add_argument("--once", action="store_true", help="stop when the topic is drained")
    args = parser.parse_args()

    spark = session("consume")
    settings = replace(settings, kafka_bootstrap_servers=args.bootstrap)
    paths = ScoringPaths.below(args.root)
    report_progress(spark)
    most = min(args.max_per_batch, args.max_messages or args.max_per_batch)
    run(
        read_topic(spark, settings, most),
        load_model(spark, args.models, args.model_version),
        Explainer.load(spark, f"{args.models}/{args.model_version}"),
        paths,
        settings,
        spark.read.parquet(args.reference) if args.reference else None,
        args.max_messages,
        args.once,
        to_topic=True,
    )


def run(
    messages: DataFrame,
    model: GBTClassificationModel,
    explainer: Explainer,
    paths: ScoringPaths,
    settings: Settings = Settings(),
    reference: DataFrame | None = None,
    max_messages: int | None = None,
    once: bool = False,
    to_topic: bool = False,
) -> None:
    """Score a stream of messages and, given a reference, watch the scores beside it.

    Both queries start at once; with `once` the watch starts when everything has been scored, since a
    query that drains its source would see only what is there at its start.
    """
    trigger = {"availableNow": True} if once else {"processingTime": "1 second"}
    schema = scored_schema(messages, model, explainer) if reference is not None else None
    query = start_scoring(messages, model, explainer, paths, settings, to_topic, trigger)

    def watch():
        root = os.path.dirname(paths.scored)
        return start_monitor(
            read_scored(messages.sparkSession, paths, schema), reference, f"{root}/monitor/state",
            f"{root}/monitor/reports", f"{root}/monitor/checkpoint", settings, trigger=trigger,
        )

    beside = watch() if reference is not None and not once else None
    if max_messages:
        stop_after(query, max_messages)
    else:
        query.awaitTermination()
    if beside is not None:
        beside.processAllAvailable()
        beside.stop()
    elif reference is not None:
        watch().awaitTermination()


if __name__ == "__main__":
    main()
