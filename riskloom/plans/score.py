"""Batch scoring of a transaction table with a saved model."""

from __future__ import annotations

import argparse

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame

from riskloom.operators.decisions import log_decisions, to_decision_records
from riskloom.operators.explain import Explainer
from riskloom.operators.features import engineer_features
from riskloom.operators.model import load_model
from riskloom.operators.validate import valid_rows
from riskloom.plans.session import add_input_arguments, read_input, session
from riskloom.settings import Settings
from riskloom.streaming.scoring import score_enriched

TOP_FEATURES = 5


def score_transactions(
    transactions: DataFrame,
    model: GBTClassificationModel,
    explainer: Explainer,
    explain_k: int = TOP_FEATURES,
    explain_from: float = 0.0,
    velocity_mode: str = "shared",
    settings: Settings = Settings(),
) -> DataFrame:
    """Decision records for all valid rows. Any number of rows, all explained in one pass."""
    features = engineer_features(valid_rows(transactions), velocity_mode)
    scored = score_enriched(features, model, explainer, settings, explain_from)
    return to_decision_records(scored, explain_k)


def main() -> None:
    settings = Settings.from_env()
    parser = add_input_arguments(argparse.ArgumentParser(description=__doc__))
    parser.add_argument("--models", required=True)
    parser.add_argument("--model-version", default=settings.model_version)
    parser.add_argument("--output", required=True, help="folder for decision records")
    parser.add_argument("--log", help="folder of the decision log to append to")
    parser.add_argument("--velocity", default="shared", choices=["by_role", "shared"])
    parser.add_argument("--explain-from", type=float, default=0.0)
    args = parser.parse_args()

    spark = session("score")
    model = load_model(spark, args.models, args.model_version)
    explainer = Explainer.load(spark, f"{args.models}/{args.model_version}")
    rows = read_input(spark, args.input, args.format)
    score_transactions(
        rows, model, explainer, explain_from=args.explain_from, velocity_mode=args.velocity,
        settings=settings,
    ).write.parquet(args.output)
    if args.log:
        log_decisions(spark.read.parquet(args.output), args.log)


if __name__ == "__main__":
    main()
