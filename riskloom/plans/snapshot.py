"""Write the reference that drift is measured against: features, labels and scores of training rows."""

from __future__ import annotations

import argparse

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame

from riskloom.operators.drift import reference_snapshot
from riskloom.operators.features import engineer_features
from riskloom.operators.model import add_scores, load_model
from riskloom.plans.session import add_input_arguments, read_input, session
from riskloom.sources.transactions import temporal_split


def run(
    transactions: DataFrame,
    path: str,
    model: GBTClassificationModel | None = None,
    velocity_mode: str = "shared",
) -> None:
    """Features of the training steps, in the mode that serving uses, with the model's scores if one
    is given. An earlier snapshot at the path is replaced."""
    features = engineer_features(temporal_split(transactions)[0], velocity_mode)
    rows = features if model is None else add_scores(features, model)
    reference_snapshot(rows).write.mode("overwrite").parquet(path)


def main() -> None:
    parser = add_input_arguments(argparse.ArgumentParser(description=__doc__))
    parser.add_argument("--reference", required=True, help="folder of the snapshot to write")
    parser.add_argument("--models", help="folder of saved models: scores go into the snapshot")
    parser.add_argument("--version", default="v1")
    parser.add_argument("--velocity", default="shared", choices=["by_role", "shared"])
    args = parser.parse_args()

    spark = session("snapshot")
    model = load_model(spark, args.models, args.version) if args.models else None
    run(read_input(spark, args.input, args.format), args.reference, model, args.velocity)


if __name__ == "__main__":
    main()
