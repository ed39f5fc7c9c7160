"""Offline training: split by time, engineer, fit, evaluate, explain three frauds, save."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import top_contributions
from riskloom.operators.decisions import first_frauds
from riskloom.operators.evaluate import average_precision, best_f1, class_report
from riskloom.operators.explain import Explainer, add_contributions
from riskloom.operators.features import engineer_features
from riskloom.operators.model import (
    BoostingParams,
    add_scores,
    importance,
    save_model,
    train_boosted,
)
from riskloom.operators.registry import append_run
from riskloom.plans.session import add_input_arguments, read_input, session
from riskloom.sources.transactions import temporal_split
from riskloom.sources.workspace import fresh_path


@dataclass
class Evaluation:
    pr_auc: float
    best_threshold: float
    best_f1: float
    report: DataFrame
    importance: DataFrame


def held_out_steps(train: DataFrame, part: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(earlier, last steps) of the training rows, so that the test rows stay unseen."""
    span = train.agg(F.min("step").alias("low"), F.max("step").alias("high")).first()
    cut = span["high"] - max(1, int((span["high"] - span["low"] + 1) * part))
    return train.where(F.col("step") <= cut), train.where(F.col("step") > cut)


def evaluate(
    scored: DataFrame, model: GBTClassificationModel, model_path: str, threshold: float = 0.5
) -> Evaluation:
    """Eager on two single rows; the report and the importances stay DataFrames."""
    best = best_f1(scored).first()
    return Evaluation(
        pr_auc=average_precision(scored).first()["pr_auc"],
        best_threshold=best["best_threshold"],
        best_f1=best["best_f1"],
        report=class_report(scored, threshold),
        importance=importance(scored.sparkSession, model, model_path),
    )


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: later passes skip the work and survive a
    lost executor."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def run(
    transactions: DataFrame,
    model_root: str,
    version: str = "v1",
    save: bool = True,
    params: BoostingParams = BoostingParams(),
    velocity_mode: str = "by_role",
    validate_on_test: bool = False,
    early_stopping: bool = True,
) -> tuple[GBTClassificationModel, Evaluation, DataFrame]:
    """Returns the model, its evaluation on the test steps, and three explained frauds.

    Splits are engineered apart, so no velocity crosses the boundary step.
    """
    spark = transactions.sparkSession
    train_rows, test_rows = temporal_split(transactions)
    train = store(engineer_features(train_rows, velocity_mode), "train-features")
    test = store(engineer_features(test_rows, velocity_mode), "test-features")

    fit_on, validation = train, None
    if early_stopping:
        fit_on, validation = (train, test) if validate_on_test else held_out_steps(train)
    model = train_boosted(fit_on, validation, params)

    root = model_root if save else fresh_path(spark, "unsaved-model")
    path = save_model(spark, model, root, version)
    scored = store(add_scores(test, model), "test-scores")
    result = evaluate(scored, model, path)
    if save:
        append_run(
            spark, f"{model_root}/_runs", version, result.pr_auc, result.pr_auc, "manual", None,
            False,
        )
    cases = add_scores(first_frauds(test), model, keep_vector=True)
    explained = add_contributions(cases, Explainer.load(spark, path), explain_from=0.0).select(
        "event_id", "risk_score", top_contributions("contributions", 5).alias("top_features")
    )
    return model, result, explained


def main() -> None:
    parser = add_input_arguments(argparse.ArgumentParser(description=__doc__))
    parser.add_argument("--models", required=True, help="folder of saved models")
    parser.add_argument("--version", default="v1")
    parser.add_argument("--no-save", action="store_true")
    parser.add_argument("--rounds", type=int, default=BoostingParams.rounds)
    parser.add_argument("--velocity", default="by_role", choices=["by_role", "shared"])
    parser.add_argument("--validate-on-test", action="store_true")
    args = parser.parse_args()

    spark = session("train")
    _, result, explained = run(
        read_input(spark, args.input, args.format),
        args.models,
        args.version,
        not args.no_save,
        BoostingParams(rounds=args.rounds),
        args.velocity,
        args.validate_on_test,
    )
    print(f"PR-AUC {result.pr_auc:.4f}")
    print(f"best threshold {result.best_threshold:.4f} (F1 {result.best_f1:.4f})")
    result.report.show(truncate=False)
    result.importance.show(10, truncate=False)
    explained.show(truncate=False)


if __name__ == "__main__":
    main()
