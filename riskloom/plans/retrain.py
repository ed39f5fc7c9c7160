"""Retraining: sliding window, challenger against champion on the same test rows, promotion."""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.evaluate import average_precision
from riskloom.operators.features import engineer_features
from riskloom.operators.model import (
    BoostingParams,
    add_scores,
    load_model,
    save_model,
    train_boosted,
)
from riskloom.operators.registry import (
    TRIGGERS,
    append_run,
    champion,
    is_promotion,
    read_runs,
    reserve_version,
)
from riskloom.plans.session import add_input_arguments, read_input, session
from riskloom.plans.train import held_out_steps, store
from riskloom.settings import Settings
from riskloom.sources.transactions import temporal_split


@dataclass(frozen=True)
class RetrainResult:
    new_version: str
    pr_auc: float
    champion_pr_auc: float
    improvement: float
    promoted: bool
    trigger: str


def recent_window(train: DataFrame, window_steps: int = 500) -> DataFrame:
    """Rows from `window_steps` steps before the newest one on, both ends included.

    The newest step is one row, read first, so the window is a plain filter a scan can use.
    """
    newest = train.agg(F.max("step").alias("step")).first()["step"]
    return train if newest is None else train.where(F.col("step") >= max(1, newest - window_steps))


def run(
    transactions: DataFrame,
    model_root: str,
    trigger: str = "scheduled",
    drift_score: float | None = None,
    force_promote: bool = False,
    settings: Settings = Settings(),
    params: BoostingParams = BoostingParams(),
    velocity_mode: str = "by_role",
    early_stopping: bool = True,
) -> RetrainResult:
    """One cycle. Every run is recorded; its number is never used again.

    A champion that cannot be loaded is an error unless promotion is forced: counting it as zero
    would let any challenger replace it.
    """
    spark = transactions.sparkSession
    runs_path = f"{model_root}/_runs"
    runs = read_runs(spark, runs_path)
    version = reserve_version(spark, runs_path, runs)

    train_rows, test_rows = temporal_split(transactions)
    window = recent_window(train_rows, settings.training_window_steps)
    train = store(engineer_features(window, velocity_mode), "retrain-features")
    test = store(engineer_features(test_rows, velocity_mode), "retrain-test")
    fit_on, validation = held_out_steps(train) if early_stopping else (train, None)
    contenders = {"challenger": train_boosted(fit_on, validation, params)}
    current = champion(runs).first()
    if current is not None:
        old = _champion_model(spark, model_root, current["version"], force_promote)
        contenders |= {"champion": old} if old is not None else {}
    scores = score_contenders(test, contenders)
    new_score, champion_score = scores["challenger"], scores.get("champion", 0.0)

    improvement = new_score - champion_score
    promoted = is_promotion(
        new_score, champion_score, settings.min_pr_auc_improvement, force_promote
    )
    if promoted:
        save_model(spark, contenders["challenger"], model_root, version)
    append_run(
        spark, runs_path, version, new_score, improvement, trigger, drift_score, promoted
    )
    return RetrainResult(version, new_score, champion_score, improvement, promoted, trigger)


def _champion_model(spark: SparkSession, root: str, version: str, forced: bool):
    """The champion's model; none if it cannot be loaded and promotion is forced anyway."""
    try:
        return load_model(spark, root, version)
    except (AnalysisException, Py4JJavaError):  # no such folder, or files that can't be read
        if forced:
            return None
        raise


def score_contenders(test: DataFrame, contenders: dict) -> dict[str, float]:
    """Average precision of each model over the same rows, read once for all of them."""
    rows, pairs = test, []
    for name, model in contenders.items():
        rows = add_scores(rows, model, f"score_{name}")
        pairs.append(
            F.struct(F.lit(name).alias("contender"), F.col(f"score_{name}").alias("risk_score"))
        )
    scored = rows.select("isFraud", F.inline(F.array(*pairs)))
    found = average_precision(scored, ["contender"]).collect()  # a row for each model
    return {row["contender"]: row["pr_auc"] for row in found}


def main() -> None:
    parser = add_input_arguments(argparse.ArgumentParser(description=__doc__))
    settings = Settings.from_env()
    # The job's published flags.
    flags = {
        "--models": {"required": True},
        "--trigger": {"default": "manual", "choices": TRIGGERS},
        "--drift-score": {"type": float},
        "--force-promote": {"action": "store_true"},
        "--window": {"type": int, "default": settings.training_window_steps},
        "--rounds": {"type": int, "default": BoostingParams.rounds},
    }
    for flag, options in flags.items():
        parser.add_argument(flag, **options)
    args = parser.parse_args()

    spark = session("retrain")
    result = run(
        read_input(spark, args.input, args.format),
        args.models,
        args.trigger,
        args.drift_score,
        args.force_promote,
        Settings(**{**asdict(settings), "training_window_steps": args.window}),
        BoostingParams(rounds=args.rounds),
    )
    print(asdict(result))


if __name__ == "__main__":
    main()
