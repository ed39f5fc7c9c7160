"""Append-only table of model runs, champion lookup, version numbers and the promotion rule."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.schemas import RUN_SCHEMA
from riskloom.sources.workspace import create_if_absent, read_or_empty

# Two scores that differ by exactly the margin in decimal may differ by less in binary.
TOLERANCE = 1e-12
TRIGGERS = ("scheduled", "drift", "manual")


def append_run(
    spark: SparkSession,
    path: str,
    version: str,
    pr_auc: float,
    improvement: float,
    trigger: str,
    drift_score: float | None,
    promoted: bool,
    trained_at: datetime | None = None,
) -> None:
    if trigger not in TRIGGERS:
        raise ValueError(f"unknown trigger {trigger!r}")
    row = (
        version,
        float(pr_auc),
        float(improvement),
        trigger,
        None if drift_score is None else float(drift_score),
        bool(promoted),
        trained_at or datetime.now(timezone.utc),
    )
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs; an empty table when none was recorded yet."""
    return read_or_empty(spark, path, RUN_SCHEMA)


def champion(runs: DataFrame) -> DataFrame:
    """The promoted run trained last, or no row."""
    whole = F.struct(*[F.col(c) for c in runs.columns])
    return (
        runs.where("promoted")
        .agg(F.max_by(whole, F.struct("trained_at", "version")).alias("run"))
        .where(F.col("run").isNotNull())
        .select("run.*")
    )


def next_version(runs: DataFrame) -> DataFrame:
    """One row: v<n+1> after the largest numbered version, v1 without any."""
    number = F.regexp_extract("version", "^v([0-9]+)$", 1)
    largest = F.max(F.when(number != "", number.cast("int")))
    return runs.agg(
        F.concat(F.lit("v"), (F.coalesce(largest, F.lit(0)) + 1).cast("string")).alias(
            "next_version"
        )
    )


def reserve_version(spark: SparkSession, path: str, runs: DataFrame) -> str:
    """The next version number, taken: no other run gets it, also one that asks at the same time.

    A number is taken by creating its marker below `path`, which only succeeds if there was none; whoever
    comes second goes on to the next number. Markers stay, as numbers are never used again.
    """
    number = int(next_version(runs).first()["next_version"].removeprefix("v"))
    while not create_if_absent(spark, f"{path}/_versions/v{number}"):
        number += 1
    return f"v{number}"


def promotes(
    challenger: Column, champion_score: Column, min_improvement: float = 0.005, force: bool = False
) -> Column:
    """A missing champion counts as 0."""
    better = challenger - F.coalesce(champion_score, F.lit(0.0))
    return F.lit(force) | (better >= min_improvement - TOLERANCE)


def is_promotion(
    challenger: float, champion_score: float, min_improvement: float = 0.005, force: bool = False
) -> bool:
    return force or challenger - champion_score >= min_improvement - TOLERANCE


def should_retrain(summary: DataFrame) -> DataFrame:
    """Drift summary -> (retrain, trigger, drift_score), the parameters of a retraining job."""
    return summary.select(
        F.col("is_drifted").alias("retrain"),
        F.when(F.col("is_drifted"), "drift").alias("trigger"),
        F.col("drift_ratio").alias("drift_score"),
    )
