"""From scores to decisions and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import (
    contributions_map,
    decision_of,
    is_flagged,
    top_contributions,
)
from riskloom.schemas import CONTRIBUTIONS, DECISIONS
from riskloom.settings import Settings


def add_decision(df: DataFrame, settings: Settings = Settings(), score: str = "risk_score"):
    return df.withColumn(
        "decision", decision_of(score, settings.review_threshold, settings.block_threshold)
    )


def flagged(df: DataFrame) -> DataFrame:
    return df.where(is_flagged())


def decision_mix(df: DataFrame) -> DataFrame:
    """Count and percentage of every decision, zero for one that never occurred."""
    counted = df.agg(
        F.count(F.lit(1)).alias("__all"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS],
    )
    return counted.unpivot(["__all"], list(DECISIONS), "decision", "rows").select(
        "decision",
        "rows",
        F.when(F.col("__all") == 0, 0.0)
        .otherwise(F.lit(100.0) * F.col("rows") / F.col("__all"))
        .alias("percent"),
    )


def decision_report(df: DataFrame, by: tuple[str, ...] = ("type",)) -> DataFrame:
    """Decisions by transaction type, or other columns: rows, money, fraud rate."""
    return df.groupBy(*by, "decision").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.sum(F.rint(F.col("amount") * 100).cast("long")).cast("double") / 100.0).alias(
            "total_amount"
        ),
        F.avg("isFraud").alias("fraud_rate"),
    )


def to_decision_records(df: DataFrame, top_k: int = 3) -> DataFrame:
    """The published record: rounded numbers, top contributions as a map.

    `contributions` and `latency_ms` are optional input columns.
    """
    parts = (
        top_contributions("contributions", top_k)
        if "contributions" in df.columns
        else F.array().cast(CONTRIBUTIONS)
    )
    latency = F.col("latency_ms") if "latency_ms" in df.columns else F.lit(None).cast("double")
    return df.select(
        "step",
        "nameOrig",
        "nameDest",
        "amount",
        "type",
        F.round("risk_score", 4).alias("risk_score"),
        "decision",
        contributions_map(F.coalesce(parts, F.array().cast(CONTRIBUTIONS))).alias("top_features"),
        F.round(latency, 2).alias("latency_ms"),
        F.col("isFraud").alias("is_fraud_ground_truth"),
    )


def interesting_cases(df: DataFrame, min_score: float = 0.05, n: int = 10) -> DataFrame:
    """First `n` rows in replay order above a score, with the strongest factor when known."""
    hits = df.where(F.col("risk_score") > min_score).orderBy("step", "event_id").limit(n)
    columns = [
        F.col(c) for c in ("event_id", "step", "type", "amount", "risk_score", "decision")
    ]
    columns.append(F.when(F.col("isFraud") == 1, "[FRAUD]").otherwise("").alias("label"))
    if "contributions" in df.columns:
        top = F.get(top_contributions("contributions", 1), F.lit(0))
        columns += [top["feature"].alias("top_factor"), top["value"].alias("top_value")]
    return hits.select(*columns)


def first_frauds(df: DataFrame, n: int = 3) -> DataFrame:
    return df.where(F.col("isFraud") == 1).orderBy("event_id").limit(n)


def log_decisions(df: DataFrame, path: str, steps_per_folder: int = 24) -> None:
    """Append decision log rows below `path`, one folder per step bucket."""
    (
        df.select(
            "step",
            "nameOrig",
            "type",
            F.round("amount", 2).alias("amount"),
            F.round("risk_score", 4).alias("risk_score"),
            "decision",
            F.round("latency_ms", 1).alias("latency_ms"),
        )
        .withColumn("step_bucket", F.floor((F.col("step") - 1) / steps_per_folder).cast("int"))
        .write.mode("append")
        .partitionBy("step_bucket")
        .parquet(path)
    )


def compare_scores(df: DataFrame, champion: str, challenger: str, settings=Settings()):
    """Two score columns on the same rows: how the decisions agree, with the row share."""
    bands = (settings.review_threshold, settings.block_threshold)
    counted = df.groupBy(
        decision_of(champion, *bands).alias("champion_decision"),
        decision_of(challenger, *bands).alias("challenger_decision"),
    ).agg(F.count(F.lit(1)).alias("rows"))
    # At most nine rows are left here.
    return counted.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))
