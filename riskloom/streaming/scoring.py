"""Continuous scoring: decode, validate, count velocity, score, decide, explain, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.operators.decisions import add_decision, to_decision_records
from riskloom.operators.explain import EXPLAIN_FROM, Explainer, add_contributions
from riskloom.operators.features import add_balance_errors, add_type_dummies
from riskloom.operators.model import add_scores
from riskloom.operators.running import HOT_ROWS
from riskloom.operators.validate import quarantined_rows, valid_rows
from riskloom.schemas import MODEL_FEATURES
from riskloom.settings import Settings
from riskloom.sources.topics import decision_messages, decode, sink_options
from riskloom.streaming.velocity import (
    TOTALS_SCHEMA,
    StreamBatch,
    add_stream_velocity,
    split_batch,
    state_parts,
    stored_batch,
    with_totals,
)

TOP_FEATURES = 3


@dataclass(frozen=True)
class ScoringPaths:
    """Where one scoring query keeps its decisions, rejects, late rows, scored rows, and its
    checkpoint with offsets and velocity totals."""

    decisions: str
    rejects: str
    late: str
    checkpoint: str
    scored: str

    @classmethod
    def below(cls, root: str) -> ScoringPaths:
        return cls(
            *(f"{root}/{n}" for n in ("decisions", "rejects", "late", "checkpoint", "scored"))
        )


def score_enriched(
    enriched: DataFrame,
    model: GBTClassificationModel,
    explainer: Explainer,
    settings: Settings = Settings(),
    explain_from: float = EXPLAIN_FROM,
) -> DataFrame:
    """Engineered rows -> risk_score, decision, contributions; all input columns kept."""
    scored = add_scores(enriched, model, keep_vector=True)
    return add_contributions(add_decision(scored, settings), explainer, explain_from).drop("features")


def score_batch(
    rows: DataFrame,
    batch: StreamBatch,
    model: GBTClassificationModel,
    explainer: Explainer,
    settings: Settings = Settings(),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One micro-batch of valid, stored transactions to scored rows (lazy)."""
    velocity = add_stream_velocity(rows, batch, hot_rows)
    features = velocity.transform(add_balance_errors).transform(add_type_dummies)
    scored = score_enriched(features, model, explainer, settings)
    if "arrived_at" in rows.columns:
        now = F.unix_micros(F.current_timestamp())
        scored = scored.withColumn("latency_ms", (now - F.unix_micros("arrived_at")) / 1000.0)
    return scored


def scored_fields(columns: list[str]) -> list[str]:
    """What the monitor needs of a scored row."""
    times = [c for c in ("event_id", "arrived_at", "latency_ms") if c in columns]
    return [*times, "step", *MODEL_FEATURES, "isFraud", "risk_score", "decision"]


def scored_schema(
    messages: DataFrame, model: GBTClassificationModel, explainer: Explainer
) -> StructType:
    """The schema of the scored rows, from a plan over no rows: no batch has to be there."""
    spark = messages.sparkSession
    keep = tuple(c for c in ("event_id", "arrived_at") if c in messages.columns)
    rows = valid_rows(decode(spark.createDataFrame([], messages.schema), keep=keep))
    batch = StreamBatch(rows, spark.createDataFrame([], TOTALS_SCHEMA))
    scored = score_batch(rows, batch, model, explainer, hot_rows=None)
    return scored.select(*scored_fields(scored.columns)).schema


def read_scored(
    spark: SparkSession, paths: ScoringPaths, schema: StructType | None = None
) -> DataFrame:
    """The scored rows as a stream, for `start_monitor`. With a `schema` it can be started before the
    first batch has been written."""
    schema = schema or spark.read.parquet(f"{paths.scored}/batch=*").schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1000)
        .parquet(f"{paths.scored}/batch=*")
    )


def start_scoring(
    messages: DataFrame,
    model: GBTClassificationModel,
    explainer: Explainer,
    paths: ScoringPaths,
    settings: Settings = Settings(),
    to_topic: bool = False,
    trigger: dict | None = None,
    hot_rows: int | None = HOT_ROWS,
):
    """Start the scoring query over (event_id, value) messages.

    Decisions go to a table with one folder per batch, which a repeated batch overwrites, and on
    request to the decisions topic (at least once). Offsets are committed by the checkpoint only
    after a batch is complete.
    """

    session = messages.sparkSession

    def one_batch(made: DataFrame, batch_id: int) -> None:
        with stored_batch(made, session) as stored:
            if stored.isEmpty():  # a batch that only expires state
                return
            batch = split_batch(stored)
            accepted = StreamBatch(valid_rows(batch.rows), batch.totals)
            scored = score_batch(accepted.rows, accepted, model, explainer, settings, hot_rows)
            target = f"{paths.decisions}/batch={batch_id}"
            with stored_batch(scored, session) as kept:
                to_decision_records(kept, TOP_FEATURES).write.mode("overwrite").parquet(target)
                kept.select(*scored_fields(kept.columns)).write.mode("overwrite").parquet(
                    f"{paths.scored}/batch={batch_id}"
                )
            quarantined_rows(batch.rows).write.mode("overwrite").parquet(
                f"{paths.rejects}/batch={batch_id}"
            )
            accepted.late().write.mode("overwrite").parquet(f"{paths.late}/batch={batch_id}")
            if to_topic:
                written = session.read.parquet(target)
                options = sink_options(settings.kafka_decisions_topic, settings)
                decision_messages(written).write.format("kafka").options(**options).save()

    keep = tuple(c for c in ("event_id", "arrived_at") if c in messages.columns)
    decoded = decode(messages, keep=keep)
    writer = (
        with_totals(decoded, valid_rows(decoded), settings.velocity_ttl_steps)
        .writeStream.outputMode("update")
        .foreachBatch(one_batch)
        .option("checkpointLocation", paths.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    with state_parts(session):
        return writer.start()
