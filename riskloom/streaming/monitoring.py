"""Monitoring of a decisions stream: alerts and drift checks every so many rows.

Rows are numbered by arrival, on from the batch before, and every point and window that a batch
completes is checked, grouped by its number. So the reports are the same for any cutting of a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.drift import drift_summary, ks_by_window
from riskloom.operators.monitor import (
    WINDOW_ROWS,
    alerts,
    lifetime_counts,
    numbered,
    summary_by_point,
)
from riskloom.settings import Settings
from riskloom.sources.workspace import read_or_empty, remove_path

ALERT_EVERY = 1000


def start_monitor(
    decisions: DataFrame,
    reference: DataFrame,
    state_path: str,
    report_path: str,
    checkpoint: str,
    settings: Settings = Settings(),
    alert_every: int = ALERT_EVERY,
    trigger: dict | None = None,
):
    """Stream of scored rows (features, risk_score, decision, latency_ms, event_id) -> reports.

    After each `alert_every` rows the newest WINDOW_ROWS are looked at for alerts; each window of
    `drift_window_size` rows is tested against `reference`. Between batches two bounded things are
    kept, one folder per batch each: the rows that a later window may still need, and one row of
    counts. A repeated batch reads the folders of the batch before and replaces its own; older ones
    are removed.
    """
    width = settings.drift_window_size
    kept_rows = max(width, WINDOW_ROWS)

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        stored = rows.persist()
        try:
            own = lifetime_counts(stored)
            earlier = read_or_empty(spark, f"{state_path}/counts/batch={batch_id - 1}", own.schema)
            before = earlier.agg(F.coalesce(F.max("__all"), F.lit(0))).first()[0]
            placed = numbered(stored, before, f"{state_path}/arrived/batch={batch_id}")
            window = read_or_empty(
                spark, f"{state_path}/window/batch={batch_id - 1}", placed.schema
            )
            recent = window.unionByName(placed).persist()
            (
                earlier.unionByName(own)
                .agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in own.columns])
                .write.mode("overwrite")
                .parquet(f"{state_path}/counts/batch={batch_id}")
            )
            counts = spark.read.parquet(f"{state_path}/counts/batch={batch_id}")
            after = counts.first()["__all"]
            recent.where(F.col("number") > after - kept_rows).write.mode("overwrite").parquet(
                f"{state_path}/window/batch={batch_id}"
            )
            if after // alert_every > before // alert_every:
                summary = summary_by_point(
                    recent,
                    after // alert_every * alert_every,
                    alert_every,
                    WINDOW_ROWS,
                    before,
                    earlier,
                )
                alerts(summary).write.mode("overwrite").parquet(
                    f"{report_path}/alerts/batch={batch_id}"
                )
            if after // width > before // width:
                first, last = before // width, after // width - 1
                number = F.floor((F.col("number") - 1) / width).cast("long")
                current = recent.withColumn("window", number).where(
                    F.col("window").between(first, last)
                )
                tested = f"{report_path}/drift_features/batch={batch_id}"
                ks_by_window(reference, current, first, last).write.mode("overwrite").parquet(tested)
                tests = spark.read.parquet(tested)
                drift_summary(tests, settings.drift_threshold, ["window"]).write.mode(
                    "overwrite"
                ).parquet(f"{report_path}/drift_summary/batch={batch_id}")
            recent.unpersist()
            remove_path(spark, f"{state_path}/arrived/batch={batch_id}")
            for kind in ("counts", "window"):
                remove_path(spark, f"{state_path}/{kind}/batch={batch_id - 2}")
        finally:
            stored.unpersist()

    return (
        decisions.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
