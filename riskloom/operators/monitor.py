"""Watching scored rows: last-N window, alerts, progress per thousand, published totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import is_flagged, ratio
from riskloom.operators.limits import first_rows
from riskloom.operators.running import running_totals
from riskloom.schemas import DECISIONS
from riskloom.sources.workspace import fresh_path

WINDOW_ROWS = 10_000
BATCH_ROWS = 1000
BASELINE_BLOCK_RATE = 0.001
BLOCK_RATE_FACTOR = 10
LATENCY_LIMIT_MS = 100.0


def newest_first(df: DataFrame) -> list[str]:
    """Columns that say which row is newer: time of arrival if there is one, else the id.

    Ids of a topic have its partition in front, so only their arrival puts partitions in order.
    """
    return ["arrived_at", "event_id"] if "arrived_at" in df.columns else ["event_id"]


def last_rows(df: DataFrame, n: int = WINDOW_ROWS) -> DataFrame:
    """The newest `n` rows. The window size is the feature."""
    if "arrived_at" not in df.columns:
        return first_rows(df, n, ["event_id"], bits=16, newest=True)
    timed = df.withColumn("__arrived", F.unix_micros("arrived_at"))
    return first_rows(timed, n, ["__arrived", "event_id"], bits=20, newest=True).drop("__arrived")


def lifetime_counts(df: DataFrame) -> DataFrame:
    """One row: rows of each decision and of all decisions."""
    return df.agg(*_decision_counts())


def _decision_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("__all"),
        *[F.count_if(F.col("decision") == d).alias(f"{d.lower()}_count") for d in DECISIONS],
    ]


def monitor_summary(
    df: DataFrame, window_rows: int = WINDOW_ROWS, lifetime: DataFrame | None = None
) -> DataFrame:
    """One row: score and latency figures of the window, decision rates of all rows.

    Percentiles are over at most `window_rows` rows, so Spark's exact one fits. `lifetime` gives the
    counts when `df` holds recent rows only.
    """
    if lifetime is None:
        lifetime = lifetime_counts(df)
    needed = df.select(*newest_first(df), "risk_score", "latency_ms")
    recent = last_rows(needed, window_rows).agg(*_window_figures())
    merged = recent.unionByName(lifetime, allowMissingColumns=True)
    return _figures(merged.agg(*[F.max(c).alias(c) for c in merged.columns]))


def _window_figures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("window_size"),
        F.avg("risk_score").alias("score_mean"),
        F.percentile("risk_score", F.lit(0.95)).alias("score_p95"),
        F.percentile("risk_score", F.lit(0.99)).alias("score_p99"),
        F.percentile("latency_ms", F.lit(0.5)).alias("latency_p50_ms"),
        F.percentile("latency_ms", F.lit(0.99)).alias("latency_p99_ms"),
    ]


def _figures(row: DataFrame, *kept: str) -> DataFrame:
    return row.select(
        *kept,
        F.when(F.col("window_size") == 0, "no data").otherwise("ok").alias("status"),
        "window_size",
        "score_mean",
        "score_p95",
        "score_p99",
        *[
            ratio(F.col(f"{d.lower()}_count"), F.col("__all")).alias(f"{d.lower()}_rate")
            for d in reversed(DECISIONS)
        ],
        "latency_p50_ms",
        "latency_p99_ms",
        *[f"{d.lower()}_count" for d in DECISIONS],
    )


def numbered(df: DataFrame, before: int = 0, path: str | None = None) -> DataFrame:
    """Rows with `number`, their place from the oldest on, counted from `before` + 1.

    Rows are dealt by range of their order and written once (to `path`, or else below the shared
    folder), so that their ranges stand; each range is counted by itself, and the totals carried down.
    """
    spark, order = df.sparkSession, newest_first(df)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or fresh_path(spark, "numbered")
    ranged = df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(path)
    dealt = spark.read.schema(ranged.schema).parquet(path)
    counted = running_totals(
        dealt.withColumn("__one", F.lit(1)), ["__one"], order, [["__range"]]
    )
    return counted.select(*df.columns, (F.col("__one_before") + before + 1).alias("number"))


def summary_by_point(
    rows: DataFrame,
    last: int,
    every: int = BATCH_ROWS,
    window_rows: int = WINDOW_ROWS,
    before: int = 0,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """The summary after each `every` numbered rows up to row `last`, with `rows_seen`.

    `rows` (see `numbered`) has the new rows, those above `before`, and at least `window_rows` earlier
    ones if there are as many; `earlier` has the lifetime counts of all rows up to `before`. A row is
    in the windows of window_rows / every points, so it is copied so many times; each window is then
    a group of at most `window_rows` rows.
    """
    first = (before // every + 1) * every
    point = (F.ceil(F.col("number") / every) * every).cast("long")
    start = F.greatest(point, F.lit(first).cast("long"))
    end = F.least(F.col("number") + (window_rows - 1), F.lit(last).cast("long"))
    windows = (
        rows.select("risk_score", "latency_ms", start.alias("start"), end.alias("end"))
        .where("start <= end")
        .select(
            "risk_score",
            "latency_ms",
            F.explode(F.sequence("start", "end", F.lit(every).cast("long"))).alias("rows_seen"),
        )
        .groupBy("rows_seen")
        .agg(*_window_figures())
    )
    new = rows.where((F.col("number") > before) & (point <= last))
    per_point = new.groupBy(point.alias("rows_seen")).agg(*_decision_counts())
    names = [c for c in per_point.columns if c != "rows_seen"]
    so_far = Window.orderBy("rows_seen").rowsBetween(Window.unboundedPreceding, 0)
    if earlier is not None:  # one row ahead of all points
        per_point = per_point.unionByName(
            earlier.select(F.lit(-1).cast("long").alias("rows_seen"), *names)
        )
    # One row for each point: as many as the report has.
    life = per_point.select(
        "rows_seen", *[F.sum(c).over(so_far).cast("long").alias(c) for c in names]
    ).where("rows_seen > 0")
    return _figures(windows.join(life, "rows_seen"), "rows_seen")


def alerts(summary: DataFrame, baseline: float = BASELINE_BLOCK_RATE) -> DataFrame:
    """First matching alert of a summary: block rate, then latency; no row when all is well.

    A summary of several points keeps its `rows_seen`.
    """
    limit = baseline * BLOCK_RATE_FACTOR
    blocked = F.col("block_rate") > limit
    slow = F.col("latency_p99_ms") > LATENCY_LIMIT_MS
    return (
        summary.where(F.col("status") == "ok")
        .where(blocked | slow)
        .select(
            *[c for c in summary.columns if c == "rows_seen"],
            F.when(blocked, "block_rate").otherwise("latency").alias("alert"),
            F.when(blocked, F.col("block_rate")).otherwise(F.col("latency_p99_ms")).alias("value"),
            F.when(blocked, F.lit(limit)).otherwise(F.lit(LATENCY_LIMIT_MS)).alias("limit"),
            F.when(
                blocked,
                F.format_string(
                    "block rate %.2f%% is over %.2f%%", F.col("block_rate") * 100, F.lit(limit * 100)
                ),
            )
            .otherwise(
                F.format_string(
                    "p99 latency %.1f ms is over %.1f ms",
                    F.col("latency_p99_ms"),
                    F.lit(LATENCY_LIMIT_MS),
                )
            )
            .alias("message"),
        )
    )


def progress_batches(df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """One row per full batch in event order: rows and flagged rows so far, p99 latency of the batch.

    The p99 is the nearest rank from the top: of 1000 latencies, the tenth largest. Row numbers come
    from running totals over slices of event_id, so no task numbers the whole table; a batch itself
    holds `batch_rows` rows by construction.
    """
    rows = df.select(
        "event_id",
        "latency_ms",
        F.lit(1).alias("one"),
        is_flagged().cast("int").alias("hit"),
    ).withColumns(
        {
            "__s1": F.shiftright("event_id", 16),
            "__s2": F.shiftright("event_id", 32),
        }
    )
    placed = running_totals(rows, ["one", "hit"], ["event_id"], [["__s1"], ["__s2"]])
    batch = F.floor(F.col("one_before") / batch_rows).cast("long")
    rank = max(1, int(batch_rows * 0.01))
    return (
        placed.withColumn("batch", batch)
        .groupBy("batch")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max(F.col("hit_before") + F.col("hit")).alias("flagged"),
            F.element_at(
                F.sort_array(F.collect_list("latency_ms"), asc=False), rank
            ).alias("p99_latency_ms"),
        )
        .where(F.col("rows") == batch_rows)
        .select(
            ((F.col("batch") + 1) * batch_rows).alias("processed"), "flagged", "p99_latency_ms"
        )
    )


def published_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("published"),
        F.count_if(F.col("isFraud") == 1).alias("frauds"),
    )
