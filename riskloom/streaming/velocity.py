"""Velocity over a stream: totals in Spark's keyed state, counting by the batch operator.

A stream carries two things side by side: its rows as they are, and the totals of each (step, account)
they touch. The totals are a streaming aggregation with a watermark on the step's time, so Spark keeps
them in its state store (RocksDB) under the query's checkpoint, expires them when the watermark has
passed, and brings them back after a failure. A busy account is added up in each task before the
shuffle, one row a task, however many rows it has.

Each micro-batch hands both to `split_batch`. Totals as they are after the batch, less what the batch
itself holds, are what came before it; the batch operator takes them along and cuts busy accounts into
slices exactly as in batch. So the stream of any cutting equals the batch result as long as rows come
in order. Rows of a step more than `ttl_steps` behind the newest step of earlier batches are late: the
aggregation drops them, so they have no totals, count from zero within their batch, and can be written
to a table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.features import account_sides, add_velocity_shared
from riskloom.operators.running import HOT_ROWS
from riskloom.sources.workspace import fresh_path, remove_path

TOTALS_SCHEMA = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("account", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("c", T.LongType()),
    ]
)
STEP_SECONDS = 3600
#: Name of the observation that counts the rows of each micro-batch: both parts of the stream read
#: the source, so Spark's own count of input rows has each of them twice.
ARRIVED = "arrived"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"
#: A stream's state has a part for each core, and so many at least: a part is a store to open and to
#: commit for each micro-batch, and holds little, as totals expire after a few steps.
LEAST_STATE_PARTS = 8


def use_keyed_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, unless the session names a provider already, and commit what
    a batch has changed instead of a whole snapshot, unless the session says otherwise."""
    if not spark.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKSDB)
    if spark.conf.get(_CHANGELOG, None) is None:
        spark.conf.set(_CHANGELOG, "true")


@contextmanager
def state_parts(spark: SparkSession) -> Iterator[None]:
    """A query started meanwhile keeps its state in a part for each core, or in as many as the session
    has shuffle partitions if those are fewer. A restarted query stays with what its checkpoint says."""
    before = spark.conf.get(_PARTITIONS)
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set(_PARTITIONS, str(min(int(before), max(LEAST_STATE_PARTS, cores))))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, before)


def step_time(step: Column) -> Column:
    """The middle of the hour that a step stands for."""
    return F.timestamp_seconds(step * STEP_SECONDS + STEP_SECONDS // 2)


def running_account_totals(rows: DataFrame, ttl_steps: int) -> DataFrame:
    """Stream of rows -> stream of (step, account, n, c) so far, of those a micro-batch touches.

    The delay ends between two steps: a step is alive until a step more than `ttl_steps` newer was
    seen by an earlier batch.
    """
    sides = account_sides(rows).withColumn("at", step_time(F.col("step")))
    delay = f"{ttl_steps * STEP_SECONDS + STEP_SECONDS // 4} seconds"
    return (
        sides.withWatermark("at", delay)
        .groupBy("at", "step", "account")
        .agg(F.sum("n").cast("long").alias("n"), F.sum("c").cast("long").alias("c"))
        .select(*TOTALS_SCHEMA.names)
    )


def with_totals(rows: DataFrame, accepted: DataFrame | None = None, ttl_steps: int = 2) -> DataFrame:
    """The stream for `split_batch`: all of `rows`, and the totals of `accepted` (all, if not given),
    which comes from the same source. To be written in update mode."""
    use_keyed_state(rows.sparkSession)
    seen = rows.observe(ARRIVED, F.count(F.lit(1)).alias("rows"))
    kept = seen.select(
        F.struct(*rows.columns).alias("row"), F.lit(None).cast(TOTALS_SCHEMA).alias("totals")
    )
    totals = running_account_totals(rows if accepted is None else accepted, ttl_steps)
    row_type = kept.schema["row"].dataType
    return kept.unionByName(
        totals.select(
            F.lit(None).cast(row_type).alias("row"), F.struct(*TOTALS_SCHEMA.names).alias("totals")
        )
    )


@dataclass(frozen=True)
class StreamBatch:
    """Rows of a micro-batch, and the totals after it of each (step, account) that is alive."""

    rows: DataFrame
    totals: DataFrame

    def living_steps(self) -> DataFrame:
        """Steps that are not late; at most as many as a stream's batch has hours."""
        return F.broadcast(self.totals.select("step").distinct())

    def late(self) -> DataFrame:
        """Rows that came after their totals had expired."""
        return self.rows.join(self.living_steps(), "step", "left_anti").select(*self.rows.columns)


@contextmanager
def stored_batch(made: DataFrame, session: SparkSession) -> Iterator[DataFrame]:
    """A micro-batch as a table in the shared folder, for as long as it is worked on, read by the
    session that started the stream.

    A stream's own session plans without adaptive execution: every shuffle after a micro-batch would
    take as many tasks as the state has partitions, however few rows there are, and a lost executor
    would run the stateful step again.
    """
    path = fresh_path(session, "micro-batch")
    try:
        made.write.parquet(path)
        yield session.read.schema(made.schema).parquet(path)
    finally:
        remove_path(session, path)


def split_batch(batch: DataFrame) -> StreamBatch:
    """A micro-batch of `with_totals`; it is read several times, so pass a stored one."""
    return StreamBatch(
        batch.where("row is not null").select("row.*"),
        batch.where("totals is not null").select("totals.*"),
    )


def totals_before(batch: StreamBatch, rows: DataFrame | None = None) -> DataFrame:
    """(step, account, n, c) of earlier batches: what there is after this one, less its own rows."""
    own = account_sides(batch.rows if rows is None else rows).join(
        batch.living_steps(), "step", "left_semi"
    )
    own = own.select("step", "account", (-F.col("n")).cast("long").alias("n"), (-F.col("c")).alias("c"))
    return (
        batch.totals.unionByName(own)
        .groupBy("step", "account")
        .agg(F.sum("n").cast("long").alias("n"), F.sum("c").cast("long").alias("c"))
        .where("n <> 0")
    )


def add_stream_velocity(
    rows: DataFrame, batch: StreamBatch, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Velocity of the rows of one micro-batch that were counted in its totals."""
    return add_velocity_shared(rows, hot_rows, carried=totals_before(batch, rows))


def start_velocity(
    stream: DataFrame,
    sink_path: str,
    checkpoint: str,
    ttl_steps: int = 2,
    hot_rows: int | None = HOT_ROWS,
    trigger: dict | None = None,
    late_path: str | None = None,
):
    """Stream of transactions -> table of transactions with shared velocity, one folder per batch.

    Late rows are in that table, and alone in the one below `late_path` if it is given. A repeated
    batch gets the same state again and replaces its own folders.
    """

    def one_batch(made: DataFrame, batch_id: int) -> None:
        with stored_batch(made, stream.sparkSession) as stored:
            if stored.isEmpty():  # a batch that only expires state
                return
            batch = split_batch(stored)
            enriched = add_stream_velocity(batch.rows, batch, hot_rows)
            enriched.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")
            if late_path:
                batch.late().write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")

    writer = (
        with_totals(stream, ttl_steps=ttl_steps)
        .writeStream.outputMode("update")
        .foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    with state_parts(stream.sparkSession):
        return writer.start()
