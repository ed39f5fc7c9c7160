"""Transaction tables: file scans, time split, ordered replay, and the view derived from `events`."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import money
from riskloom.operators.limits import first_rows
from riskloom.operators.running import running_totals
from riskloom.operators.validate import valid_rows
from riskloom.schemas import FILE_SCHEMA, SNAKE_NAMES, TRAIN_MAX_STEP, TXN_COLUMNS, TXN_SCHEMA
from riskloom.sources.workspace import fresh_path

EPOCH = "2024-01-01 00:00:00"


def read_csv(spark: SparkSession, path: str, with_event_id: bool = True) -> DataFrame:
    """Header CSV with a declared schema: no inference pass over the file."""
    schema = TXN_SCHEMA if with_event_id else FILE_SCHEMA
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TXN_SCHEMA).parquet(path)


def import_csv(spark: SparkSession, path: str, table: str) -> None:
    """Store CSV files without ids as a partitioned table, their order becoming `event_id`.

    The order is by file name, then by place in the file. A row's place is the block of the file it
    was read from and its position in the scan; the rows of earlier blocks are counted, so ids run
    from 0 without gaps. Read the stored table afterwards: another scan could be cut differently.
    """
    rows = read_csv(spark, path, with_event_id=False)
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__scan"),
    )
    stored = fresh_path(spark, "import")
    placed.write.parquet(stored)
    numbered = running_totals(
        spark.read.parquet(stored).withColumn("__one", F.lit(1)),
        ["__one"],
        ["__file", "__block", "__scan"],
        [["__file", "__block"], ["__file"]],
    )
    ids = numbered.withColumn("event_id", F.col("__one_before"))
    write_partitioned(ids.select(*TXN_COLUMNS), f"{table}/by_step")


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stored transactions as a stream, oldest file first, in batches of a bounded number of files."""
    reader = spark.readStream.schema(TXN_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_partitioned(df: DataFrame, path: str, steps_per_folder: int = 24) -> None:
    """Store by step bucket, so a split or window on `step` prunes folders.

    Rows of one bucket are spread over as many tasks as they fill; `step` inside the files still
    gives tight row-group statistics because each file is sorted on it.
    """
    bucket = F.floor((F.col("step") - 1) / steps_per_folder).cast("int")
    (
        df.withColumn("step_bucket", bucket)
        .repartitionByRange("step_bucket", "step", "event_id")
        .sortWithinPartitions("step_bucket", "step", "event_id")
        .write.partitionBy("step_bucket")
        .parquet(path)
    )


def read_partitioned(
    spark: SparkSession,
    path: str,
    min_step: int | None = None,
    max_step: int | None = None,
    steps_per_folder: int = 24,
) -> DataFrame:
    """Rows of a step range: folders are pruned by bucket, row groups by `step`."""
    df = spark.read.parquet(path)
    if min_step is not None:
        df = df.where(
            (F.col("step_bucket") >= (min_step - 1) // steps_per_folder)
            & (F.col("step") >= min_step)
        )
    if max_step is not None:
        df = df.where(
            (F.col("step_bucket") <= (max_step - 1) // steps_per_folder)
            & (F.col("step") <= max_step)
        )
    return df.select(*TXN_COLUMNS)


def rename(df: DataFrame, names: Mapping[str, str] = SNAKE_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def to_wire_names(df: DataFrame) -> DataFrame:
    """Accept snake_case tables too: both spellings mean the same field."""
    return rename(df, {v: k for k, v in SNAKE_NAMES.items()})


def split(df: DataFrame, name: str = "test", boundary: int = TRAIN_MAX_STEP) -> DataFrame:
    """Time split: `train` up to the boundary step, `test` after it, anything else is all rows."""
    if name == "train":
        return df.where(F.col("step") <= boundary)
    if name == "test":
        return df.where(F.col("step") >= boundary + 1)
    return df


def temporal_split(df: DataFrame, boundary: int = TRAIN_MAX_STEP) -> tuple[DataFrame, DataFrame]:
    return split(df, "train", boundary), split(df, "test", boundary)


def replay(df: DataFrame, name: str = "test", max_events: int | None = None) -> DataFrame:
    """Valid rows of a split in replay order; the cap counts valid rows only."""
    rows = valid_rows(split(df, name))
    if max_events is None:
        return rows.orderBy("step", "event_id")
    return first_rows(rows, max_events, ["step", "event_id"])


def replay_positions(df: DataFrame, name: str = "test") -> DataFrame:
    """The replay order as a 1-based column, without sorting the table in one place."""
    rows = (
        valid_rows(split(df, name))
        .withColumn("__one", F.lit(1))
        .withColumn("__slice", F.shiftright("event_id", 16))
    )
    placed = running_totals(
        rows, ["__one"], ["step", "event_id"], [["step", "__slice"], ["step"]]
    )
    return placed.withColumn("position", F.col("__one_before") + 1).drop(
        "__one", "__slice", "__one_before"
    )


def labelled_fraud(df: DataFrame, name: str = "test") -> DataFrame:
    return valid_rows(split(df, name)).where(F.col("isFraud") == 1)


def from_events(
    events: DataFrame, min_step: int | None = None, max_step: int | None = None
) -> DataFrame:
    """Transactions derived from an `events` table (event_id, ts, user_id, event_type, value, props).

    A step range is turned into a range of `ts`, which the parquet scan can use to skip data.
    """
    epoch = F.expr(f"timestamp_ntz'{EPOCH}'")
    ts = F.col("ts").cast("timestamp_ntz")
    if min_step is not None:
        events = events.where(
            F.col("ts") >= F.expr(f"timestamp_ntz'{EPOCH}' + INTERVAL {min_step - 1} HOUR")
        )
    if max_step is not None:
        events = events.where(
            F.col("ts") < F.expr(f"timestamp_ntz'{EPOCH}' + INTERVAL {max_step} HOUR")
        )

    eid = F.col("event_id")
    types = F.create_map(
        *[
            F.lit(x)
            # Which event becomes which transaction type.
            for x in (
                "click", "PAYMENT",
                "purchase", "TRANSFER",
                "error", "CASH_OUT",
                "view", "CASH_IN",
                "signup", "DEBIT",
            )
        ]
    )
    hundreds = F.col("value") * 100
    # Half away from zero, without the decimal detour that `round` takes.
    whole_cents = (F.floor(F.abs(hundreds) + 0.5) * F.signum(hundreds)).cast("long")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    base = events.select(
        eid,
        # Interval arithmetic on local times: whole hours, whatever the session's time zone.
        ((ts - epoch).cast("interval hour").cast("long") + 1).alias("step"),
        F.element_at(types, F.col("event_type")).alias("type"),
        whole_cents.alias("amt_c"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        F.concat(F.lit("C"), ((F.col("user_id") * 7 + k) % 150).cast("string")).alias("nameDest"),
        ((eid * 7919) % 60000).alias("oo_c"),
        ((eid * 104729) % 60000).alias("od_c"),
    )
    new_orig = F.greatest(F.col("oo_c") - F.col("amt_c"), F.lit(0))
    kept = (F.col("type") == "TRANSFER") & (eid % 3 == 0)
    new_dest = F.when(kept, F.col("od_c")).otherwise(F.col("od_c") + F.col("amt_c"))
    fraud = (
        F.col("type").isin("TRANSFER", "CASH_OUT")
        & (F.col("oo_c") < F.col("amt_c"))
        & (eid % 5 == 0)
    )
    flagged = (F.col("type") == "TRANSFER") & (F.col("amt_c") > 20000)
    return base.select(
        "event_id",
        "step",
        "type",
        money("amt_c").alias("amount"),
        "nameOrig",
        money("oo_c").alias("oldbalanceOrg"),
        money(new_orig).alias("newbalanceOrig"),
        "nameDest",
        money("od_c").alias("oldbalanceDest"),
        money(new_dest).alias("newbalanceDest"),
        F.when(fraud, 1).otherwise(0).alias("isFraud"),
        F.when(flagged, 1).otherwise(0).alias("isFlaggedFraud"),
    )


def add_standin_score(df: DataFrame) -> DataFrame:
    """Deterministic score and latency, so evaluation and monitoring can be checked without a model."""
    eid = F.col("event_id")
    risky = F.col("type").isin("TRANSFER", "CASH_OUT").cast("int")
    score = F.least(F.lit(999), (eid * 7907) % 700 + 250 * F.col("isFraud") + 40 * risky)
    return df.withColumns(
        {
            "risk_score": score.cast("double") / 1000,
            "latency_ms": ((eid * 613) % 1200).cast("double") / 10,
        }
    )
