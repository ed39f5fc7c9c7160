"""Message topics: connector options, and the JSON form of transactions and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import LongType, StructField, StructType

from riskloom.operators.monitor import published_totals
from riskloom.schemas import FILE_SCHEMA, WIRE_FIELDS
from riskloom.settings import Settings
from riskloom.sources.transactions import replay
from riskloom.sources.workspace import fresh_path, remove_path

# Bound of a micro-batch: offsets start at the earliest, so the first batch would be the backlog.
BATCH_RECORDS = 1_000_000
OFFSET_BITS = 44


def source_options(settings: Settings = Settings(), max_records: int = BATCH_RECORDS) -> dict:
    """`max_records` bounds a micro-batch; progress lives in the checkpoint, not in the group."""
    return {
        "kafka.bootstrap.servers": settings.kafka_bootstrap_servers,
        "subscribe": settings.kafka_transactions_topic,
        "startingOffsets": "earliest",
        "groupIdPrefix": settings.kafka_consumer_group,
        "failOnDataLoss": "true",
        "maxOffsetsPerTrigger": str(max_records),
    }


def sink_options(topic: str, settings: Settings = Settings()) -> dict:
    return {
        "kafka.bootstrap.servers": settings.kafka_bootstrap_servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.linger.ms": "5",
        "kafka.batch.size": "16384",
        "kafka.compression.type": "gzip",
        "kafka.retries": "3",
    }


def read_topic(
    spark: SparkSession, settings: Settings = Settings(), max_records: int = BATCH_RECORDS
) -> DataFrame:
    """Streaming rows (event_id, key, value, arrived_at) of the transactions topic.

    The topic is keyed by sender, so offsets order each sender's rows. Between partitions no order
    is defined: the partition goes into the high bits, which keeps ids unique and repeatable, and
    `arrived_at` says which rows are newer.
    """
    reader = spark.readStream.format("kafka").options(**source_options(settings, max_records))
    return reader.load().select(
        F.shiftleft(F.col("partition").cast("long"), OFFSET_BITS)
        .bitwiseOR(F.col("offset"))
        .alias("event_id"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("arrived_at"),
    )


def encode(df: DataFrame, fields=WIRE_FIELDS, key: str = "nameOrig") -> DataFrame:
    """(key, value): JSON with the wire names, keyed by sender. Row order is left as it is."""
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(F.col(key).cast("string").alias("key"), value.alias("value"))


def decode(messages: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed transaction columns from JSON; whatever does not fit its type becomes null.

    Fields are read as text first, so that a number sent as a string is still a number. Null
    required fields are then caught by validation instead of failing the query. `unreadable` lists
    fields that are there but not of their type, names that are no strings among them: validation
    rejects such rows, even where the field may be absent.

    A message is parsed twice, whatever is asked of its fields: both parses come out of a generator,
    which later filters and projections on the fields don't pass. Else each would parse again.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in FILE_SCHEMA.fields])
    body = F.col(value).cast("string")
    fields = F.from_json(body, text, {"mode": "PERMISSIVE"})
    both = F.struct(fields.alias("__m"), F.try_parse_json(body).alias("__tree"))
    parsed = messages.select(*keep, F.inline(F.array(both)))

    def typed(field: T.StructField):
        raw = F.col(f"__m.{field.name}")
        if isinstance(field.dataType, (T.LongType, T.IntegerType)):
            number = raw.try_cast("double")
            whole = F.when(number == F.floor(number), number.cast("long"))
            return whole.cast(field.dataType).alias(field.name)
        return raw.try_cast(field.dataType).alias(field.name)

    def misread(field: T.StructField):
        present = F.col(f"__m.{field.name}").isNotNull()
        if isinstance(field.dataType, T.StringType):
            kind = F.schema_of_variant(F.try_variant_get("__tree", f"$.{field.name}", "variant"))
            return present & (kind != "STRING")
        return present & typed(field).isNull()

    wrong = F.array_compact(
        F.array(*[F.when(misread(f), F.lit(f.name)) for f in FILE_SCHEMA.fields])
    )
    return parsed.select(
        *keep, *[typed(f) for f in FILE_SCHEMA.fields], wrong.alias("unreadable")
    )


def decision_messages(records: DataFrame) -> DataFrame:
    return encode(records, records.columns)


def sender_order(rows: DataFrame) -> DataFrame:
    """Rows so that each sender's are written by one task, in replay order."""
    return rows.repartition("nameOrig").sortWithinPartitions("step", "event_id")


def publish(
    df: DataFrame,
    settings: Settings = Settings(),
    name: str = "test",
    max_events: int | None = None,
    dry_run: bool = False,
    send=None,
) -> dict:
    """Replay a split onto the transactions topic; the numbers of rows and frauds, and the rate.

    Tasks write at once, so order holds within a task only. The rows of as many steps as velocity
    totals stay alive go out together, each sender's by one task in order, and the next steps only
    after they have arrived: no row can come later than its totals. The replay is read, checked and
    cut once, into a table with a folder for each range of steps; a range reads its folder alone. A
    dry run sends nothing, and returns the same numbers with the first five messages. `send` takes
    the messages instead of the topic.
    """
    rows = replay(df, name, max_events)
    totals = published_totals(rows)
    if dry_run:
        return _figures(totals.first()) | {"messages": encode(rows).limit(5)}

    def to_topic(messages: DataFrame) -> None:
        options = sink_options(settings.kafka_transactions_topic, settings)
        messages.write.format("kafka").options(**options).save()

    spark, width = df.sparkSession, settings.velocity_ttl_steps
    path = fresh_path(spark, "replay")
    steps = F.floor(F.col("step") / width).cast("long")
    rows.withColumn("__range", steps).repartition("__range").write.partitionBy("__range").parquet(path)
    table = StructType([*rows.schema.fields, StructField("__range", LongType())])
    stored = spark.read.schema(table).parquet(path)
    sent = {"published": 0, "frauds": 0}
    for (number,) in sorted(stored.select("__range").distinct().collect()):  # one for each range
        seen = Observation(f"published-{number}")
        part = stored.where(F.col("__range") == number).drop("__range")
        counted = sender_order(part).observe(
            seen,
            F.count(F.lit(1)).alias("published"),
            F.count_if(F.col("isFraud") == 1).alias("frauds"),
        )
        (send or to_topic)(encode(counted))
        for figure, n in seen.get.items():
            sent[figure] += n
    remove_path(spark, path)
    return _figures(sent)


def _figures(row) -> dict:
    published, frauds = row["published"], row["frauds"]
    return {
        "published": published,
        "frauds": frauds,
        "fraud_rate": frauds / published if published else 0.0,
    }
