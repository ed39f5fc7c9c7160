"""Streams equal batch, whatever the micro-batches, and across restarts; topics and messages."""

import json
import os
import random

import pytest

from catalog import queries as q
from pyspark.sql import functions as F
from riskloom.operators import drift as dr
from riskloom.operators import features as fe
from riskloom.operators import validate as va
from riskloom.operators.limits import first_rows
from riskloom.schemas import WIRE_FIELDS
from riskloom.plans import consume, snapshot
from riskloom.settings import Settings
from riskloom.sources import topics
from riskloom.sources import transactions as tx
from riskloom.sources.workspace import fresh_path
from riskloom.streaming import velocity as sv
from riskloom.streaming.monitoring import start_monitor
from riskloom.streaming.scoring import ScoringPaths, read_scored, start_scoring
from tests.helpers import by_event, txn_row, txns
from tests.test_features import VELOCITY, random_events


def append(spark, rows, path):
    txns(spark, rows).coalesce(1).write.mode("append").parquet(path)


def follow(spark, root, **options):
    sv.start_velocity(
        tx.read_stream(spark, f"{root}/in", files_per_batch=1), f"{root}/out", f"{root}/checkpoint", **options
    ).awaitTermination()
    return by_event(spark.read.parquet(f"{root}/out"), *VELOCITY)


@pytest.mark.parametrize("cuts, hot_rows", [((1, 150, 151), 10**6), ((100, 200), 20)])
def test_stream_equals_batch_and_survives_a_restart(spark, cuts, hot_rows):
    rows = random_events(11, 300, 8, steps=2)
    root = fresh_path(spark, "t-stream")
    edges = [0, *cuts, len(rows)]
    parts = [rows[a:b] for a, b in zip(edges, edges[1:])]
    for part in parts[:2]:
        append(spark, part, f"{root}/in")
    follow(spark, root, hot_rows=hot_rows)
    for part in parts[2:]:
        append(spark, part, f"{root}/in")
    got = follow(spark, root, hot_rows=hot_rows)
    assert got == by_event(fe.add_velocity_shared(txns(spark, rows)), *VELOCITY)


def test_repeated_batch_changes_nothing(spark):
    """A batch whose commit was lost runs again with the state it had before."""
    root = fresh_path(spark, "t-replay")
    for i, amount in enumerate((10.0, 5.0)):
        append(spark, [txn_row(i, amount=amount)], f"{root}/in")
        follow(spark, root)
    commits = f"{root.removeprefix('file://')}/checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    append(spark, [txn_row(2)], f"{root}/in")
    assert follow(spark, root) == {0: (0, 0.0, 0), 1: (1, 10.0, 1), 2: (2, 15.0, 2)}


def test_late_rows_inside_and_outside_the_time_to_live(spark):
    root = fresh_path(spark, "t-late")
    batches = [[txn_row(0, step=5)], [txn_row(1, step=7)], [txn_row(2, step=5)],
               [txn_row(3, step=8)],
               [txn_row(4, step=5), txn_row(5, step=7), txn_row(6, step=5), txn_row(7, step=6)]]
    for made in batches:
        append(spark, made, f"{root}/in")
        seen = follow(spark, root, late_path=f"{root}/late")
    assert {k: v[0] for k, v in seen.items()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0}
    assert {r["event_id"] for r in spark.read.parquet(f"{root}/late").collect()} == {4, 6}


def test_state_stays_bounded_over_many_batches(spark):
    root = fresh_path(spark, "t-bounded")
    rows = [txn_row(i, step=1 + i // 4, orig=f"A{i % 7}", dest=f"B{i % 3}") for i in range(400)]
    txns(spark, rows).repartitionByRange(100, "event_id").write.parquet(f"{root}/in")
    sv.use_keyed_state(spark)
    stream = tx.read_stream(spark, f"{root}/in", files_per_batch=1)
    query = (
        sv.running_account_totals(stream, 2)
        .writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 99
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    # Three steps are alive, and the batch's own: 4 rows touch 7 accounts at most.
    assert 0 < max(sizes) <= 4 * 7


def test_a_portion_from_one_task_arrives_in_several_files(spark):
    path = fresh_path(spark, "t-arrive")
    one = spark.range(0, 200_000, 1, 1).select(
        F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")
    )
    q._arrive(one, path)
    sizes = [r[0] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * min(sizes) and sum(sizes) == 200_000


def test_a_third_of_the_rows_is_one_account(spark):
    root = fresh_path(spark, "t-hot")
    pick = random.Random(3)
    rows = [
        txn_row(i, step=1 + i // 200, amount=float(pick.randrange(1, 99)),
                orig="HOT" if i % 3 == 0 else f"A{pick.randrange(30)}", dest=f"A{pick.randrange(30)}")
        for i in range(600)
    ]
    for a, b in ((0, 250), (250, 251), (251, 600)):
        append(spark, rows[a:b], f"{root}/in")
    got = follow(spark, root, hot_rows=20)
    assert got == by_event(fe.add_velocity_shared(txns(spark, rows)), *VELOCITY)


def test_stream_scoring_equals_batch(spark, sf_dir):
    out = q.stream_scoring(spark, sf_dir)
    model, _, _ = q.fitted_model(spark, sf_dir)
    valid = va.valid_rows(q.spoiled(q.txn(spark, sf_dir)))
    from riskloom.operators.decisions import add_decision
    from riskloom.operators.model import add_scores

    batch = add_decision(add_scores(fe.engineer_features(valid, "shared"), model)).select(
        "step", "nameOrig", "nameDest", "amount", F.round("risk_score", 4).alias("risk_score"),
        "decision",
    )
    streamed = out.select(*batch.columns)
    assert streamed.count() == valid.count()
    assert streamed.exceptAll(batch).count() == 0


def test_scoring_keeps_rejects_and_gates_explanations(spark, sf_dir):
    model, _, explainer = q.fitted_model(spark, sf_dir)
    root = fresh_path(spark, "t-scoring")
    good = topics.encode(txns(spark, [txn_row(0, oldbalanceOrg=5.0)])).first()["value"]
    messages = spark.createDataFrame(
        [(0, good), (1, "not json"), (2, good.replace("10.0", "-1")), (3, None)],
        "event_id long, value string",
    )
    messages = messages.withColumn("arrived_at", F.current_timestamp())
    messages.coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(messages.schema).parquet(f"{root}/in")
    paths = ScoringPaths.below(root)
    start_scoring(stream, model, explainer, paths).awaitTermination()
    decided = spark.read.parquet(paths.decisions).collect()
    rejected = {
        r["event_id"]: r["violations"] for r in spark.read.parquet(paths.rejects).collect()
    }
    assert len(decided) == 1
    assert decided[0]["latency_ms"] > 0
    published = topics.decision_messages(spark.read.parquet(paths.decisions).drop("batch")).first()
    assert published["key"] == "A"
    assert json.loads(published["value"])["decision"] == decided[0]["decision"]
    assert len(decided[0]["top_features"]) == (3 if decided[0]["risk_score"] >= 0.1 else 0)
    assert set(rejected) == {1, 2, 3}
    assert rejected[2] == ["amount"]


def test_a_small_batch_takes_few_tasks_and_stores(spark, sf_dir):
    """Whatever the session's shuffle partitions: the state has few parts, the rows few files."""
    model, _, explainer = q.fitted_model(spark, sf_dir)
    root = fresh_path(spark, "t-few")
    rows = txns(spark, [txn_row(i, orig=f"A{i % 90}", oldbalanceOrg=5.0) for i in range(300)])
    messages = topics.encode(rows, key="event_id").select(F.col("key").cast("long").alias("event_id"), "value")
    messages.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(messages.schema).parquet(f"{root}/in")
    paths = ScoringPaths.below(root)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        start_scoring(stream, model, explainer, paths).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    stores = os.listdir(f"{paths.checkpoint.removeprefix('file://')}/state/0")
    assert len([s for s in stores if s.isdigit()]) == 8
    for made in (paths.decisions, paths.scored):
        table = spark.read.parquet(made)
        assert table.count() == 300
        assert table.select(F.input_file_name()).distinct().count() < 8


def test_monitor_stream(spark, sf_dir):
    rows = q.scored(spark, sf_dir)
    features = fe.engineer_features(rows).withColumn("isFraud", F.lit(0))
    root = fresh_path(spark, "t-monitor")
    for i in range(4):
        part = features.where(F.col("event_id").between(i * 2500, i * 2500 + 2499))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stored = spark.read.parquet(f"{root}/in")
    reference = dr.reference_snapshot(stored.withColumn("amount", F.col("amount") + 1000))
    stream = (
        spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    )
    settings = Settings(drift_window_size=4000, drift_threshold=0.05)
    start_monitor(
        stream, reference, f"{root}/state", f"{root}/report", f"{root}/checkpoint", settings
    ).awaitTermination()
    alerts = spark.read.parquet(f"{root}/report/alerts")
    assert {r["alert"] for r in alerts.collect()} == {"block_rate"}
    assert sorted(r["rows_seen"] for r in alerts.collect()) == list(range(1000, 10001, 1000))
    summaries = spark.read.parquet(f"{root}/report/drift_summary").collect()
    assert len(summaries) == 2
    assert all(r["is_drifted"] and r["drifted_features"] == ["amount"] for r in summaries)
    assert sorted(r["window"] for r in summaries) == [0, 1]
    assert sorted(os.listdir(f"{root}/state/window".removeprefix("file://"))) == ["batch=2", "batch=3"]
    window = spark.read.parquet(f"{root}/state/window").where("batch = 3")
    assert window.count() == 10_000
    counts = spark.read.parquet(f"{root}/state/counts").where("batch = 3").first()
    assert counts["__all"] == 10_000


def test_monitor_reads_what_scoring_writes(spark, sf_dir):
    model, _, explainer = q.fitted_model(spark, sf_dir)
    root = fresh_path(spark, "t-watched")
    rows = q.txn(spark, sf_dir).where("step > 500").limit(1500)
    fields = [c for c in rows.columns if c != "event_id"]
    messages = rows.select(
        "event_id",
        F.to_json(F.struct(*fields)).alias("value"),
        F.current_timestamp().alias("arrived_at"),
    )
    messages.coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(messages.schema).parquet(f"{root}/in")
    paths = ScoringPaths.below(root)
    start_scoring(stream, model, explainer, paths).awaitTermination()
    snapshot = dr.reference_snapshot(
        fe.engineer_features(q.train_rows(spark, sf_dir), "shared")
    )
    settings = Settings(drift_window_size=1000)
    start_monitor(
        read_scored(spark, paths), snapshot, f"{root}/state", f"{root}/report", f"{root}/watch",
        settings, alert_every=500,
    ).awaitTermination()
    scored = spark.read.parquet(paths.scored).count()
    assert scored == spark.read.parquet(paths.decisions).count() > 1000
    assert spark.read.parquet(f"{root}/state/counts").first()["__all"] == scored
    summary = spark.read.parquet(f"{root}/report/drift_summary").first()
    assert summary["current_size"] == 1000
    assert "alert" in spark.read.parquet(f"{root}/report/alerts").columns


def test_messages_to_reports_with_both_queries_at_once(spark, sf_dir):
    """The snapshot job, then scoring and watching side by side until enough has been scored."""
    model, _, explainer = q.fitted_model(spark, sf_dir)
    root = fresh_path(spark, "t-consume")
    snapshot.run(q.txn(spark, sf_dir), f"{root}/reference", model)
    reference = spark.read.parquet(f"{root}/reference")
    assert "risk_score" in reference.columns
    rows = q.txn(spark, sf_dir).where("step > 500")
    messages = topics.encode(rows, key="event_id").select(
        F.col("key").cast("long").alias("event_id"), "value", F.current_timestamp().alias("arrived_at")
    )
    messages.repartition(3).write.parquet(f"{root}/in")
    stored = spark.read.parquet(f"{root}/in")
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    paths = ScoringPaths.below(f"{root}/out")
    n = rows.count()
    consume.run(
        stream, model, explainer, paths, Settings(drift_window_size=1000), reference, max_messages=n
    )
    scored = spark.read.parquet(paths.scored).count()
    reports = f"{root}/out/monitor/reports"
    windows = spark.read.parquet(f"{reports}/drift_summary")
    assert sorted(r["window"] for r in windows.collect()) == list(range(scored // 1000))
    assert spark.read.parquet(f"{root}/out/monitor/state/counts").agg(F.max("__all")).first()[0] == scored


# -- messages -----------------------------------------------------------------------------------


def test_wire_message(spark):
    message = topics.encode(txns(spark, [txn_row(0, isFraud=None)])).first()
    body = json.loads(message["value"])
    assert message["key"] == "A"
    assert list(body) == list(WIRE_FIELDS)
    assert body["isFraud"] is None and "isFlaggedFraud" not in body


def test_decode_is_lenient_on_numbers_and_strict_on_meaning(spark):
    body = {"step": "7", "type": "DEBIT", "amount": "12.5", "nameOrig": "A", "nameDest": "B",
            "oldbalanceOrg": 1, "newbalanceOrig": 0, "oldbalanceDest": 0, "newbalanceDest": 0}
    cases = [body, {**body, "step": 7.5}, {**body, "amount": "much"}, {**body, "step": 7.0}]
    df = spark.createDataFrame([(json.dumps(c),) for c in cases], "value string")
    rows = topics.decode(df).collect()
    assert [r["step"] for r in rows] == [7, None, 7, 7]
    assert [r["amount"] for r in rows] == [12.5, 12.5, None, 12.5]
    assert rows[0]["isFraud"] is None
    assert va.valid_rows(topics.decode(df)).count() == 2


def test_a_message_is_parsed_once_whatever_is_asked_of_it(spark):
    rows = topics.decode(topics.encode(txns(spark, [txn_row(0)])), keep=("key",))
    for asked in (va.quarantined_rows(rows), va.valid_rows(rows), rows.where("step > 1 and amount > 2")):
        text = asked._jdf.queryExecution().optimizedPlan().toString()
        parses = text.count("from_json(") + text.count("JsonToStructs")
        trees = text.count("try_parse_json(") + text.count("parseJson(")
        assert parses == 1 and trees <= 1


def test_topic_options():
    settings = Settings(kafka_bootstrap_servers="broker:9092")
    source = topics.source_options(settings, max_records=100)
    assert source["subscribe"] == "transactions"
    assert source["startingOffsets"] == "earliest"
    assert source["maxOffsetsPerTrigger"] == "100"
    assert topics.source_options(settings)["maxOffsetsPerTrigger"] == str(topics.BATCH_RECORDS)
    sink = topics.sink_options("fraud-decisions", settings)
    assert sink["topic"] == "fraud-decisions"
    assert sink["kafka.acks"] == "all"
    assert sink["kafka.compression.type"] == "gzip"
    assert (sink["kafka.linger.ms"], sink["kafka.batch.size"]) == ("5", "16384")
    assert source["kafka.bootstrap.servers"] == sink["kafka.bootstrap.servers"] == "broker:9092"


def test_dry_run_gives_five_messages_and_the_totals(spark, sf_dir):
    rows = q.txn(spark, sf_dir)
    figures = topics.publish(rows, dry_run=True)
    assert figures.pop("messages").count() == 5
    sent = []
    assert topics.publish(rows, max_events=None, send=lambda m: sent.append(m.count())) == figures
    assert sum(sent) == figures["published"] == tx.replay(rows, "test").count()
    assert figures["fraud_rate"] == figures["frauds"] / figures["published"]
    assert topics.publish(rows.limit(0))["published"] == 0


def test_messages_written_by_several_tasks_give_batch_velocities(spark, sf_dir):
    """Each write stands for a batch of the topic: its tasks are the partitions, read in any order."""
    rows = q.txn(spark, sf_dir).where("step between 480 and 540")
    root = fresh_path(spark, "t-topic")
    writes = []

    def send(messages):
        path = f"{root}/write-{len(writes)}"
        placed = messages.withColumns(
            {"partition": F.spark_partition_id(), "offset": F.monotonically_increasing_id()}
        )
        placed.write.parquet(path)
        writes.append(path)

    topics.publish(rows, name="all", send=send)
    for path in writes:
        sent = spark.read.parquet(path)
        tasks = sent.groupBy("key").agg(F.countDistinct("partition").alias("n"))
        assert tasks.agg(F.max("n")).first()[0] == 1
        steps = [
            [m["step"] for m in sorted(own, key=lambda m: m["offset"])]
            for own in _by_key(topics.decode(sent, keep=("key", "offset")).collect())
        ]
        assert all(s == sorted(s) for s in steps)
    newest = None
    for path in writes:
        found = topics.decode(spark.read.parquet(path)).agg(F.min("step"), F.max("step")).first()
        assert newest is None or found[0] > newest
        newest = found[1]


def _by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r["key"], []).append(r)
    return out.values()


def test_unreadable_fields_are_told_from_absent_ones(spark):
    body = {"step": 7, "type": "DEBIT", "amount": 12.5, "nameOrig": "A", "nameDest": "B",
            "oldbalanceOrg": 1, "newbalanceOrig": 0, "oldbalanceDest": 0, "newbalanceDest": 0}
    cases = [body, {**body, "isFraud": "abc"}, {**body, "isFraud": None}, {**body, "nameOrig": 7},
             {**body, "isFraud": 1.5}, {**body, "isFraud": "1"}, {**body, "nameDest": None}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, value string")
    decoded = topics.decode(df, keep=("i",))
    assert {r["i"] for r in va.valid_rows(decoded).collect()} == {0, 2, 5}
    bad = {r["i"]: r["violations"] for r in va.quarantined_rows(decoded).collect()}
    assert bad == {1: ["isFraud"], 3: ["nameOrig"], 4: ["isFraud"], 6: ["nameDest"]}
    assert not va.valid_rows(topics.decode(df.limit(0))).collect()


def test_progress_and_bound_of_a_query(spark, tmp_path):
    from riskloom.streaming.progress import ProgressLog, report_progress, stop_after

    said = []
    log = report_progress(spark, 10, said.append)
    try:
        spark.range(40).write.option("maxRecordsPerFile", 5).parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1)
        query = (
            stream.parquet(str(tmp_path / "in"))
            .writeStream.format("noop")
            .option("checkpointLocation", str(tmp_path / "c"))
            .trigger(processingTime="0 seconds")
            .start()
        )
        assert stop_after(query, 15, 0.05) >= 15
        assert not query.isActive
    finally:
        spark.streams.removeListener(log)
    assert isinstance(log, ProgressLog)


# -- files --------------------------------------------------------------------------------------


def test_replay_is_valid_ordered_and_capped(spark):
    pick = random.Random(2)
    rows = [txn_row(i, step=501 + pick.randrange(9), amount=float(i % 4)) for i in range(40)]
    got = [(r["step"], r["event_id"]) for r in tx.replay(txns(spark, rows), "test", 7).collect()]
    valid = sorted((r[1], r[0]) for r in rows if r[3] > 0)
    assert got == valid[:7]
    assert tx.replay(txns(spark, rows), "train").count() == 0
    assert tx.replay(txns(spark, rows), "everything").count() == len(valid)


def test_partitioned_table_prunes_folders(spark, sf_dir):
    path = fresh_path(spark, "t-table")
    tx.write_partitioned(q.txn(spark, sf_dir), path)
    part = tx.read_partitioned(spark, path, 49, 72)
    assert {f.split("step_bucket=")[1].split("/")[0] for f in part.inputFiles()} >= {"2"}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(step_bucket" in plan
    assert part.count() == q.txn(spark, sf_dir).where("step between 49 and 72").count()


def test_split_reaches_the_scan(spark, sf_dir):
    plan = q.test_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_both_spellings_are_one_schema(spark):
    rows = txns(spark, [txn_row(0)])
    assert tx.to_wire_names(tx.rename(rows)).columns == rows.columns


def test_csv_has_a_declared_schema(spark, tmp_path):
    text = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest," \
        "newbalanceDest,isFraud,isFlaggedFraud\n1,PAYMENT,9839.64,C1,170136.0,160296.36,M1,0,0,0,0\n"
    (tmp_path / "log.csv").write_text(text)
    rows = tx.read_csv(spark, str(tmp_path / "log.csv"), with_event_id=False)
    assert rows.schema["amount"].dataType.typeName() == "double"
    assert rows.first()["newbalanceOrig"] == 160296.36


def test_imported_csv_keeps_file_order(spark, tmp_path):
    names = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest",
             "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud"]
    lines = [f"{1 + i // 900},PAYMENT,{i + 1}.0,C{i},0,0,M,0,0,0,0" for i in range(2000)]
    (tmp_path / "log.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    table = fresh_path(spark, "t-import")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        tx.import_csv(spark, str(tmp_path / "log.csv"), table)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = tx.read_partitioned(spark, f"{table}/by_step").orderBy("event_id").collect()
    assert [r["amount"] for r in rows] == [i + 1.0 for i in range(2000)]
    assert [r["event_id"] for r in rows] == list(range(2000))


def test_imported_folder_keeps_the_order_of_its_files(spark, tmp_path):
    names = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest",
             "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud"]
    (tmp_path / "logs").mkdir()
    amount = 0
    for file, n in (("a", 1), ("b", 50), ("c", 7)):
        lines = [f"1,PAYMENT,{amount + i + 1}.0,C{i},0,0,M,0,0,0,0" for i in range(n)]
        amount += n
        (tmp_path / "logs" / f"{file}.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    table = fresh_path(spark, "t-import")
    tx.import_csv(spark, str(tmp_path / "logs"), table)
    rows = tx.read_partitioned(spark, f"{table}/by_step").orderBy("event_id").collect()
    assert [(r["event_id"], r["amount"]) for r in rows] == [(i, i + 1.0) for i in range(58)]


@pytest.mark.parametrize("n", [0, 1, 25, 60, 500])
def test_first_rows_equal_a_plain_limit(spark, n):
    pick = random.Random(n)
    rows = [txn_row(i * 7, step=pick.randrange(1, 6)) for i in range(60)]
    df = txns(spark, rows)
    key = sorted((r[1], r[0]) for r in rows)
    got = first_rows(df, n, ["step", "event_id"]).collect()
    assert [(r["step"], r["event_id"]) for r in got] == key[:n]
    ids = sorted((r[0] for r in rows), reverse=True)
    got = first_rows(df, n, ["event_id"], bits=4, newest=True).collect()
    assert [r["event_id"] for r in got] == ids[:n]
