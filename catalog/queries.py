"""One query per operator, over the whole `events` table seen as transactions.

Floating-point results are rounded here, not in the operators, so that two engines agree on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import top_contributions
from riskloom.operators import anomaly as an
from riskloom.operators import asof
from riskloom.operators import decisions as dec
from riskloom.operators import drift as dr
from riskloom.operators import evaluate as ev
from riskloom.operators import explore as ex
from riskloom.operators import features as fe
from riskloom.operators import graph as gr
from riskloom.operators import model as mo
from riskloom.operators import monitor as mon
from riskloom.operators import registry as reg
from riskloom.operators import sketches as sk
from riskloom.operators import validate as va
from riskloom.operators.explain import Explainer, add_contributions, base_value
from riskloom.operators.running import hot_groups
from riskloom.plans import retrain as retrain_plan
from riskloom.plans.retrain import recent_window
from riskloom.schemas import MODEL_FEATURES, TXN_COLUMNS
from riskloom.settings import Settings
from riskloom.sources import topics
from riskloom.sources import transactions as tx
from riskloom.sources.workspace import fresh_path, written
from riskloom.streaming.monitoring import start_monitor
from riskloom.streaming.scoring import ScoringPaths, start_scoring
from riskloom.streaming.velocity import start_velocity

# Small models: enough to exercise training, scoring and explanation on every row.
QUERY_MODEL = mo.BoostingParams(rounds=20, max_depth=5, min_rows_per_leaf=10, max_bins=64)
VELOCITY = ["orig_tx_count_1h", "orig_amount_sum_1h", "dest_tx_count_1h"]


def txn(spark: SparkSession, sf_dir: str, **steps) -> DataFrame:
    return tx.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), **steps)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.add_decision(tx.add_standin_score(txn(spark, sf_dir)))


def train_rows(spark, sf_dir) -> DataFrame:
    return txn(spark, sf_dir, max_step=500)


def test_rows(spark, sf_dir) -> DataFrame:
    return txn(spark, sf_dir, min_step=501)


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    doubles = names or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({n: F.round(n, digits) for n in doubles})


def spoiled(df: DataFrame) -> DataFrame:
    """Transactions as a careless producer would send them: every rule is broken somewhere."""
    eid = F.col("event_id")
    return df.withColumns(
        {
            "step": F.when(eid % 107 != 0, F.col("step")),
            "type": F.when(eid % 83 == 0, "REFUND").otherwise(F.col("type")),
            "amount": F.when(eid % 97 == 0, 0.0)
            .when(eid % 101 == 0, -F.col("amount"))
            .when(eid % 103 == 0, F.lit("NaN").cast("double"))
            .otherwise(F.col("amount")),
            "nameOrig": F.when(eid % 79 != 0, F.col("nameOrig")),
            "nameDest": F.when(eid % 113 != 0, F.col("nameDest")),
            "oldbalanceOrg": F.when(eid % 89 == 0, -1.0).otherwise(F.col("oldbalanceOrg")),
            "newbalanceDest": F.when(eid % 73 != 0, F.col("newbalanceDest")),
        }
    )


# -- sources ------------------------------------------------------------------------------------


def txn_scan(spark, sf_dir):
    return txn(spark, sf_dir)


def split_summary(spark, sf_dir):
    part = F.when(F.col("step") <= 500, "train").otherwise("test")
    return rounded(ex.label_totals(txn(spark, sf_dir).withColumn("split", part), "split"))


def partitioned_table(spark, sf_dir):
    path = fresh_path(spark, "transactions")
    tx.write_partitioned(txn(spark, sf_dir), path)
    return tx.read_partitioned(spark, path, 400, 600)


def csv_round_trip(spark, sf_dir):
    path = fresh_path(spark, "csv")
    txn(spark, sf_dir).write.option("header", True).csv(path)
    return tx.read_csv(spark, path)


def validate_rows(spark, sf_dir):
    return va.violation_counts(spoiled(txn(spark, sf_dir)))


def valid_rows(spark, sf_dir):
    return va.valid_rows(spoiled(txn(spark, sf_dir)))


def quarantine_rows(spark, sf_dir):
    bad = va.quarantined_rows(spoiled(txn(spark, sf_dir)))
    return bad.select("event_id", F.concat_ws(",", "violations").alias("violations"))


def fraud_only(spark, sf_dir):
    return tx.labelled_fraud(txn(spark, sf_dir), "test")


def replay_order(spark, sf_dir):
    placed = tx.replay_positions(spoiled(txn(spark, sf_dir)), "all")
    return placed.select("event_id", "step", "position")


def replay_cap(spark, sf_dir):
    return tx.replay(txn(spark, sf_dir), "test", 500)


def rename_columns(spark, sf_dir):
    return tx.rename(txn(spark, sf_dir))


def wire_fields(spark, sf_dir):
    messages = topics.encode(txn(spark, sf_dir))
    return topics.decode(messages, keep=("key",)).drop("isFlaggedFraud", "unreadable")


def message_quarantine(spark, sf_dir):
    """Labels that are no numbers and names that are no strings, told from absent ones."""
    messages = topics.encode(txn(spark, sf_dir), key="event_id")
    number, text = '"nameOrig":7', '"isFraud":"abc"'
    eid = F.col("key").cast("long")
    named = F.when(eid % 61 == 0, F.regexp_replace("value", '"nameOrig":"[^"]*"', number))
    value = F.coalesce(named, "value")
    labelled = F.when(eid % 59 == 0, F.regexp_replace(value, '"isFraud":[01]', text))
    spoilt = messages.withColumn("value", F.coalesce(labelled, value))
    bad = va.quarantined_rows(topics.decode(spoilt, keep=("key",)))
    return bad.select("key", F.concat_ws(",", "violations").alias("violations"))


def newest_by_arrival(spark, sf_dir):
    """The newest rows of a topic of four partitions, whose ids have the partition in front."""
    rows = scored(spark, sf_dir).select(
        F.shiftleft(F.col("event_id") % 4, topics.OFFSET_BITS)
        .bitwiseOR(F.col("event_id"))
        .alias("event_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("event_id") / 3)).alias("arrived_at"),
        "risk_score",
    )
    return mon.last_rows(rows, 1000).select("event_id", "risk_score")


def publish_dry_run(spark, sf_dir):
    messages = topics.publish(txn(spark, sf_dir), dry_run=True)["messages"]
    fields = topics.decode(messages, keep=("key",))
    return fields.select("key", "step", "type", "amount", "nameDest")


def published_totals(spark, sf_dir):
    return mon.published_totals(va.valid_rows(txn(spark, sf_dir)))


def preview(spark, sf_dir):
    return ex.preview(txn(spark, sf_dir))


def table_shape(spark, sf_dir):
    return ex.shape(txn(spark, sf_dir))


# -- features -----------------------------------------------------------------------------------


def balance_errors(spark, sf_dir):
    out = fe.add_balance_errors(txn(spark, sf_dir))
    return out.select("event_id", "error_balance_orig", "error_balance_dest")


def balance_errors_alt(spark, sf_dir):
    out = fe.add_balance_errors_reversed(txn(spark, sf_dir))
    return out.select("event_id", "errorBalanceOrig", "errorBalanceDest")


def type_dummies(spark, sf_dir):
    return fe.add_type_dummies(txn(spark, sf_dir)).select(
        "event_id", *[c for c in MODEL_FEATURES if c.startswith("type_")]
    )


def dummies_drop_first(spark, sf_dir):
    known = fe.categories(train_rows(spark, sf_dir), "type")
    out = fe.add_dummies_drop_first(test_rows(spark, sf_dir), "type", known)
    return out.drop("nameOrig", "nameDest", "isFraud")


def velocity_by_role(spark, sf_dir):
    return fe.add_velocity_by_role(txn(spark, sf_dir)).select("event_id", *VELOCITY)


def velocity_by_role_hot(spark, sf_dir):
    """The same numbers when every group above two rows takes the path for hot groups."""
    out = fe.add_velocity_by_role(txn(spark, sf_dir), hot_rows=2, slice_bits=2)
    return out.select("event_id", *VELOCITY)


def velocity_shared(spark, sf_dir):
    return fe.add_velocity_shared(txn(spark, sf_dir)).select("event_id", *VELOCITY)


def velocity_shared_hot(spark, sf_dir):
    out = fe.add_velocity_shared(txn(spark, sf_dir), hot_rows=2, slice_bits=2)
    return out.select("event_id", *VELOCITY)


def velocity_mode_diff(spark, sf_dir):
    rows = txn(spark, sf_dir)
    by_role = fe.add_velocity_by_role(rows).select(
        "event_id",
        F.col("orig_tx_count_1h").alias("o"),
        F.col("dest_tx_count_1h").alias("d"),
    )
    both = fe.add_velocity_shared(rows).join(by_role, "event_id")
    return both.agg(
        F.count_if(F.col("o") != F.col("orig_tx_count_1h")).alias("sender_rows"),
        F.count_if(F.col("d") != F.col("dest_tx_count_1h")).alias("receiver_rows"),
    )


def features_batch(spark, sf_dir):
    return fe.engineer_features(txn(spark, sf_dir), "by_role")


def features_online(spark, sf_dir):
    return fe.engineer_features(va.valid_rows(txn(spark, sf_dir)), "shared")


def feature_matrix(spark, sf_dir):
    return fe.feature_columns(fe.engineer_features(txn(spark, sf_dir)))


# -- decisions ----------------------------------------------------------------------------------


def decision_report(spark, sf_dir):
    """The report by type, and by whether the sender was active before within the hour."""
    rows = va.valid_rows(txn(spark, sf_dir))
    features = fe.engineer_features(rows, "shared")
    active = F.when(F.col("orig_tx_count_1h") > 0, "active").otherwise("first")
    banded = features.withColumn("sender", active)
    decided = dec.add_decision(tx.add_standin_score(banded))
    return rounded(dec.decision_report(decided, ("type", "sender")))


def decision_bands(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", "risk_score", "decision")


def decision_guard(spark, sf_dir):
    stale = dec.add_decision(
        tx.add_standin_score(txn(spark, sf_dir)).withColumn("old", F.col("risk_score") + 0.05),
        score="old",
    )
    return va.decision_violations(stale).select(
        "event_id", "risk_score", "decision", "expected_decision"
    )


def decision_records(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumns(
        {"risk_score": F.col("risk_score") / 3, "latency_ms": F.col("latency_ms") / 7}
    )
    return dec.to_decision_records(rows).drop("top_features")


def decision_log(spark, sf_dir):
    path = fresh_path(spark, "decision-log")
    dec.log_decisions(scored(spark, sf_dir), path)
    return spark.read.parquet(path).drop("step_bucket")


def flagged_rows(spark, sf_dir):
    return dec.flagged(scored(spark, sf_dir)).select("event_id", "decision")


def decision_mix(spark, sf_dir):
    return rounded(dec.decision_mix(scored(spark, sf_dir)))


def interesting_cases(spark, sf_dir):
    return dec.interesting_cases(scored(spark, sf_dir))


def first_frauds(spark, sf_dir):
    return dec.first_frauds(test_rows(spark, sf_dir)).select("event_id", "step", "type", "amount")


def compare_scores(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn(
        "challenger", ((F.col("event_id") * 6007) % 1000).cast("double") / 1000
    )
    return rounded(dec.compare_scores(rows, "risk_score", "challenger"))


def _made_contributions(df: DataFrame) -> DataFrame:
    parts = [
        F.struct(
            F.lit(name).alias("feature"),
            (
                ((F.col("event_id") * (31 + 17 * i) + 7919 * i) % 2001 - 1000).cast("double") / 1000
            ).alias("value"),
        )
        for i, name in enumerate(MODEL_FEATURES)
    ]
    return df.withColumn("contributions", F.array(*parts))


def top_k_features(spark, sf_dir):
    out = _made_contributions(txn(spark, sf_dir)).withColumn(
        "top", top_contributions("contributions", 3)
    )
    return out.select("event_id", F.posexplode("top").alias("place", "t")).select(
        "event_id", F.col("place").cast("int").alias("place"), "t.feature", "t.value"
    )


# -- exploration --------------------------------------------------------------------------------


def label_share(spark, sf_dir):
    return rounded(ex.value_counts(txn(spark, sf_dir), "isFraud", normalize=True))


def type_counts(spark, sf_dir):
    return ex.value_counts(txn(spark, sf_dir), "type")


def step_range(spark, sf_dir):
    return ex.step_range(txn(spark, sf_dir))


def amount_range_by_label(spark, sf_dir):
    return ex.amount_range_by_label(txn(spark, sf_dir))


def label_counts(spark, sf_dir):
    return ex.label_counts(txn(spark, sf_dir))


def null_counts(spark, sf_dir):
    return ex.null_counts(spoiled(txn(spark, sf_dir)))


def duplicate_rows(spark, sf_dir):
    """Over all columns but the id, of a table in which some rows were stored again."""
    rows = txn(spark, sf_dir)
    again = rows.where(F.col("event_id") % 50 == 0)
    third = rows.where(F.col("event_id") % 150 == 0)
    return ex.duplicate_rows(rows.union(again).union(third).drop("event_id"))


def xtab_type_label(spark, sf_dir):
    return ex.crosstab(txn(spark, sf_dir), "type")


def xtab_flag_label(spark, sf_dir):
    return ex.crosstab(txn(spark, sf_dir), "isFlaggedFraud")


def fraud_rate_by_type(spark, sf_dir):
    return rounded(ex.fraud_rate_by_type(txn(spark, sf_dir)))


def describe_amount(spark, sf_dir):
    return rounded(ex.describe_amount(txn(spark, sf_dir)), 4)


def describe_errors(spark, sf_dir):
    return rounded(ex.describe_errors(txn(spark, sf_dir)), 4)


def fraud_types(spark, sf_dir):
    return ex.fraud_types(txn(spark, sf_dir))


def distinct_parties(spark, sf_dir):
    return ex.distinct_parties(txn(spark, sf_dir))


def distinct_parties_by_day(spark, sf_dir):
    """Sketches of each step, stored, merged by day; next to the exact numbers, which they must meet
    within two in a hundred."""
    rows = txn(spark, sf_dir)
    stored, _ = written(sk.party_sketches(rows), "party-sketches")
    day = F.floor((F.col("period") - 1) / 24).cast("long")
    near = sk.merged_parties(stored, day)
    exact = rows.groupBy(F.floor((F.col("step") - 1) / 24).cast("long").alias("period")).agg(
        F.countDistinct("nameOrig").alias("exact_senders"),
        F.countDistinct("nameDest").alias("exact_receivers"),
    )

    def close(kind: str):
        return F.abs(F.col(kind) - F.col(f"exact_{kind}")) <= 0.02 * F.col(f"exact_{kind}")

    return near.join(exact, "period").select(
        "period", "rows", "exact_senders", "exact_receivers",
        (close("senders") & close("receivers")).alias("within"),
    )


def percentiles_by_day(spark, sf_dir):
    """Percentiles of score and latency from sketches of each step: the share of the day's rows up to
    each is within two in a hundred of what was asked."""
    rows = scored(spark, sf_dir)
    values = ["risk_score", "latency_ms"]
    stored, _ = written(sk.value_sketches(rows, values, ["step"]), "value-sketches")
    day = F.floor((F.col("step") - 1) / 24).cast("long")
    merged = sk.merged_values(stored, values, day)
    asked = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    cuts = merged.select(
        "period", *[sk.percentile(v, s).alias(f"{v}_{p}") for v in values for p, s in asked.items()]
    )
    joined = rows.withColumn("period", day).join(F.broadcast(cuts), "period")  # a row a day
    below = {
        f"{v}_{p}": (F.avg((F.col(v) < F.col(f"{v}_{p}")).cast("int")) <= s + 0.02)
        & (F.avg((F.col(v) <= F.col(f"{v}_{p}")).cast("int")) >= s - 0.02)
        for v in values
        for p, s in asked.items()
    }
    return joined.groupBy("period").agg(
        F.count(F.lit(1)).alias("rows"), *[c.alias(f"{name}_within") for name, c in below.items()]
    )


def zero_dest_share(spark, sf_dir):
    """The rule as it is, on a table in which some receivers are empty before, after, or both."""
    eid = F.col("event_id")
    empty = {"oldbalanceDest": eid % 7 == 0, "newbalanceDest": eid % 14 < 3}
    rows = txn(spark, sf_dir).withColumns(
        {c: F.when(hit, 0.0).otherwise(F.col(c)) for c, hit in empty.items()}
    )
    return rounded(ex.zero_destination_share(rows))


def nonzero_error_share(spark, sf_dir):
    return rounded(ex.nonzero_error_share(txn(spark, sf_dir)))


def nonzero_error_rows(spark, sf_dir):
    out = ex.nonzero_error_rows(txn(spark, sf_dir))
    return out.select("event_id", "type", "errorBalanceOrig", "errorBalanceDest")


def semi_join_counts(spark, sf_dir):
    return ex.membership_counts(txn(spark, sf_dir))


def member_rows(spark, sf_dir):
    rows = txn(spark, sf_dir)
    transfers = rows.where((F.col("type") == "TRANSFER") & (F.col("isFraud") == 0))
    cash_outs = rows.where((F.col("type") == "CASH_OUT") & (F.col("isFraud") == 1))
    return ex.members(transfers, "nameDest", cash_outs, "nameOrig").select("event_id", "nameDest")


# -- graphs, lookups, anomalies -------------------------------------------------------------------


def fraud_rings(spark, sf_dir):
    """Rings of each day with two fraudulent payments or more."""
    rings, _ = gr.fraud_rings(txn(spark, sf_dir), min_frauds=2, period_steps=24)
    return rings


def ring_members(spark, sf_dir):
    """The same with every account of two payments or more taken for a hub."""
    _, members = gr.fraud_rings(txn(spark, sf_dir), min_frauds=2, period_steps=24, hub_rows=1)
    return members


def payment_degrees(spark, sf_dir):
    return gr.payment_degrees(txn(spark, sf_dir))


def cash_out_chains(spark, sf_dir):
    return gr.cash_out_chains(txn(spark, sf_dir))


def cash_out_chains_hot(spark, sf_dir):
    return gr.cash_out_chains(txn(spark, sf_dir), hot_rows=2, slice_bits=4)


def _last_received(spark, sf_dir, hot_rows=None, slice_bits=16):
    """Each event with what its sender had received last before it."""
    rows = txn(spark, sf_dir)
    asked = rows.select(F.col("nameOrig").alias("account"), F.col("event_id").alias("place"), "event_id")
    given = rows.select(
        F.col("nameDest").alias("account"),
        (F.col("event_id") + 1).alias("place"),
        F.col("event_id").alias("received_id"),
        F.col("amount").alias("received_amount"),
    )
    hot = None
    if hot_rows is not None:
        hot = hot_groups(asked.select("account").union(given.select("account")), ["account"], hot_rows)
    found = asof.as_of(asked, given, ["account"], "place", hot, slice_bits)
    return found.select("event_id", "received_id", "received_amount")


def asof_last_received(spark, sf_dir):
    return _last_received(spark, sf_dir)


def asof_last_received_hot(spark, sf_dir):
    return _last_received(spark, sf_dir, hot_rows=2, slice_bits=6)


def asof_step_profile(spark, sf_dir):
    """Each event with its sender's newest totals of a finished step: a point-in-time feature join."""
    rows = txn(spark, sf_dir)
    profile = rows.groupBy(F.col("nameOrig").alias("account"), F.col("step") + 1).agg(
        F.count(F.lit(1)).alias("sent_count"), F.sum(fe.cents("amount")).alias("sent_cents")
    )
    profile = profile.toDF("account", "place", "sent_count", "sent_cents")
    asked = rows.select(F.col("nameOrig").alias("account"), F.col("step").alias("place"), "event_id")
    found = asof.as_of(asked, profile, ["account"], "place")
    return found.select("event_id", "sent_count", "sent_cents")


def _rolling(spark, sf_dir, hours, hot_rows=None):
    """How much an account has sent in the hours before an event, to the microsecond."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', cast(ts AS timestamp_ntz))")
    rows = txn(spark, sf_dir).join(events.select("event_id", micros.alias("micros")), "event_id")
    rows = rows.withColumns({"sent": F.lit(1), "c": fe.cents("amount")})
    hot = None if hot_rows is None else hot_groups(rows, ["nameOrig"], hot_rows)
    sums = asof.sliding_totals(
        rows, ["nameOrig"], "micros", hours * 3_600_000_000, ["sent", "c"], hot=hot, slice_bits=34
    )
    return sums.select(
        "event_id", F.col("sent_in_window").alias("sent_count"), fe.money("c_in_window").alias("sent_sum")
    )


def rolling_hour(spark, sf_dir):
    return _rolling(spark, sf_dir, 1)


def rolling_day_hot(spark, sf_dir):
    return _rolling(spark, sf_dir, 24, hot_rows=2)


def median_scores(spark, sf_dir):
    values = ["amount", "oldbalanceOrg", "newbalanceDest"]
    out = an.median_scores(txn(spark, sf_dir), values)
    names = [*[f"{v}_score" for v in values], "anomaly_score"]
    return rounded(out.select("event_id", *names), 4)


def isolation_scores(spark, sf_dir):
    rows = fe.add_balance_errors(txn(spark, sf_dir))
    features = ["amount", "error_balance_orig", "error_balance_dest", "oldbalanceOrg"]
    forest = an.grow_forest(rows, features)
    return an.add_isolation_scores(rows, forest, features).select("event_id", "isolation_score")


# -- evaluation ---------------------------------------------------------------------------------


def class_ratio(spark, sf_dir):
    return rounded(ev.class_ratio(train_rows(spark, sf_dir)))


def threshold_sweep(spark, sf_dir):
    return ev.confusion(scored(spark, sf_dir), (0.1, 0.3, 0.5, 0.7))


def predictions(spark, sf_dir):
    return ev.add_prediction(scored(spark, sf_dir), 0.1).select("event_id", "prediction")


def confusion(spark, sf_dir):
    return ev.confusion(scored(spark, sf_dir))


def class_report(spark, sf_dir):
    return rounded(ev.class_report(scored(spark, sf_dir)))


def average_precision(spark, sf_dir):
    return rounded(ev.average_precision(scored(spark, sf_dir)), 8)


def pr_curve(spark, sf_dir):
    return rounded(ev.pr_curve(scored(spark, sf_dir)))


def best_f1(spark, sf_dir):
    return rounded(ev.best_f1(scored(spark, sf_dir)))


# -- monitoring and drift -----------------------------------------------------------------------


def monitor_summary(spark, sf_dir):
    return rounded(mon.monitor_summary(scored(spark, sf_dir), 5000))


def monitor_points(spark, sf_dir):
    """The summary after each thousand rows, of the newest ten thousand at that point."""
    rows = mon.numbered(scored(spark, sf_dir))
    last = rows.agg(F.max("number")).first()[0]
    return rounded(mon.summary_by_point(rows, last // 1000 * 1000))


def monitor_alert(spark, sf_dir):
    return rounded(mon.alerts(mon.monitor_summary(scored(spark, sf_dir))))


def latency_alert(spark, sf_dir):
    summary = mon.monitor_summary(scored(spark, sf_dir))
    return rounded(mon.alerts(summary, baseline=0.1))


def progress_batches(spark, sf_dir):
    return mon.progress_batches(scored(spark, sf_dir))


def _samples(spark, sf_dir):
    """Training steps against later ones: one table, its features built once."""
    features = tx.add_standin_score(fe.engineer_features(txn(spark, sf_dir)))
    return features.withColumn("is_reference", F.col("step") <= 500)


def ks_by_feature(spark, sf_dir):
    return dr.ks_by_feature(_samples(spark, sf_dir))


def chi2_dummies(spark, sf_dir):
    return dr.chi2_by_dummy(_samples(spark, sf_dir))


def drift_by_column(spark, sf_dir):
    return dr.drift_by_column(_samples(spark, sf_dir))


def _moved(spark, sf_dir):
    """The reference next to a current sample whose amounts and velocities have grown."""
    samples = _samples(spark, sf_dir)

    def moved(c):
        return F.when(F.col("is_reference"), F.col(c)).otherwise(F.col(c) * 1.5 + 1)

    return samples.withColumns({c: moved(c) for c in ("amount", *VELOCITY)})


def drift_summary(spark, sf_dir):
    summary, _ = dr.check_drift(_moved(spark, sf_dir))
    names = F.concat_ws(",", "drifted_features").alias("drifted_features")
    return summary.select(
        "is_drifted", "drift_ratio", names, "current_size", "reference_size"
    )


def retrain_trigger(spark, sf_dir):
    summary, _ = dr.check_drift(_moved(spark, sf_dir))
    return reg.should_retrain(summary)


def score_drift(spark, sf_dir):
    rows = tx.add_standin_score(txn(spark, sf_dir))
    samples = rows.withColumn("is_reference", F.col("step") <= 500)
    return dr.score_drift(samples)


def ap_by_bucket(spark, sf_dir):
    return rounded(dr.performance_by_period(scored(spark, sf_dir)))


# -- registry -----------------------------------------------------------------------------------


def runs(spark, sf_dir) -> DataFrame:
    """One run per day of the table, with that day's average precision as its score."""
    daily = rounded(dr.performance_by_period(scored(spark, sf_dir)))
    before = F.lag("pr_auc").over(Window.orderBy("period"))  # one row per day
    gain = F.col("pr_auc") - F.coalesce(before, F.lit(0.0))
    return daily.select(
        F.concat(F.lit("v"), (F.col("period") + 1).cast("string")).alias("version"),
        "pr_auc",
        gain.alias("improvement"),
        F.lit("scheduled").alias("trigger"),
        F.lit(None).cast("double").alias("drift_score"),
        reg.promotes(F.col("pr_auc"), before).alias("promoted"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("period") * 86400).alias("trained_at"),
    )


def promotion_rule(spark, sf_dir):
    return rounded(runs(spark, sf_dir).select("version", "pr_auc", "improvement", "promoted"))


def champion_lookup(spark, sf_dir):
    path = fresh_path(spark, "runs")
    runs(spark, sf_dir).write.mode("append").parquet(path)
    return rounded(reg.champion(reg.read_runs(spark, path)).select("version", "pr_auc"))


def next_version(spark, sf_dir):
    return reg.next_version(runs(spark, sf_dir))


def retrain_window(spark, sf_dir):
    return ex.label_totals(recent_window(train_rows(spark, sf_dir), 200)).select("rows", "frauds")


# -- models -------------------------------------------------------------------------------------

_models: dict[tuple[str, str], tuple] = {}


def fitted_model(spark, sf_dir):
    """(model, folder, explainer), fitted once per session and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        train = fe.engineer_features(train_rows(spark, sf_dir), "shared")
        path = fresh_path(spark, "features")
        train.write.parquet(path)
        model = mo.train_boosted(spark.read.parquet(path), params=QUERY_MODEL)
        root = fresh_path(spark, "models")
        mo.save_model(spark, model, root, "v1")
        _models[key] = (mo.load_model(spark, root, "v1"), root, Explainer.load(spark, f"{root}/v1"))
    return _models[key]


def gbt_scores(spark, sf_dir):
    model, _, _ = fitted_model(spark, sf_dir)
    features = fe.engineer_features(test_rows(spark, sf_dir), "shared")
    return dec.add_decision(mo.add_scores(features, model)).select(
        "event_id", "isFraud", "risk_score", "decision"
    )


def gbt_explain(spark, sf_dir):
    model, _, explainer = fitted_model(spark, sf_dir)
    features = fe.engineer_features(test_rows(spark, sf_dir), "shared")
    explained = add_contributions(
        mo.add_scores(features, model, keep_vector=True), explainer, explain_from=0.1
    )
    return explained.select(
        "event_id", "risk_score", F.inline_outer(top_contributions("contributions", 3))
    )


def gbt_score_checks(spark, sf_dir):
    """What holds for the scores of any model: their range, and the decision as their band."""
    score = F.col("risk_score")
    band = F.when(score >= 0.7, "BLOCK").when(score >= 0.3, "REVIEW").otherwise("APPROVE")
    return gbt_scores(spark, sf_dir).select(
        "event_id",
        "isFraud",
        score.between(0.0, 1.0).alias("in_range"),
        (F.col("decision") == band).alias("is_band"),
    )


def gbt_explain_checks(spark, sf_dir):
    """What holds for any explanation: given from the gate on, adding up to the log-odds, top first."""
    model, _, explainer = fitted_model(spark, sf_dir)
    features = fe.engineer_features(test_rows(spark, sf_dir), "shared")
    scored_rows = mo.add_scores(features, model, keep_vector=True)
    explained = add_contributions(scored_rows, explainer, explain_from=0.1)
    total = F.aggregate(
        "contributions", F.lit(base_value(explainer.trees)), lambda acc, c: acc + c["value"]
    )
    score = F.col("risk_score")
    sizes = F.transform(top_contributions("contributions", 3), lambda c: F.abs(c["value"]))
    given = F.size("contributions") > 0
    return explained.select(
        "event_id",
        (given == (score >= 0.1)).alias("from_gate"),
        (~given | (F.abs(total - F.log(score / (1 - score))) < 1e-6)).alias("adds_up"),
        (F.reverse(F.array_sort(sizes)) == sizes).alias("top_first"),
    )


def gbt_importance(spark, sf_dir):
    model, root, _ = fitted_model(spark, sf_dir)
    return mo.importance(spark, model, f"{root}/v1")


def gbt_quality(spark, sf_dir):
    model, _, _ = fitted_model(spark, sf_dir)
    features = fe.engineer_features(test_rows(spark, sf_dir), "shared")
    return ev.average_precision(mo.add_scores(features, model))


def model_versions(spark, sf_dir):
    _, root, _ = fitted_model(spark, sf_dir)
    return mo.list_versions(spark, root)


def logistic_scores(spark, sf_dir):
    model, known = mo.train_logistic(train_rows(spark, sf_dir))
    return mo.add_logistic_scores(test_rows(spark, sf_dir), model, known).select(
        "event_id", "isFraud", "risk_score"
    )


def logistic_score_checks(spark, sf_dir):
    return logistic_scores(spark, sf_dir).select(
        "event_id", "isFraud", F.col("risk_score").between(0.0, 1.0).alias("in_range")
    )


def retrain_cycle(spark, sf_dir):
    root = fresh_path(spark, "retrain")
    retrain_plan.run(
        txn(spark, sf_dir), root, "manual", params=QUERY_MODEL, early_stopping=False
    )
    return reg.read_runs(spark, f"{root}/_runs")


# -- streaming ----------------------------------------------------------------------------------

ARRIVALS = 4


def _arrive(part: DataFrame, path: str) -> None:
    """Append a portion as files of even size: a range of ids is read by few tasks, however many rows
    it has, and the stream after it would be no wider than the files."""
    part.repartition("event_id").write.mode("append").parquet(path)


def _arrivals(df: DataFrame, path: str):
    """Append the rows below `path` in ARRIVALS portions of event order, pausing after each."""
    last = df.agg(F.max("event_id")).first()[0]
    width = last // ARRIVALS + 1
    for i in range(ARRIVALS):
        part = df.where((F.col("event_id") >= i * width) & (F.col("event_id") < (i + 1) * width))
        _arrive(part, path)
        yield i


def stream_velocity(spark, sf_dir):
    """A stream that is stopped and resumed from its checkpoint after every arrival."""
    root = fresh_path(spark, "stream")
    for _ in _arrivals(txn(spark, sf_dir), f"{root}/in"):
        start_velocity(
            tx.read_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint"
        ).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", *VELOCITY)


def mixed_arrivals(df: DataFrame) -> DataFrame:
    """Rows with the number of the portion they arrive in, and one sender in a third of them.

    Rows near the end of a portion are dealt to both sides of it, and every 20th row comes a portion
    later than its neighbours, when most of their totals have expired.
    """
    eid = F.col("event_id")
    width = df.agg(F.max("event_id")).first()[0] // ARRIVALS + 1
    jitter = ((eid * 7919) % 5 - 2) * 20
    portion = F.floor(F.greatest(eid + jitter, F.lit(0)) / width) + F.when(eid % 20 == 7, 1).otherwise(0)
    return df.withColumns(
        {
            "nameOrig": F.when(eid % 3 == 0, "HOT").otherwise(F.col("nameOrig")),
            "portion": F.least(portion, F.lit(ARRIVALS - 1)).cast("int"),
        }
    )


def stream_velocity_mixed(spark, sf_dir):
    """Interleaved and late arrivals, stopped and resumed after each portion."""
    root = fresh_path(spark, "stream")
    rows = mixed_arrivals(txn(spark, sf_dir))
    for portion in range(ARRIVALS):
        _arrive(rows.where(F.col("portion") == portion).drop("portion"), f"{root}/in")
        start_velocity(
            tx.read_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint",
            late_path=f"{root}/late",
        ).awaitTermination()
    late = spark.read.parquet(f"{root}/late").select("event_id", F.lit(True).alias("late"))
    out = spark.read.parquet(f"{root}/out").select("event_id", *VELOCITY)
    return out.join(late, "event_id", "left").withColumn("late", F.coalesce("late", F.lit(False)))


def _monitored(spark, sf_dir) -> str:
    """Reports of a stream of scored rows in uneven portions, stopped and resumed after each."""
    root = fresh_path(spark, "monitored")
    path = fresh_path(spark, "scored")
    moved = F.when(F.col("event_id") % 10000 >= 5000, F.col("amount") * 1.5 + 1)
    features = fe.engineer_features(txn(spark, sf_dir)).withColumn(
        "amount", F.coalesce(moved, "amount")
    )
    dec.add_decision(tx.add_standin_score(features)).write.parquet(path)
    rows = spark.read.parquet(path)
    reference = dr.reference_snapshot(rows.where("step <= 100"))
    end = rows.agg(F.max("event_id")).first()[0] + 1
    settings = Settings(drift_window_size=2500, drift_threshold=0.05)
    for low, high in ((0.0, 0.21), (0.21, 0.22), (0.22, 0.8), (0.8, 1.0)):
        part = rows.where(F.col("event_id").between(int(low * end), int(high * end) - 1))
        _arrive(part, f"{root}/in")
        start_monitor(
            spark.readStream.schema(rows.schema).parquet(f"{root}/in"), reference,
            f"{root}/state", f"{root}/report", f"{root}/checkpoint", settings,
        ).awaitTermination()
    return f"{root}/report"


def stream_alerts(spark, sf_dir):
    """Without the message: engines round halves in text differently."""
    found = spark.read.parquet(f"{_monitored(spark, sf_dir)}/alerts").drop("batch", "message")
    return rounded(found)


def stream_drift(spark, sf_dir):
    """Drift of each window of 2,500 rows, whatever the portions."""
    summary = spark.read.parquet(f"{_monitored(spark, sf_dir)}/drift_summary")
    names = F.concat_ws(",", "drifted_features").alias("drifted_features")
    return summary.select(
        "window", "is_drifted", "drift_ratio", names, "current_size", "reference_size"
    )


def stream_scoring(spark, sf_dir):
    model, _, explainer = fitted_model(spark, sf_dir)
    root = fresh_path(spark, "scoring")
    paths = ScoringPaths.below(root)
    value = F.to_json(F.struct(*[c for c in TXN_COLUMNS if c != "event_id"]))
    messages = spoiled(txn(spark, sf_dir)).select("event_id", value.alias("value"))
    for _ in _arrivals(messages, f"{root}/in"):
        stream = spark.readStream.schema(messages.schema).parquet(f"{root}/in")
        start_scoring(stream, model, explainer, paths).awaitTermination()
    out = spark.read.parquet(paths.decisions).drop("batch")
    return out.withColumn("top_features", F.to_json("top_features"))


def stream_scoring_checks(spark, sf_dir):
    """The stream's decision of each accepted row against the batch path over the same rows."""
    model, _, _ = fitted_model(spark, sf_dir)
    rows = va.valid_rows(spoiled(txn(spark, sf_dir)))
    batch = dec.to_decision_records(
        dec.add_decision(mo.add_scores(fe.engineer_features(rows, "shared"), model))
    )
    keys = ["step", "nameOrig", "nameDest", "amount", "type", "risk_score", "decision"]
    streamed = stream_scoring(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))
    counted = batch.groupBy(*keys).agg(F.count("*").alias("m"))
    both = streamed.join(counted, keys, "full")
    same = F.coalesce(F.col("n") == F.col("m"), F.lit(False))
    return both.agg(
        F.sum("n").cast("long").alias("decisions"), F.count_if(~same).alias("differing")
    )


QUERIES = {
    f.__name__: f
    for f in (
        decision_report, txn_scan, split_summary, partitioned_table, csv_round_trip,
        validate_rows, valid_rows, quarantine_rows, fraud_only, replay_order, replay_cap,
        rename_columns, wire_fields, message_quarantine, newest_by_arrival, publish_dry_run,
        published_totals, preview, table_shape,
        balance_errors, balance_errors_alt, type_dummies, dummies_drop_first, velocity_by_role,
        velocity_by_role_hot, velocity_shared, velocity_shared_hot, velocity_mode_diff,
        features_batch, features_online, feature_matrix, decision_bands, decision_guard,
        decision_records, decision_log, flagged_rows, decision_mix, interesting_cases,
        first_frauds, compare_scores, top_k_features, label_share, type_counts, step_range,
        amount_range_by_label, label_counts, null_counts, duplicate_rows, xtab_type_label,
        xtab_flag_label, fraud_rate_by_type, describe_amount, describe_errors, fraud_types,
        distinct_parties, distinct_parties_by_day, percentiles_by_day, zero_dest_share, nonzero_error_share, nonzero_error_rows,
        semi_join_counts, member_rows, fraud_rings, ring_members, payment_degrees,
        cash_out_chains, cash_out_chains_hot, asof_last_received, asof_last_received_hot,
        asof_step_profile, rolling_hour, rolling_day_hot, median_scores, isolation_scores,
        class_ratio, threshold_sweep, predictions, confusion,
        class_report, average_precision, pr_curve, best_f1, monitor_summary, monitor_points, monitor_alert,
        latency_alert, progress_batches, ks_by_feature, chi2_dummies, drift_by_column,
        drift_summary, retrain_trigger, score_drift, ap_by_bucket, promotion_rule,
        champion_lookup, next_version, retrain_window, gbt_score_checks, gbt_explain_checks,
        logistic_score_checks, stream_scoring_checks, gbt_scores, gbt_explain, gbt_importance,
        gbt_quality, model_versions, logistic_scores, retrain_cycle, stream_velocity,
        stream_velocity_mixed, stream_alerts, stream_drift, stream_scoring,
    )
}
