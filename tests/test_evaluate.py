"""Scores against labels, percentiles, drift tests, monitoring and registry: golden cases."""

import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from pyspark.sql import functions as F
from riskloom.functions.columns import decision_of, top_contributions
from riskloom.functions.stats import chi2_one_dof_p, exact_ks_p
from riskloom.operators import decisions as dec
from riskloom.operators import drift as dr
from riskloom.operators import evaluate as ev
from riskloom.operators import monitor as mon
from riskloom.operators import quantiles as qu
from riskloom.operators import registry as reg
from riskloom.schemas import MODEL_FEATURES
from riskloom.settings import Settings
from riskloom.sources.workspace import fresh_path


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "isFraud int, risk_score double")


def brute_average_precision(pairs):
    positives = sum(y for y, _ in pairs)
    if not positives:
        return 0.0
    total = 0.0
    for t in {s for _, s in pairs}:
        above = [y for y, s in pairs if s >= t]
        total += sum(y for y, s in pairs if s == t) / positives * sum(above) / len(above)
    return total


@pytest.mark.parametrize("seed", range(3))
def test_average_precision_and_best_f1(spark, seed):
    pick = random.Random(seed)
    pairs = [
        (int(pick.random() < 0.2), pick.choice([pick.random(), 0.25, 0.5, 1e-9 * pick.random()]))
        for _ in range(300)
    ]
    df = scores(spark, pairs)
    got = ev.average_precision(df).first()["pr_auc"]
    assert got == pytest.approx(brute_average_precision(pairs), abs=1e-12)
    assert 0.0 <= got <= 1.0

    positives = sum(y for y, _ in pairs)
    best = max(
        (
            (2 * sum(y for y, s in pairs if s >= t) / (sum(s >= t for _, s in pairs) + positives), -t)
            for t in {s for _, s in pairs}
        )
    )
    row = ev.best_f1(df).first()
    assert (row["best_f1"], row["best_threshold"]) == (best[0], -best[1])


def test_no_positive_labels(spark):
    df = scores(spark, [(0, 0.1), (0, 0.9)])
    assert ev.average_precision(df).first()["pr_auc"] == 0.0
    assert ev.class_ratio(df).first()["positive_weight"] == 2.0
    assert {r["recall"] for r in ev.pr_curve(df).where("threshold is not null").collect()} == {1.0}
    fraud = {r["class"]: r for r in ev.class_report(df).collect()}["Fraud"]
    assert (fraud["precision"], fraud["recall"], fraud["f1"], fraud["support"]) == (0, 0, 0, 0)


def test_all_scores_equal(spark):
    df = scores(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)])
    assert ev.average_precision(df).first()["pr_auc"] == 0.25
    assert ev.best_f1(df).first()["best_threshold"] == 0.5


def test_confusion_has_all_cells(spark):
    got = [tuple(r) for r in ev.confusion(scores(spark, [(1, 0.9)])).collect()]
    assert sorted(got) == [(0.5, 0, 0, 0), (0.5, 0, 1, 0), (0.5, 1, 0, 0), (0.5, 1, 1, 1)]


def test_decision_bands(spark):
    df = spark.createDataFrame([(0.2999,), (0.3,), (0.6999,), (0.7,)], "s double")
    got = [r[0] for r in df.select(decision_of("s")).collect()]
    assert got == ["APPROVE", "REVIEW", "REVIEW", "BLOCK"]


def test_decision_mix_lists_missing_bands(spark):
    df = dec.add_decision(scores(spark, [(0, 0.1), (0, 0.2)]))
    got = {r["decision"]: (r["rows"], r["percent"]) for r in dec.decision_mix(df).collect()}
    assert got == {"APPROVE": (2, 100.0), "REVIEW": (0, 0.0), "BLOCK": (0, 0.0)}


def test_top_contributions_ties_keep_feature_order(spark):
    df = spark.sql(
        "SELECT array(named_struct('feature','a','value',0.5D), named_struct('feature','b','value',"
        "-0.5D), named_struct('feature','c','value',-0.70006D)) AS contributions"
    )
    top = df.select(top_contributions("contributions", 2).alias("t")).first()["t"]
    assert [(t["feature"], t["value"]) for t in top] == [("c", -0.7001), ("a", 0.5)]


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_exact_percentiles(spark, n):
    pick = random.Random(n)
    data = [(i % 2, round(pick.gauss(0, 500), 2)) for i in range(n)]
    df = spark.createDataFrame(data, "g int, v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    for r in qu.exact_percentiles(df, "v", wanted, ["g"]).collect():
        values = [v for g, v in data if g == r["g"]]
        for name, p in wanted.items():
            assert r[name] == pytest.approx(np.percentile(values, 100 * p), abs=1e-9)


# -- drift --------------------------------------------------------------------------------------


def ks_brute(a, b):
    points = sorted({*a, *b})
    return max(
        abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points
    )


def sample(spark, values):
    return spark.createDataFrame([(v,) for v in values], "amount double")


def test_ks_statistic_is_symmetric_and_ignores_nulls(spark):
    pick = random.Random(3)
    a = [round(pick.gauss(0, 300), 2) for _ in range(150)]
    b = [round(pick.gauss(60, 300), 2) for _ in range(90)] + [a[0]] * 30
    one = dr.two_samples(sample(spark, [*a, None]), sample(spark, b))
    two = dr.two_samples(sample(spark, b), sample(spark, a))
    rows = [dr.ks_by_feature(s, ["amount"]).first() for s in (one, two)]
    assert rows[0]["ks_stat"] == rows[1]["ks_stat"] == round(ks_brute(a, b), 4)
    assert rows[0]["p_value"] == rows[1]["p_value"]
    assert rows[0]["reference_rows"] == 150


def test_windows_against_one_reference_equal_a_copy_for_each(spark):
    pick = random.Random(8)
    features = ["amount", "step", "none", "gone"]

    def sample(rows, shift):
        return [
            (pick.choice([None, float("nan"), 0.0, -0.0, pick.randrange(40) + shift, pick.random()]),
             float(pick.randrange(3)), None, None if shift else 1.0, i % 3 + 2)
            for i in range(rows)
        ]

    schema = "amount double, step double, none double, gone double, window long"
    reference = spark.createDataFrame(sample(300, 0.0), schema).drop("window")
    current = spark.createDataFrame(sample(180, 30.0), schema).where("window < 4 or amount is null")
    copied = dr.ks_by_feature(dr.window_samples(reference, current, 2, 5), features, by=["window"])
    found = dr.ks_by_window(reference, current, 2, 5, features)
    rows = sorted(map(tuple, copied.collect()))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
    assert len(rows) == 12 and any(r[-1] for r in rows)
    # The reference is read as it is: no row of it is made again for a window.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(2, 5" not in plan and "explode" not in plan


def test_same_sample_has_no_drift(spark):
    same = sample(spark, [1.0, 2.0, 3.0])
    row = dr.ks_by_feature(dr.two_samples(same, same), ["amount"]).first()
    assert (row["ks_stat"], row["p_value"], row["drifted"]) == (0.0, 1.0, False)


@pytest.mark.parametrize("n, m", [(3, 4), (5, 5), (2, 7)])
def test_exact_p_value_by_enumeration(spark, n, m):
    def stat(places):
        best, i, j = 0, 0, 0
        for k in range(n + m):
            if k in places:
                i += 1
            else:
                j += 1
            best = max(best, abs(i * m - j * n))
        return best

    walks = [stat(set(c)) for c in itertools.combinations(range(n + m), n)]
    limits = sorted(set(walks))
    df = spark.createDataFrame([(h / (n * m), n, m) for h in limits], "d double, n long, m long")
    got = [r[0] for r in df.select(exact_ks_p()("d", "n", "m")).collect()]
    assert got == pytest.approx([sum(w >= h for w in walks) / len(walks) for h in limits])


def test_exact_and_asymptotic_agree_for_large_samples(spark):
    pick = random.Random(5)
    a, b = ([pick.gauss(mu, 1) for _ in range(900)] for mu in (0, 0.06))
    samples = dr.two_samples(sample(spark, a), sample(spark, b))
    p = [
        dr.ks_by_feature(samples, ["amount"], method).first()["p_value"]
        for method in ("exact", "asymptotic")
    ]
    assert p[0] == pytest.approx(p[1], abs=0.02)


def test_chi2_p_value(spark):
    df = spark.createDataFrame([(0.0,), (3.841458820694124,), (10.0,)], "x double")
    got = [r[0] for r in df.select(chi2_one_dof_p(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(math.sqrt(x / 2)) for (x,) in df.collect()], rel=1e-6)


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="missing columns"):
        dr.check_drift(dr.two_samples(sample(spark, [1.0]), sample(spark, [2.0])))


@pytest.mark.parametrize("drifted, flag", [(3, False), (4, True)])
def test_drift_flag_needs_more_than_three_features(spark, drifted, flag):
    tests = spark.createDataFrame(
        [(f, i < drifted, 7, 9) for i, f in enumerate(MODEL_FEATURES)]
        + [("risk_score", True, 7, 9)],
        "feature string, drifted boolean, reference_rows long, current_rows long",
    )
    row = dr.drift_summary(tests).first()
    assert row["is_drifted"] is flag
    assert row["drift_ratio"] == drifted / 10
    assert row["drifted_features"] == list(MODEL_FEATURES[:drifted])
    assert (row["reference_size"], row["current_size"]) == (7, 9)
    trigger = reg.should_retrain(dr.drift_summary(tests)).first()
    assert (trigger["retrain"], trigger["trigger"]) == (flag, "drift" if flag else None)


def test_drift_report_tables(spark):
    pick = random.Random(1)
    rows = [tuple(pick.random() for _ in MODEL_FEATURES) for _ in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in MODEL_FEATURES))
    summary, tests = dr.check_drift(dr.two_samples(df, df.withColumn("amount", F.lit(5.0))))
    path = fresh_path(spark, "drift")
    dr.save_drift_report(summary, tests, path)
    dr.save_drift_report(summary, tests, path)
    assert spark.read.parquet(f"{path}/drift_summary").count() == 2
    saved = spark.read.parquet(f"{path}/drift_features")
    assert {r["feature"] for r in saved.where("drifted").collect()} == {"amount"}


# -- monitoring ---------------------------------------------------------------------------------


def watched(spark, n, blocked, latency=50.0):
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        (F.col("id") / n).alias("risk_score"),
        F.when(F.col("id") < blocked, "BLOCK").otherwise("APPROVE").alias("decision"),
        F.lit(latency).alias("latency_ms"),
    )


def test_no_data_no_alert(spark):
    summary = mon.monitor_summary(watched(spark, 1, 0).where("false"))
    assert summary.first()["status"] == "no data"
    assert mon.alerts(summary).count() == 0


@pytest.mark.parametrize(
    "n, blocked, latency, expected",
    [
        (10_000, 101, 50.0, ["block_rate"]),
        (10_000, 100, 50.0, []),
        (10_000, 100, 100.5, ["latency"]),
        (10_000, 500, 500.0, ["block_rate"]),
    ],
)
def test_alerts(spark, n, blocked, latency, expected):
    found = mon.alerts(mon.monitor_summary(watched(spark, n, blocked, latency)))
    assert [r["alert"] for r in found.collect()] == expected


def test_window_is_recent_but_counts_are_lifetime(spark):
    row = mon.monitor_summary(watched(spark, 1000, 500), window_rows=100).first()
    assert row["window_size"] == 100
    assert row["score_mean"] == pytest.approx(np.mean(np.arange(900, 1000) / 1000))
    assert row["score_p95"] == pytest.approx(np.percentile(np.arange(900, 1000) / 1000, 95))
    assert row["block_rate"] == 0.5


def test_progress_counts_full_batches_only(spark):
    df = watched(spark, 2500, 1200).withColumn("latency_ms", F.col("event_id") * 1.0)
    got = [tuple(r) for r in mon.progress_batches(df).orderBy("processed").collect()]
    assert got == [(1000, 1000, 990.0), (2000, 1200, 1990.0)]


# -- registry -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "new, force, expected",
    [(0.931, False, False), (0.935, False, True), (0.5, True, True), (0.934999, False, False)],
)
def test_promotion_rule(spark, new, force, expected):
    assert reg.is_promotion(new, 0.930, 0.005, force) is expected
    df = spark.createDataFrame([(new, 0.930)], "a double, b double")
    assert df.select(reg.promotes(F.col("a"), F.col("b"), 0.005, force)).first()[0] is expected


def test_registry_round_trip(spark):
    path = fresh_path(spark, "runs")
    assert reg.champion(reg.read_runs(spark, path)).count() == 0
    assert reg.next_version(reg.read_runs(spark, path)).first()[0] == "v1"
    day = datetime(2024, 1, 1)
    reg.append_run(spark, path, "v1", 0.8, 0.8, "manual", None, True, day)
    reg.append_run(spark, path, "v9", 0.9, 0.1, "drift", 0.4, True, day + timedelta(1))
    reg.append_run(spark, path, "v10", 0.9, 0.0, "scheduled", None, False, day + timedelta(2))
    reg.append_run(spark, path, "vnext", 0.1, 0.0, "manual", None, False, day + timedelta(3))
    runs = reg.read_runs(spark, path)
    assert reg.champion(runs).first()["version"] == "v9"
    assert reg.next_version(runs).first()[0] == "v11"
    with pytest.raises(ValueError):
        reg.append_run(spark, path, "v11", 0.9, 0.0, "whim", None, False)


def test_settings_from_environment():
    given = Settings.from_env({"BLOCK_THRESHOLD": "0.8", "TRAINING_WINDOW_STEPS": "100"})
    assert (given.block_threshold, given.training_window_steps) == (0.8, 100)
    assert given.review_threshold == 0.3
    assert Settings(velocity_ttl_seconds=7200).velocity_ttl_steps == 2
    with pytest.raises(Exception):
        given.block_threshold = 0.1
