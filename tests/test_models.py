"""Training, scoring, explanation and the jobs built on them."""

import itertools
import math
from dataclasses import replace

import numpy as np
import pytest

from catalog import queries as q
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from riskloom.operators import explain as xp
from riskloom.operators import features as fe
from riskloom.operators import model as mo
from riskloom.operators import registry as reg
from riskloom.plans import demo, retrain, score, train
from riskloom.schemas import DECISION_SCHEMA, MODEL_FEATURES
from riskloom.settings import Settings
from riskloom.sources.workspace import fresh_path

TINY = replace(q.QUERY_MODEL, rounds=6, max_depth=3)


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    return q.fitted_model(spark, sf_dir)


@pytest.fixture(scope="module")
def test_features(spark, sf_dir):
    path = fresh_path(spark, "test-features")
    fe.engineer_features(q.test_rows(spark, sf_dir), "shared").write.parquet(path)
    return spark.read.parquet(path)


def margins(model, df):
    rows = model.transform(fe.assemble(df)).select(
        vector_to_array("features").alias("x"), vector_to_array("rawPrediction").alias("raw")
    )
    found = rows.toPandas()
    return np.array(found["x"].tolist()), np.array(found["raw"].tolist())[:, 1]


def test_contributions_add_up_to_the_margin(fitted, test_features):
    model, _, explainer = fitted
    trees = explainer.trees
    x, raw = margins(model, test_features)
    phi = xp.shapley(x, trees, [xp.contribution_tables(g) for g in trees])
    assert np.abs(phi.sum(axis=1) + xp.base_value(trees) - 2 * raw).max() < 1e-9


def test_prefix_scores_end_at_the_model(fitted, test_features):
    model, _, explainer = fitted
    trees = explainer.trees
    x, raw = margins(model, test_features)
    found = xp.prefix_margins(x, trees, [1, 7, 20])
    assert np.abs(found[:, -1] - 2 * raw).max() < 1e-9


def expectation(tree, node, x, known):
    """Expected value below a node when only the features in `known` are given."""
    if node["leftChild"] < 0:
        return node["weight"] * node["prediction"] * 2
    left, right = tree[node["leftChild"]], tree[node["rightChild"]]
    f = node["feature_index"]
    if f in known:
        return expectation(tree, left if x[f] <= node["threshold"] else right, x, known)
    return sum(
        child["rows"] / node["rows"] * expectation(tree, child, x, known)
        for child in (left, right)
    )


def test_contributions_equal_brute_force(spark, sf_dir, test_features):
    rows = fe.engineer_features(q.train_rows(spark, sf_dir), "shared")
    model = mo.train_boosted(rows, params=replace(TINY, rounds=3))
    path = fresh_path(spark, "brute")
    model.write().save(path)
    trees = {}
    for r in xp.node_table(spark, path).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    used = sorted(
        {r["feature_index"] for t in trees.values() for r in t.values() if r["leftChild"] >= 0}
    )
    x, _ = margins(model, test_features.orderBy("event_id").limit(15))
    groups = xp.read_trees(spark, path)
    phi = xp.shapley(x, groups, [xp.contribution_tables(g) for g in groups])

    def value(row, known):
        return sum(expectation(t, t[0], row, known) for t in trees.values())

    k = len(used)
    for row, got in zip(x, phi):
        for f in used:
            others = [g for g in used if g != f]
            want = sum(
                math.factorial(size) * math.factorial(k - 1 - size) / math.factorial(k)
                * (value(row, {*s, f}) - value(row, set(s)))
                for size in range(k)
                for s in itertools.combinations(others, size)
            )
            assert got[f] == pytest.approx(want, abs=1e-9)


def test_explanation_gate(fitted, test_features):
    model, _, explainer = fitted
    scored = mo.add_scores(test_features, model, keep_vector=True)
    out = xp.add_contributions(scored, explainer, explain_from=0.3)
    sizes = {
        (r["above"], r["n"])
        for r in out.select(
            (F.col("risk_score") >= 0.3).alias("above"), F.size("contributions").alias("n")
        ).distinct().collect()
    }
    assert sizes == {(True, 10), (False, 0)}


def test_scores_beat_the_base_rate(spark, sf_dir):
    base = q.test_rows(spark, sf_dir).agg(F.avg("isFraud")).first()[0]
    assert q.gbt_quality(spark, sf_dir).first()["pr_auc"] > 3 * base


def test_importance_counts_every_split(spark, sf_dir, fitted):
    _, root, _ = fitted
    rows = q.gbt_importance(spark, sf_dir).collect()
    inner = xp.node_table(spark, f"{root}/v1").where("leftChild >= 0").count()
    assert {r["feature"] for r in rows} == set(MODEL_FEATURES)
    assert sum(r["splits"] for r in rows) == inner
    assert sum(r["gain"] for r in rows) == pytest.approx(1.0)
    assert [r["splits"] for r in rows] == sorted((r["splits"] for r in rows), reverse=True)


def test_missing_version_says_what_to_do(spark):
    with pytest.raises(FileNotFoundError, match="riskloom.plans.train"):
        mo.load_model(spark, fresh_path(spark, "nothing"), "v7")


@pytest.mark.parametrize(
    "scores, expected",
    [
        ([(10, 0.1), (20, 0.3), (30, 0.2), (70, 0.25), (80, 0.9)], 20),
        ([(10, 0.1), (20, 0.3), (60, 0.4)], 60),
        ([(10, 0.0), (20, 0.0)], 10),
    ],
)
def test_choose_rounds(scores, expected):
    assert mo.choose_rounds(scores, patience=50) == expected


def test_logistic_separates_a_plain_signal(spark, sf_dir):
    rows = q.txn(spark, sf_dir).withColumn(
        "isFraud", (F.col("amount") > 100).cast("int")
    )
    model, known = mo.train_logistic(rows.where("step <= 500"))
    scored = mo.add_logistic_scores(rows.where("step > 500"), model, known)
    means = {r[0]: r[1] for r in scored.groupBy("isFraud").avg("risk_score").collect()}
    assert means[1] > 0.8 and means[0] < 0.2
    assert set(scored.columns) == {*rows.columns, "risk_score"}


def test_training_job_then_batch_scoring(spark, sf_dir):
    root = fresh_path(spark, "job-models")
    rows = q.txn(spark, sf_dir)
    model, result, explained = train.run(
        rows, root, "v1", params=replace(TINY, rounds=12, probe_every=6, patience=6)
    )
    assert 0.0 < result.pr_auc <= 1.0
    assert 0.0 < result.best_threshold < 1.0
    assert result.report.count() == 5
    assert [len(r["top_features"]) for r in explained.collect()] == [5, 5, 5]
    assert [r["version"] for r in mo.list_versions(spark, root).collect()] == ["v1"]
    assert [r["version"] for r in reg.read_runs(spark, f"{root}/_runs").collect()] == ["v1"]

    explainer = xp.Explainer.load(spark, f"{root}/v1")
    records = score.score_transactions(
        q.test_rows(spark, sf_dir), model, explainer, explain_k=5, explain_from=0.2
    )
    assert {f.name: f.dataType for f in records.schema} == {
        f.name: f.dataType for f in DECISION_SCHEMA
    }
    assert records.count() == q.test_rows(spark, sf_dir).count()


def test_retraining_promotes_then_keeps(spark, sf_dir):
    root = fresh_path(spark, "retrain-models")
    rows = q.txn(spark, sf_dir)
    run = {"params": TINY, "early_stopping": False}
    first = retrain.run(rows, root, "manual", **run)
    second = retrain.run(rows, root, "drift", 0.4, **run)
    third = retrain.run(rows, root, "manual", force_promote=True, **run)
    assert (first.new_version, first.promoted, first.champion_pr_auc) == ("v1", True, 0.0)
    # The same rows and seed give the same model, which is no improvement.
    assert (second.new_version, second.promoted) == ("v2", False)
    assert second.improvement == pytest.approx(0.0, abs=1e-9)
    assert (third.new_version, third.promoted) == ("v3", True)
    runs = reg.read_runs(spark, f"{root}/_runs")
    assert {r["version"]: r["promoted"] for r in runs.collect()} == {
        "v1": True, "v2": False, "v3": True,
    }
    assert reg.champion(runs).first()["version"] == "v3"
    assert [r[0] for r in mo.list_versions(spark, root).collect()] == ["v1", "v3"]


def test_lost_champion_is_an_error(spark, sf_dir):
    root = fresh_path(spark, "lost")
    reg.append_run(spark, f"{root}/_runs", "v1", 0.9, 0.9, "manual", None, True)
    with pytest.raises(FileNotFoundError):
        retrain.run(q.txn(spark, sf_dir), root, params=TINY, early_stopping=False)


def test_retrain_window_includes_both_ends(spark):
    steps = spark.range(1, 21).withColumnRenamed("id", "step")
    assert retrain.recent_window(steps, 5).agg(F.min("step")).first()[0] == 15
    assert retrain.recent_window(steps, 500).count() == 20


def test_demo_runs_end_to_end(spark, sf_dir):
    out = demo.run(q.txn(spark, sf_dir), TINY)
    assert out["split"].count() == 2
    assert sum(r["rows"] for r in out["decisions"].collect()) == demo.REPLAYED
    assert out["cases"].count() <= 10
    assert out["drift"].first()["reference_size"] > 0
    assert out["explained"].count() == 3


def test_settings_bands_are_used_when_scoring(spark, fitted, test_features):
    from riskloom.streaming.scoring import score_enriched

    model, _, explainer = fitted
    strict = Settings(review_threshold=0.0, block_threshold=0.0)
    out = score_enriched(test_features, model, explainer, strict, explain_from=2.0)
    assert [r[0] for r in out.select("decision").distinct().collect()] == ["BLOCK"]


def test_first_trees_equal_a_shorter_fit(spark, sf_dir):
    rows = fe.engineer_features(q.train_rows(spark, sf_dir), "shared").select(*MODEL_FEATURES, "isFraud")
    stored = fresh_path(spark, "t-first-trees")
    rows.write.parquet(f"{stored}/rows")
    rows = spark.read.parquet(f"{stored}/rows")
    mo.train_boosted(rows, params=TINY).write().save(f"{stored}/model")
    cut = mo.first_trees(spark, f"{stored}/model", 3)
    fitted_again = mo.train_boosted(rows, params=replace(TINY, rounds=3))
    assert cut.getNumTrees == fitted_again.getNumTrees == 3
    assert cut.toDebugString.split("\n")[1:] == fitted_again.toDebugString.split("\n")[1:]
