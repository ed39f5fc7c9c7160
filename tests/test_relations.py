"""Graphs, lookups along an order, sliding totals and anomaly scores against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import anomaly as an
from riskloom.operators import asof
from riskloom.operators import graph as gr
from riskloom.operators.running import hot_groups
from tests.helpers import txn_row, txns


def plain_labels(links):
    label = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        if a in label and b in label and a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return {x: top(x) for x in label}


@pytest.mark.parametrize("hub_rows", [1_000_000, 3])
def test_components_and_degrees(spark, hub_rows):
    rng = random.Random(hub_rows)
    links = [(0, i) for i in range(1, 40)]  # a hub
    links += [(100 + i, 101 + i) for i in range(20)]  # a chain
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    links += [(5, None), (None, 6), (None, None), (300, 300), (0, 1), (1, 0)]
    table = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in gr.components(table, hub_rows).collect()}
    assert got == plain_labels(links)
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    degrees = {r.node: r.degree for r in gr.degrees(table).collect()}
    assert degrees == {k: len(v) for k, v in near.items()}
    none = table.limit(0)
    assert gr.components(none, hub_rows).count() == gr.degrees(none).count() == 0


@pytest.mark.parametrize("hub_rows", [1_000_000, 2])
def test_rings_of_the_whole_table(spark, hub_rows):
    fraud = dict(isFraud=1)
    rows = [
        txn_row(0, orig="A", dest="B", amount=1.5, **fraud),
        txn_row(1, orig="B", dest="C", kind="CASH_OUT", amount=2.5, **fraud),
        txn_row(2, orig="A", dest="B", amount=3.0, **fraud),
        txn_row(3, orig="X", dest="Y", **fraud),
        txn_row(4, orig="C", dest="X"),
        txn_row(5, orig="Q", dest="Q", **fraud),
        txn_row(6, orig="C", dest="X", kind="PAYMENT", **fraud),
    ]
    rings, members = gr.fraud_rings(txns(spark, rows), min_frauds=3, hub_rows=hub_rows)
    assert [tuple(r) for r in rings.collect()] == [(0, "A", 3, 3, 7.0)]
    assert sorted(r["account"] for r in members.collect()) == ["A", "B", "C"]
    rings, members = gr.fraud_rings(txns(spark, rows[4:5]), hub_rows=hub_rows)
    assert rings.count() == members.count() == 0


@pytest.mark.parametrize("hot_rows, bits", [(None, 16), (3, 2), (3, 0)])
def test_as_of_equals_a_loop(spark, hot_rows, bits):
    rng = random.Random(7)
    keys = ["hot"] * 5 + ["a", "b", None]
    left = [(i, rng.choice(keys), rng.choice([None, *range(30)])) for i in range(120)]
    right = [(rng.choice(keys), rng.choice([None, *range(30)]), rng.randrange(9)) for _ in range(80)]
    asked = spark.createDataFrame(left, "id int, k string, t long")
    given = spark.createDataFrame(right, "k string, t long, v int")
    hot = None
    if hot_rows is not None:
        hot = hot_groups(asked.select("k").union(given.select("k")), ["k"], hot_rows)
    got = {r.id: (r.k, r.t, r.v) for r in asof.as_of(asked, given, ["k"], "t", hot, bits).collect()}
    for i, k, t in left:
        before = [(s, v) for j, s, v in right if j == k and None not in (k, s, t) and s <= t]
        assert got[i] == (k, t, max(before)[1] if before else None)
    with pytest.raises(ValueError):
        asof.as_of(asked, given.withColumn("id", F.lit(1)), ["k"], "t")


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_sliding_totals_equal_a_loop(spark, hot_rows):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "x", "y"]), rng.randrange(-50, 50), rng.randrange(9)) for i in range(150)]
    table = spark.createDataFrame(rows, "event_id long, k string, t long, n long")
    hot = None if hot_rows is None else hot_groups(table, ["k"], hot_rows)
    got = asof.sliding_totals(table, ["k"], "t", 12, ["n"], hot=hot, slice_bits=3)
    want = {
        i: sum(m for j, k2, s, m in rows if k2 == k and t - 12 <= s and (s, j) < (t, i))
        for i, k, t, _ in rows
    }
    assert {r.event_id: r.n_in_window for r in got.collect()} == want


def test_median_scores_of_odd_values(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("a", float("nan")), ("b", 5.0), ("b", 5.0)]
    table = spark.createDataFrame(rows, "type string, v double")
    got = an.median_scores(table, ["v"]).select("v", "v_score", "anomaly_score").collect()
    scores = {r.v: (r.v_score, r.anomaly_score) for r in got if r.v is not None and r.v == r.v}
    assert scores[4.0] == pytest.approx((0.6745 * 2, 0.6745 * 2))
    assert scores[1.0] == pytest.approx((-0.6745, 0.6745))
    assert scores[5.0] == (None, None)
    assert all(r.v_score is None for r in got if r.v is None or r.v != r.v)


def plain_path(forest, root, x):
    node, depth = root, 0
    while forest.feature[node] >= 0:
        node = forest.left[node] if x[forest.feature[node]] < forest.cut[node] else forest.right[node]
        depth += 1
    return depth + forest.cut[node]


def test_isolation_forest_against_a_walk(spark):
    rng = np.random.default_rng(9)
    values = rng.normal(size=(3000, 3)).tolist()
    values += [[9.0, -9.0, 9.0], [12.0, 0.0, -11.0], [None, float("nan"), 0.0]]
    table = spark.createDataFrame(
        [(i, *x) for i, x in enumerate(values)], "event_id long, a double, b double, c double"
    )
    names = ["a", "b", "c"]
    forest = an.grow_forest(table.repartition(5), names, trees=60, sample_rows=64)
    again = an.grow_forest(table.repartition(3), names, trees=60, sample_rows=64)
    assert (forest.cut == again.cut).all() and len(forest.roots) == 60
    got = {r.event_id: r.isolation_score for r in an.add_isolation_scores(table, forest, names).collect()}
    n = forest.sample_rows  # about 3003 rows for 60 trees
    assert 40 < n < 60
    usual = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    for i in (0, 17, 3000, 3002):
        x = [0.0 if v is None or v != v else v for v in values[i]]
        mean = np.mean([plain_path(forest, r, x) for r in forest.roots])
        assert got[i] == pytest.approx(2 ** (-mean / usual))
    ranked = sorted(got, key=got.get, reverse=True)
    # Beyond the sampled values an outlier shares the path of the outermost of them.
    assert {3000, 3001} <= set(ranked[:100]) and 3000 in ranked[:5]
    assert 0.3 < np.median(list(got.values())) < 0.55
    assert an.add_isolation_scores(table.limit(0), forest, names).count() == 0
    assert len(an.grow_forest(table.limit(0), names).roots) == 0


def test_numbers_are_taken_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    from riskloom.operators import registry as reg
    from riskloom.sources.workspace import fresh_path

    path = fresh_path(spark, "t-versions")
    runs = reg.read_runs(spark, path)
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: reg.reserve_version(spark, path, runs), range(16)))
    assert sorted(got, key=lambda v: int(v[1:])) == [f"v{i}" for i in range(1, 17)]


def test_sketches_merge(spark):
    from riskloom.operators import sketches as sk

    rows = [txn_row(i, step=1 + i % 10, orig=f"A{i % 3000}", dest=f"B{i % 7}", amount=float(i)) for i in range(9000)]
    table = txns(spark, rows)
    steps = sk.party_sketches(table)
    merged = sk.merged_parties(steps, F.lit(0)).first()
    assert merged["rows"] == 9000 and merged["receivers"] == 7
    assert abs(merged["senders"] - 3000) <= 60
    sketches = sk.value_sketches(table, ["amount"], ["step"])
    whole = sk.merged_values(sketches, ["amount"], F.lit(0)).select(sk.percentile("amount", 0.9).alias("p"))
    assert abs(whole.first()["p"] - 8100) <= 0.01 * 9000
    assert sk.party_sketches(table.limit(0)).count() == 0
