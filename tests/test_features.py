"""Golden cases and properties of validation, features and velocity."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from riskloom.operators import features as fe
from riskloom.operators import running as ru
from riskloom.operators import validate as va
from riskloom.schemas import MODEL_FEATURES
from tests.helpers import Simulation, by_event, txn_row, txns

VELOCITY = ("orig_tx_count_1h", "orig_amount_sum_1h", "dest_tx_count_1h")


@pytest.mark.parametrize(
    "old, new, amount, expected", [(500, 400, 100, 0), (181, 0, 181, 0), (181, 0, 500, -319)]
)
def test_balance_error(spark, old, new, amount, expected):
    row = txn_row(1, amount=float(amount), oldbalanceOrg=float(old), newbalanceOrig=float(new))
    out = fe.add_balance_errors(txns(spark, [row])).first()
    assert out["error_balance_orig"] == expected


def test_reversed_errors_are_negated(spark, sf_dir):
    from catalog.queries import txn

    rows = fe.add_balance_errors_reversed(fe.add_balance_errors(txn(spark, sf_dir)))
    for a, b in (
        ("errorBalanceOrig", "error_balance_orig"),
        ("errorBalanceDest", "error_balance_dest"),
    ):
        assert rows.where(F.abs(F.col(a) + F.col(b)) > 1e-9).count() == 0


def test_payment_is_the_baseline(spark):
    kinds = ["PAYMENT", "TRANSFER", "CASH_OUT", "CASH_IN", "DEBIT"]
    out = fe.add_type_dummies(txns(spark, [txn_row(i, kind=k) for i, k in enumerate(kinds)]))
    flags = by_event(out, "type_TRANSFER", "type_CASH_OUT", "type_CASH_IN", "type_DEBIT")
    assert flags[0] == (0, 0, 0, 0)
    assert [flags[i].index(1) for i in range(1, 5)] == [0, 1, 2, 3]


def test_same_pair_three_times(spark):
    rows = [txn_row(i, amount=a) for i, a in enumerate((10.0, 20.0, 30.0))]
    for mode in ("by_role", "shared"):
        out = by_event(fe.add_velocity(txns(spark, rows), mode), *VELOCITY)
        assert out == {0: (0, 0.0, 0), 1: (1, 10.0, 1), 2: (2, 30.0, 2)}


def test_receiver_then_sender(spark):
    rows = txns(spark, [txn_row(0), txn_row(1, orig="B", dest="C")])
    assert by_event(fe.add_velocity_shared(rows), *VELOCITY)[1] == (1, 10.0, 0)
    assert by_event(fe.add_velocity_by_role(rows), *VELOCITY)[1] == (0, 0.0, 0)


def test_self_transfer(spark):
    rows = txns(spark, [txn_row(0, dest="A"), txn_row(1)])
    assert by_event(fe.add_velocity_shared(rows), *VELOCITY) == {
        0: (0, 0.0, 0),
        1: (2, 20.0, 0),
    }


def test_next_step_starts_again(spark):
    rows = txns(spark, [txn_row(0), txn_row(1, step=2)])
    for mode in ("by_role", "shared"):
        assert by_event(fe.add_velocity(rows, mode), *VELOCITY)[1] == (0, 0.0, 0)


def random_events(seed, n, accounts, steps=3):
    pick = random.Random(seed)
    rows, step = [], 1
    for i in range(n):
        step += pick.random() < steps / n
        # One account takes part in about a third of all events.
        orig = "HOT" if pick.random() < 0.33 else f"C{pick.randrange(accounts)}"
        dest = f"C{pick.randrange(accounts)}" if pick.random() < 0.8 else orig
        rows.append(txn_row(i, step=step, orig=orig, dest=dest, amount=pick.randrange(1, 9999) / 100))
    return rows


@pytest.mark.parametrize("hot_rows, bits", [(None, 4), (10**6, 16), (5, 2), (40, 3), (0, 1)])
def test_shared_velocity_equals_simulation(spark, hot_rows, bits):
    rows = random_events(7, 600, 12)
    one = Simulation()
    expected = {
        r[0]: one.add(r[1], r[4], r[7], round(r[3] * 100)) for r in rows
    }
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    out = fe.add_velocity_shared(txns(spark, shuffled), hot_rows=hot_rows, slice_bits=bits)
    assert by_event(out, *VELOCITY) == expected


@pytest.mark.parametrize("hot_rows, bits", [(None, 4), (5, 2)])
def test_by_role_velocity_equals_simulation(spark, hot_rows, bits):
    rows = random_events(8, 500, 9)
    sent, received, expected = {}, {}, {}
    for r in rows:
        s, d = (r[1], r[4]), (r[1], r[7])
        n, c = sent.get(s, (0, 0))
        expected[r[0]] = (n, c / 100, received.get(d, 0))
        sent[s] = (n + 1, c + round(r[3] * 100))
        received[d] = received.get(d, 0) + 1
    out = fe.add_velocity_by_role(txns(spark, rows), hot_rows=hot_rows, slice_bits=bits)
    assert by_event(out, *VELOCITY) == expected


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-500, 500)), min_size=1, max_size=60))
def test_running_totals_by_levels(spark, pairs):
    rows = [(g, v, i + 1) for i, (g, v) in enumerate(sorted(set(pairs)))]
    df = ru.value_buckets(spark.createDataFrame(rows, "g int, v int, n long"), "v", ["g"])
    out = ru.running_totals(df, ["n"], ["v"], ru.VALUE_LEVELS, ["g"], overall=True)
    got = {(r["g"], r["v"]): (r["n_before"], r["n_all"]) for r in out.collect()}
    for g, v, _ in rows:
        same = [(w, n) for h, w, n in rows if h == g]
        assert got[(g, v)] == (sum(n for w, n in same if w < v), sum(n for _, n in same))


def test_dummies_follow_training_categories(spark):
    train = txns(spark, [txn_row(0, kind="TRANSFER"), txn_row(1, kind="CASH_IN")])
    test = txns(spark, [txn_row(2, kind="DEBIT"), txn_row(3, kind="TRANSFER")])
    known = fe.categories(train, "type")
    out = fe.add_dummies_drop_first(test, "type", known)
    assert known == ["CASH_IN", "TRANSFER"]
    assert by_event(out, "type_TRANSFER") == {2: (0,), 3: (1,)}
    assert "type_DEBIT" not in out.columns and "type" not in out.columns


def test_categories_refuse_a_key_column(spark):
    rows = txns(spark, [txn_row(i, orig=f"C{i}") for i in range(20)])
    with pytest.raises(ValueError):
        fe.categories(rows, "nameOrig", limit=10)


def test_vector_has_model_order_and_single_precision(spark):
    rows = fe.engineer_features(txns(spark, [txn_row(0, amount=0.1, oldbalanceOrg=7.0)]))
    vector = fe.assemble(rows).first()["features"].toArray().tolist()
    assert len(vector) == len(MODEL_FEATURES)
    assert vector[0] == pytest.approx(0.1) and vector[0] != 0.1
    assert vector[3] == 1.0


@pytest.mark.parametrize(
    "change, rule",
    [
        ({"amount": 0.0}, "amount"),
        ({"amount": float("nan")}, "amount"),
        ({"amount": None}, "amount"),
        ({"oldbalanceDest": -0.01}, "oldbalanceDest"),
        ({"newbalanceOrig": None}, "newbalanceOrig"),
        ({"type": "REFUND"}, "type"),
        ({"type": None}, "type"),
        ({"nameDest": None}, "nameDest"),
        ({"step": None}, "step"),
    ],
)
def test_bad_rows_are_quarantined(spark, change, rule):
    rows = txns(spark, [txn_row(0), txn_row(1, **change)])
    assert [r["event_id"] for r in va.valid_rows(rows).collect()] == [0]
    bad = va.quarantined_rows(rows).collect()
    assert [(r["event_id"], r["violations"]) for r in bad] == [(1, [rule])]


def test_missing_labels_are_valid(spark):
    rows = txns(spark, [txn_row(0, isFraud=None, isFlaggedFraud=None)])
    assert va.valid_rows(rows).count() == 1


def test_decision_guard(spark):
    df = spark.createDataFrame(
        [(0.5, "BLOCK"), (0.5, "REVIEW"), (0.7, "BLOCK"), (1.2, "BLOCK"), (None, "APPROVE")],
        "risk_score double, decision string",
    )
    broken = [(r["risk_score"], r["decision"]) for r in va.decision_violations(df).collect()]
    assert broken == [(0.5, "BLOCK"), (1.2, "BLOCK"), (None, "APPROVE")]
    strict = va.require_matching_decisions(df.where("risk_score = 0.7"))
    assert strict.count() == 1
    with pytest.raises(Exception, match="inconsistent"):
        va.require_matching_decisions(df).collect()


def test_accounts_of_small_steps_are_not_counted(spark):
    """Rows of a step with fewer rows than a hot account has don't reach the counters."""
    calm = [txn_row(i, step=1, orig="A", dest=f"B{i}") for i in range(5)]
    busy = [txn_row(5 + i, step=2, orig="A" if i % 2 else f"C{i}", dest=f"D{i}") for i in range(20)]
    rows = txns(spark, calm + busy)
    hot = fe.hot_accounts(rows, 8)
    assert [tuple(r) for r in hot.select("step", "account").collect()] == [(2, "A")]
    assert [tuple(r) for r in fe.hot_accounts(rows, 4).select("step", "account").orderBy("step").collect()] == [
        (1, "A"), (2, "A")
    ]
    told = spark.createDataFrame([(1, 10), (2, 8)], "step bigint, __rows bigint")
    sides = rows.select("step", F.explode(F.array("nameOrig", "nameDest")).alias("account"))
    assert ru.hot_groups(sides, ["step", "account"], 8, told).count() == 0
