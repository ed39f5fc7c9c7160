"""Every registered query against its SQL, and every other one for rows."""

import math

import pytest

import __spark_entry__ as spark_entry
from tests.conftest import SF_DIR

QUERIES = spark_entry.queries()
ORACLE = spark_entry.oracle_sql()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf_dir, duck):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLE[name])
    columns = [d[0] for d in expected.description]
    want = table(columns, expected.fetchall())
    got = table(result.columns, [tuple(r) for r in result.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert len(got[1]) > 0
    for g, w in zip(got[1], want[1]):
        assert g == w


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


@pytest.mark.skipif(not SF_DIR.endswith("sf0.01"), reason="answers are for sf0.01")
def test_known_answers(spark, sf_dir):
    """Answers worked out beforehand: they tell a changed fixture from a changed operator."""
    run = {
        name: [tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]
        for name in (
            "decision_mix", "average_precision", "best_f1", "semi_join_counts",
            "nonzero_error_rows", "velocity_mode_diff",
        )
    }
    assert {r[0]: r[1] for r in run["decision_mix"]} == {
        "APPROVE": 4030, "REVIEW": 5708, "BLOCK": 262,
    }
    assert run["average_precision"] == [(0.34307384,)]
    assert run["best_f1"][0][1] == 0.483516
    assert [r[1] for r in run["semi_join_counts"]] == [7, 35, 374, 415, 390, 441, 412]
    assert len(run["nonzero_error_rows"]) == 660
    assert run["velocity_mode_diff"] == [(425, 434)]
    ks = QUERIES["ks_by_feature"](spark, sf_dir).where("feature = 'amount'").first()
    assert ks["ks_stat"] == 0.0179
