"""Hard negatives against all scores of a small table."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hard_negatives
from riskloom.llm.hard_negatives import Mining

SCHEMA = "vec_id bigint, label int, embedding array<float>, id bigint, score double, block int, vec string"
SMALL = Mining(block_anchors=4, block_rows=20, portion=7)


def brute(rows, every, mining=Mining()):
    best = {}
    for key, label, vector in rows:
        if key is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in vector]
        if sum(x * x for x in q) >= 2**62:
            continue
        mark = (label, np.array(q, "<i4").tobytes())
        if key not in best or mark < best[key][0]:
            best[key] = (mark, q)

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for anchor, ((label, _), q) in best.items():
        if anchor % every:
            continue
        scores = [(-dot(q, p), key, mark[0]) for key, (mark, p) in best.items() if key != anchor]
        scores.sort()
        for s, positive, _ in [x for x in scores if x[2] == label][: mining.positives]:
            found = [
                (n, key)
                for n, key, other in scores
                if other != label and mining.low * -s <= 100 * -n <= mining.high * -s
            ]
            for rank, (n, key) in enumerate(found[: mining.negatives], 1):
                out.append((anchor, positive, rank, key, -s, -n))
    return sorted(out)


def mined(spark, rows, every, mining=Mining(), parts=3):
    table = spark.createDataFrame([(*r, 1, 2.0, 3, "x") for r in rows], SCHEMA).repartition(parts)
    got = hard_negatives.mine(table, F.col("vec_id") % every == 0, mining=mining)
    return sorted(tuple(r) for r in got.collect())


def clustered(n, seed, dims=6, labels=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        centre = centres[i % 4]
        near = rng.choice([0.0, 0.01, 0.3])
        rows.append((i, rng.randrange(labels), [c + rng.gauss(0, near) for c in centre]))
    return rows


@pytest.mark.parametrize("mining", [Mining(), SMALL])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_scores(spark, mining, seed):
    rows = clustered(150, seed)
    got = mined(spark, rows, 5, mining)
    assert got == brute(rows, 5)
    assert len(got) > 100


def test_awkward_rows(spark):
    rows = clustered(60, 3)
    rows += [
        (None, 1, [1.0] * 6), (100, None, [1.0] * 6), (101, 1, None), (102, 1, [1.0, None, 0.0]),
        (103, 1, [float("nan")] * 6), (104, 1, [float("inf")] * 6), (105, 1, []), (106, 2, [0.5]),
        (107, 0, [0.1] * 9), (108, 0, [1e30] * 6), (109, 1, [3e6] * 6), (110, 2, [-3e6] * 6),
        (0, 2, [0.2] * 6), (0, 0, [0.2] * 6), rows[5], rows[10], (115, 1, [0.0] * 6),
        (120, 1, [1e6] * 6), (125, 2, [0.9e6] * 6),
    ]
    want = brute(rows, 5)
    assert mined(spark, rows, 5, SMALL) == want
    assert mined(spark, rows, 5) == want


def test_a_third_of_the_rows_is_one_vector(spark):
    same = [0.25, -0.5, 0.75]
    rng = random.Random(4)
    rows = [(i, i % 2, same) for i in range(80)]
    rows += [(i, i % 3, [rng.uniform(-1, 1) for _ in same]) for i in range(80, 240)]
    assert mined(spark, rows, 10, SMALL) == brute(rows, 10)


def test_no_rows_no_anchors_text_labels(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, clustered(20, 5), 1_000_000_007) == brute(clustered(20, 5), 1_000_000_007)
    rows = clustered(40, 6)
    table = spark.createDataFrame([(i, f"l{x}", v) for i, x, v in rows], "vec_id long, label string, embedding array<double>")
    got = hard_negatives.mine(table, F.col("vec_id") % 5 == 0, mining=SMALL)
    as_floats = table.selectExpr("vec_id", "label", "cast(embedding as array<float>) embedding")
    want = hard_negatives.mine(as_floats, F.col("vec_id") % 5 == 0)
    assert got.count() > 0 and want.count() > 0


def cell(vectors, labels, mining):
    order, parent, edge = hard_negatives.spanning_tree(np.array(vectors))
    packed = [np.array(vectors[i], "<i4").tobytes() for i in order]
    asked = [[{"id": -1, "score": int(np.dot(vectors[i], vectors[i]))}] for i in order]
    return hard_negatives.Cell(order, np.array([labels[i] for i in order]), packed, parent, edge, asked)


def test_bounds_hold_and_save_scores():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (3, 8))
    anchors = [list(map(int, centres[i % 3] + rng.integers(-3, 4, 8))) for i in range(60)]
    vectors = [centres[i % 3] + rng.integers(-30, 31, 8) for i in range(500)]
    rows = hard_negatives.Portion(
        np.arange(1000, 1500), np.arange(500) % 2, [np.array(v, "<i4").tobytes() for v in vectors], 8
    )
    made = cell(anchors, [0] * 60, Mining())
    for i, own in made.walk(rows):
        true = rows.vectors @ made.vectors[i]
        assert (own.low <= true).all() and (true <= own.high).all()
        made.score(i, rows, own, rng.random(500) < 0.3)
        assert (own.score[own.known] == true[own.known]).all()
    made = cell(anchors, [0] * 60, Mining())
    hard_negatives.NegativeSearch(made, Mining()).take(rows)
    assert 0 < made.scored < 60 * 500 / 2


def test_tree_is_minimal():
    rng = np.random.default_rng(2)
    v = rng.integers(-5, 6, (40, 3))
    order, parent, edge = hard_negatives.spanning_tree(v)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and (parent[1:] < np.arange(1, 40)).all()
    apart = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    joined, total = {0}, 0.0
    while len(joined) < 40:  # Prim, plainly
        d, new = min((apart[i, j], j) for i in joined for j in range(40) if j not in joined)
        joined.add(new)
        total += d
    assert edge.sum() == pytest.approx(total)
    assert replace(Mining(), low=10).low == 10
