"""Exact per-row Shapley contributions of a boosted model, from its saved node table.

A leaf's value is reached by a row if the row lies inside an interval for each feature on the
leaf's path. What the leaf adds to each feature's contribution depends only on which of those
(at most max_depth) intervals the row lies in. So the contributions for every combination are
tabulated once per leaf, and explaining a batch of rows is interval tests and table look-ups.
The game is the path-dependent one: a feature left out follows both branches by training rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.schemas import CONTRIBUTIONS, MODEL_FEATURES

MAX_NODES = 2_000_000
EXPLAIN_FROM = 0.1


# Leaves whose paths use the same number of features, as arrays with one row per leaf:
#   tree, value        (leaves,)        tree number; log-odds added when a row ends here
#   feature            (leaves, width)
#   low, high          (leaves, width)  a row passes if low < x <= high
#   kept               (leaves, width)  part of the training rows that pass
# A plain dict, so that executors can unpickle it without this package.
Leaves = dict[str, np.ndarray]

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a saved boosted model as rows, with the weight of their tree."""
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    metadata = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights")
    weights = metadata.select("treeID", "weights")
    return nodes.join(weights, "treeID").select(
        F.col("treeID").alias("tree"),
        "id",
        "prediction",
        F.col("rawCount").cast("double").alias("rows"),
        "leftChild",
        "rightChild",
        F.col("split.featureIndex").alias("feature_index"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("weights").alias("weight"),
    )


def split_counts(spark: SparkSession, path: str) -> DataFrame:
    inner = node_table(spark, path).where(F.col("leftChild") >= 0)
    return inner.groupBy("feature_index").agg(F.count(F.lit(1)).alias("splits"))


def read_trees(spark: SparkSession, path: str) -> list[Leaves]:
    """Leaves of a saved model, grouped by path width.

    The node table is bounded by the model (trees x 2^(depth+1)), not by the data; the bound is
    checked before it is brought to the driver.
    """
    nodes = node_table(spark, path)
    size = nodes.count()
    if size > MAX_NODES:
        raise ValueError(f"{size} nodes: too large a model to explain")
    trees: dict[int, dict[int, object]] = {}
    for row in nodes.collect():
        trees.setdefault(row["tree"], {})[row["id"]] = row

    by_width: dict[int, list] = {}
    for number, tree in sorted(trees.items()):
        pending = [(tree[0], {})]
        while pending:
            node, path_so_far = pending.pop()
            if node["leftChild"] < 0:
                # MLlib's probability is 1 / (1 + exp(-2 margin)): log-odds are twice the margin.
                value = 2.0 * node["weight"] * node["prediction"]
                by_width.setdefault(len(path_so_far), []).append((number, value, path_so_far))
                continue
            f, cut = node["feature_index"], node["threshold"]
            for child_id, goes_left in ((node["leftChild"], True), (node["rightChild"], False)):
                child = tree[child_id]
                low, high, kept = path_so_far.get(f, (-np.inf, np.inf, 1.0))
                low, high = (low, min(high, cut)) if goes_left else (max(low, cut), high)
                part = child["rows"] / node["rows"] if node["rows"] else 0.5
                pending.append((child, {**path_so_far, f: (low, high, kept * part)}))

    found = []
    for width, leaves in sorted(by_width.items()):
        shape = (len(leaves), width)

        def column(item, kind=float):
            cells = [[item(f, bounds) for f, bounds in p.items()] for _, _, p in leaves]
            return np.array(cells, dtype=kind).reshape(shape)

        found.append(
            dict(
                tree=np.array([t for t, _, _ in leaves]),
                value=np.array([v for _, v, _ in leaves]),
                feature=column(lambda f, _: f, int),
                low=column(lambda _, b: b[0]),
                high=column(lambda _, b: b[1]),
                kept=column(lambda _, b: b[2]),
            )
        )
    return found


def base_value(trees: list[Leaves]) -> float:
    """Expected log-odds over the training rows: what contributions are measured from."""
    return float(sum((g["value"] * g["kept"].prod(axis=1)).sum() for g in trees))


def contribution_tables(group: Leaves) -> np.ndarray:
    """(leaves, 2^width, width): what each leaf adds to each feature, per set of passed intervals."""
    width = group["feature"].shape[1]
    passed = (np.arange(2**width)[:, None] >> np.arange(width)) & 1
    table = np.zeros((len(group["value"]), 2**width, width))
    for j in range(width):
        # Coefficient s of this polynomial sums over coalitions of s other features.
        poly = [np.ones((len(group["value"]), 2**width))]
        for k in range(width):
            if k == j:
                continue
            out, inside = group["kept"][:, k][:, None], passed[None, :, k]
            grown = [c * out for c in poly] + [np.zeros_like(poly[0])]
            for s, c in enumerate(poly):
                grown[s + 1] = grown[s + 1] + c * inside
            poly = grown
        weight = sum(
            c * (factorial(s) * factorial(width - 1 - s) / factorial(width))
            for s, c in enumerate(poly)
        )
        table[:, :, j] = (
            group["value"][:, None] * (passed[None, :, j] - group["kept"][:, j][:, None]) * weight
        )
    return table


def shapley(rows: np.ndarray, trees: list[Leaves], tables: list[np.ndarray]) -> np.ndarray:
    """(rows, features) contributions in log-odds."""
    result = np.zeros(rows.shape)
    step_rows, step_leaves = 512, 2048
    for group, table in zip(trees, tables):
        width = group["feature"].shape[1]
        if width == 0:
            continue
        bits = 1 << np.arange(width)
        for a in range(0, len(group["value"]), step_leaves):
            part = slice(a, a + step_leaves)
            feature, low, high = group["feature"][part], group["low"][part], group["high"][part]
            to_feature = np.zeros((feature.size, rows.shape[1]))
            to_feature[np.arange(feature.size), feature.ravel()] = 1.0
            leaf = np.arange(len(feature))
            for r in range(0, len(rows), step_rows):
                x = rows[r : r + step_rows][:, feature]
                combination = ((x > low) & (x <= high)) @ bits
                added = table[part][leaf, combination]
                result[r : r + step_rows] += added.reshape(len(x), -1) @ to_feature
    return result


def prefix_margins(rows: np.ndarray, trees: list[Leaves], probes: Sequence[int]) -> np.ndarray:
    """(rows, probes) log-odds of the model cut after that many trees."""
    edges = np.asarray(probes)
    added = np.zeros((len(rows), len(edges)))
    for group in trees:
        first_probe = np.searchsorted(edges, group["tree"] + 1)
        for a in range(0, len(group["value"]), 2048):
            part = slice(a, a + 2048)
            to_probe = np.zeros((len(group["value"][part]), len(edges)))
            slot = first_probe[part]
            known = slot < len(edges)
            to_probe[np.flatnonzero(known), slot[known]] = group["value"][part][known]
            for r in range(0, len(rows), 512):
                x = rows[r : r + 512][:, group["feature"][part]]
                reached = ((x > group["low"][part]) & (x <= group["high"][part])).all(axis=2)
                added[r : r + 512] += reached @ to_probe
    return added.cumsum(axis=1)


def _features(vector: Column | str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)


def add_prefix_scores(df: DataFrame, trees: list[Leaves], probes: Sequence[int]) -> DataFrame:
    """(isFraud, rounds, risk_score): every row once per probe."""
    shared = df.sparkSession.sparkContext.broadcast((trees, list(probes)))

    @F.pandas_udf("array<double>")
    def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees, probes = shared.value
        for batch in batches:
            found = prefix_margins(np.array(batch.tolist(), dtype=float), trees, probes)
            yield pd.Series(list(found), index=batch.index)

    names = F.array(*[F.lit(p) for p in probes])
    scored = df.select("isFraud", margins(_features("features")).alias("m"))
    return scored.select("isFraud", F.inline(F.arrays_zip(names.alias("rounds"), "m"))).select(
        "isFraud",
        F.col("rounds"),
        (1.0 / (1.0 + F.exp(-F.col("m")))).alias("risk_score"),
    )


@dataclass(frozen=True)
class Explainer:
    """A model's leaves, and their look-up tables on the executors: made once, used for any rows."""

    trees: list[Leaves]
    shared: Broadcast

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Explainer:
        trees = read_trees(spark, path)
        tables = [contribution_tables(g) for g in trees]
        return cls(trees, spark.sparkContext.broadcast((trees, tables)))


def add_contributions(
    df: DataFrame,
    explainer: Explainer,
    explain_from: float = EXPLAIN_FROM,
    vector: str = "features",
    score: str = "risk_score",
) -> DataFrame:
    """Add `contributions`, array<struct<feature,value>> in model order; empty below `explain_from`.

    Rows below the gate travel as nulls and cost no work, and the scored rows are read only once.
    """
    shared = explainer.shared

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees, tables = shared.value
        for batch in batches:
            known = batch.notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if known.any():
                rows = np.array(batch[known].tolist(), dtype=float)
                out[known] = pd.Series(
                    list(shapley(rows, trees, tables)), index=batch.index[known]
                )
            yield out

    values = explain(F.when(F.col(score) >= explain_from, _features(vector)))
    names = F.array(*[F.lit(f) for f in MODEL_FEATURES])
    named = F.zip_with(
        names, F.col("__phi"), lambda n, v: F.struct(n.alias("feature"), v.alias("value"))
    )
    empty = F.array().cast(CONTRIBUTIONS)
    return (
        df.withColumn("__phi", values)
        .withColumn("contributions", F.coalesce(named, empty))
        .drop("__phi")
    )
