"""Anomaly scores without labels: distance from the median, and isolation trees.

The median scores are exact at any size. Isolation trees (Liu et al., 2008) are grown side by side, each
in one task on a sample of at most `sample_rows` rows, as the method has it: the sample is drawn by a
hash of the row's id, so it does not depend on how the table is cut. A forest has at most
2 * trees * sample_rows nodes, whatever the table holds; that is what tasks get to score all rows on
Arrow batches.

Defined results: rows with a null or NaN value take no part in the medians and have a null score of
it; isolation trees read them as 0. A spread of zero gives a null score. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.quantiles import exact_percentiles
from riskloom.sources.workspace import written

#: Makes the median absolute deviation of a normal distribution its standard deviation.
NORMAL_SHARE = 0.6745


def median_scores(
    df: DataFrame, values: Sequence[str], groups: Sequence[str] = ("type",)
) -> DataFrame:
    """Adds `<value>_score`, the robust z-score within the group, and `anomaly_score`, the largest.

    `groups` are columns with a few values. All values go through each of the two passes together; the
    medians, a row for each group and value, are written in between.
    """
    groups, by = list(groups), [*groups, "__name"]

    def pair(value: str, shown: Column):
        return F.struct(F.lit(value).alias("__name"), shown.cast("double").alias("__value"))

    long = df.select(*groups, F.inline(F.array(*[pair(v, F.col(v)) for v in values])))
    centres, _ = written(exact_percentiles(long, "__value", {"__median": 0.5}, by), "medians")
    away = long.join(F.broadcast(centres), by).withColumn(
        "__away", F.abs(F.col("__value") - F.col("__median"))
    )
    spreads, _ = written(exact_percentiles(away, "__away", {"__spread": 0.5}, by), "spreads")
    both = centres.join(spreads, by)
    known = both.groupBy(*groups).agg(
        *[
            F.max(F.when(F.col("__name") == v, F.struct("__median", "__spread"))).alias(f"__of_{v}")
            for v in values
        ]
    )
    scored = df.join(F.broadcast(known), groups, "left")
    for v in values:
        centre, spread = F.col(f"__of_{v}.__median"), F.col(f"__of_{v}.__spread")
        score = F.nanvl(NORMAL_SHARE * (F.col(v) - centre) / spread, F.lit(None))
        scored = scored.withColumn(f"{v}_score", F.when(spread > 0, score)).drop(f"__of_{v}")
    sizes = [F.abs(F.col(f"{v}_score")) for v in values]
    return scored.withColumn("anomaly_score", F.greatest(*sizes) if len(sizes) > 1 else sizes[0])


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees, one array each: an inner node has a feature, a cut and two children; a leaf
    has feature -1 and in `cut` the length of the path that its rows would still have."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    sample_rows: int

    def path_lengths(self, values: np.ndarray) -> np.ndarray:
        """Mean length of the path of each row (a row of `values`) over the trees."""
        total = np.zeros(len(values))
        rows = np.arange(len(values))
        for root in self.roots:
            node = np.full(len(values), root)
            depth = np.zeros(len(values))
            while True:
                inner = self.feature[node] >= 0
                if not inner.any():
                    break
                at, on = rows[inner], node[inner]
                less = values[at, self.feature[on]] < self.cut[on]
                node[inner] = np.where(less, self.left[on], self.right[on])
                depth[inner] += 1
            total += depth + self.cut[node]
        return total / max(1, len(self.roots))

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Near 1 for rows that are soon alone, 0.5 for a row like any other."""
        usual = mean_path(np.array([self.sample_rows]))[0]
        if usual == 0:
            return np.full(len(values), 0.5)
        return np.exp2(-self.path_lengths(values) / usual)


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    long = 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_tree(values: np.ndarray, seed: int) -> list[tuple[int, float, int, int]]:
    """(feature, cut, left, right) of each node, the root first; children are places in the list."""
    rng = np.random.default_rng(seed)
    most = int(np.ceil(np.log2(max(2, len(values)))))
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, -1, -1)]
    waiting = [(0, np.arange(len(values)), 0)]
    while waiting:
        place, rows, depth = waiting.pop()
        low, high = values[rows].min(0), values[rows].max(0)
        wide = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(wide):
            nodes[place] = (-1, float(mean_path(np.array([len(rows)]))[0]), -1, -1)
            continue
        feature = int(rng.choice(wide))
        cut = float(rng.uniform(low[feature], high[feature]))
        if not low[feature] < cut <= high[feature]:
            cut = float(high[feature])
        less = values[rows, feature] < cut
        nodes[place] = (feature, cut, len(nodes), len(nodes) + 1)
        waiting += [(len(nodes), rows[less], depth + 1), (len(nodes) + 1, rows[~less], depth + 1)]
        nodes += [(-1, 0.0, -1, -1)] * 2
    return nodes


def _vector(features: Sequence[str]) -> Column:
    clean = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    return F.array(*clean)


def grow_forest(
    df: DataFrame,
    features: Sequence[str],
    row_id: str = "event_id",
    trees: int = 100,
    sample_rows: int = 256,
    seed: int = 7,
) -> Forest:
    """Grow the trees side by side. A row is in the sample of one tree at most."""
    n = df.count()
    draws = max(trees, n // (sample_rows + sample_rows // 2))
    tree = F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(draws)).cast("int")
    drawn = (
        df.select(tree.alias("tree"), F.xxhash64(F.lit(seed + 1), row_id).alias("__place"), _vector(features).alias("x"))
        .where(F.col("tree") < trees)
        .withColumn("__rank", F.row_number().over(Window.partitionBy("tree").orderBy("__place", "x")))
        .where(F.col("__rank") <= sample_rows)
    )

    def grown(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__rank")
        number = int(group["tree"].iloc[0])
        nodes = grow_tree(np.array(group["x"].tolist(), float), seed + number)
        made = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right"])
        return made.assign(tree=number, node=np.arange(len(made)), rows=len(group))

    table = drawn.groupBy("tree").applyInPandas(
        grown, "feature int, cut double, left int, right int, tree int, node int, rows int"
    )
    nodes = table.toPandas().sort_values(["tree", "node"])  # at most 2 * trees * sample_rows
    roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
    base = np.repeat(roots, np.diff(np.append(roots, len(nodes))))
    rows = nodes.loc[nodes["node"] == 0, "rows"]
    return Forest(
        nodes["feature"].to_numpy(),
        nodes["cut"].to_numpy(),
        nodes["left"].to_numpy() + base,
        nodes["right"].to_numpy() + base,
        roots,
        int(round(rows.mean())) if len(rows) else 0,
    )


def add_isolation_scores(
    df: DataFrame, forest: Forest, features: Sequence[str], output: str = "isolation_score"
) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(np.array(x.tolist(), float).reshape(len(x), len(features))))

    return df.withColumn(output, scored(_vector(features)))
