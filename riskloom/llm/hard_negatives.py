"""Hard negatives for anchors among vectors, with bounds along a spanning tree of the anchors.

For each anchor its best rows of the same label are positives; for each positive, the best rows of
other labels whose score lies between two shares of the positive's are its hard negatives. A score is
the inner product of the vectors, whose components were scaled and rounded down to integers.

Anchors are a stated set of queries, held against all rows in blocks. Neighbouring anchors (by the
signs of random projections) share a block of up to `block_anchors`, in which a minimum spanning tree
is grown once. Rows come in blocks by the hash of their id. A cell is one block of each; its anchors
come first, then its rows stream by in portions, so a task holds a block of anchors and one portion.

Down the tree, the score of a row with a child is its score with the parent, give or take the length
of the edge times the row's norm. So rows carry an interval for each anchor: a child's is its parent's,
widened by that, and cut to the product of the norms. Only rows whose interval meets what is asked
(the best so far, or a window of scores) are scored; then their interval is a point for the children.
An edge of length zero hands scores down as they are. Intervals only save work: what is returned is
always scored exactly, in 64-bit integers.

Positives are looked for among rows of their label alone: cells are then parts of a label, and a label
of many rows or anchors has several (a list of such labels, bounded by rows over rows a cell, is
broadcast). The best of each cell are merged by a window for each anchor.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no
part; neither do those whose squared norm is 2**62 or more, as scores must fit a long. Of rows that
share an id the one with the least label and vector counts. A shorter vector ends with zeros; an empty
one is zero throughout. Ties go to the smaller id. An anchor without positives, or a window without
rows, gives none; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.worker import one_blas_thread
from riskloom.sources.workspace import written

#: Squared norms stay below, so that every component fits 32 bits and every score 64.
MOST_SQUARED = float(2**62)
#: Up to this product of norms, sums of doubles are exact.
_EXACT = float(2**52)
#: Relative room for rounding in bounds.
_ROOM = 1e-9
_CODE_BITS = 16


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 3
    #: A negative's score is between these percentages of the positive's.
    low: int = 50
    high: int = 95
    block_anchors: int = 16_384
    block_rows: int = 1 << 20
    portion: int = 8_192


# -- rows -----------------------------------------------------------------------------------------


def _integers(vector, scale: float) -> bytes | None:
    """A vector's components scaled and rounded down; None if it takes no part."""
    if vector is None:
        return None
    values = vector.values
    if values.null_count:
        return None
    x = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
    if not np.isfinite(x).all() or x @ x >= MOST_SQUARED:
        return None
    return x.astype("<i4").tobytes()


def vector_rows(
    rows: DataFrame, key: str, label: str, vector: str, anchor: Column, scale: float
) -> DataFrame:
    """`id`, `label`, `vec` (packed), `anchor`: one row for each id that takes part."""
    asked = rows.select(
        F.col(key).alias("id"),
        F.col(label).alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).where("id is not null and label is not null and vector is not null")

    def run(batches):
        for batch in batches:
            packed = [_integers(v, scale) for v in batch.column(3)]
            made = pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(packed, pa.binary())], ["id", "label", "anchor", "vec"]
            )
            yield made.filter(made.column(3).is_valid())

    kinds = ", ".join(f"{c} {t}" for c, t in asked.dtypes[:3])
    least = F.min(F.struct("label", "vec"))
    return (
        asked.mapInArrow(run, f"{kinds}, vec binary")
        .groupBy("id")
        .agg(F.max("anchor").alias("anchor"), least.alias("least"))
        .select("id", "least.label", "least.vec", "anchor")
    )


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width), np.int64)
    for i, data in enumerate(packed):
        x = np.frombuffer(data, "<i4")
        out[i, : len(x)] = x
    return out


def _width(packed: list[bytes]) -> int:
    return max((len(data) // 4 for data in packed), default=0)


# -- spanning trees -------------------------------------------------------------------------------


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of visit, each visited one's parent (its place in that order, -1 for the root) and the
    length of the edge to it, of a minimum spanning tree; parents first, the largest child last."""
    m = len(vectors)
    v = vectors.astype(np.float64)
    squared = np.einsum("ij,ij->i", v, v)
    away, near = np.full(m, np.inf), np.full(m, -1)
    inside = np.zeros(m, bool)
    current, added = 0, []
    for _ in range(m):
        inside[current] = True
        added.append(current)
        apart = squared + squared[current] - 2 * (v @ v[current])
        closer = (apart < away) & ~inside
        away[closer], near[closer] = apart[closer], current
        current = int(np.argmin(np.where(inside, np.inf, away)))
    sizes = np.ones(m, np.int64)
    children: list[list[int]] = [[] for _ in range(m)]
    for i in reversed(added[1:]):
        sizes[near[i]] += sizes[i]
        children[near[i]].append(i)
    order, stack = [], [0] if m else []
    while stack:
        i = stack.pop()
        order.append(i)
        stack.extend(sorted(children[i], key=lambda c: -sizes[c]))
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    parent = np.array([place[near[i]] if near[i] >= 0 else -1 for i in order], np.int64)
    steps = v[order] - v[near[order]]
    edge = np.sqrt(np.einsum("ij,ij->i", steps, steps)) * (1 + _ROOM)
    edge[parent < 0] = 0.0
    return np.array(order, np.int64), parent, edge


def planted(anchors: DataFrame, block: list[str]) -> DataFrame:
    """Adds `place`, `parent`, `edge` of each anchor in the tree of its block."""
    kinds = ", ".join(f"{c} {t}" for c, t in anchors.dtypes)

    def run(group: pa.Table) -> pa.Table:
        one_blas_thread()
        group = group.sort_by("id")
        packed = group["vec"].to_pylist()
        order, parent, edge = spanning_tree(_matrix(packed, _width(packed)))
        group = group.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order))))
        return group.append_column("parent", pa.array(parent)).append_column("edge", pa.array(edge))

    return anchors.groupBy(*block).applyInArrow(
        run, f"{kinds}, place bigint, parent bigint, edge double"
    )


def near_blocks(anchors: DataFrame, count: int, most: int) -> tuple[DataFrame, int]:
    """Adds `block`, and tells how many there are: about `most` anchors each, alike ones together.

    There are at most two blocks for each `most` anchors, and one row for each goes to all tasks.
    """
    if count <= most:
        return anchors.withColumn("block", F.lit(0)), 1
    bits = min(_CODE_BITS, ceil(log2(count / most)))

    def run(batches):
        for batch in batches:
            packed = batch.column("vec").to_pylist()
            width = _width(packed)
            # Row by row, so that the first components meet the same numbers whatever the width.
            planes = np.random.default_rng(7).standard_normal((width, _CODE_BITS))[:, :bits]
            above = _matrix(packed, width).astype(np.float64) @ planes > 0
            codes = above @ (1 << np.arange(bits))
            yield batch.append_column("code", pa.array(codes, pa.int64()))

    kinds = ", ".join(f"{c} {t}" for c, t in anchors.dtypes)
    coded, _ = written(anchors.mapInArrow(run, f"{kinds}, code bigint"), "mining-codes")
    sizes, first = [], 0
    for row in coded.groupBy("code").count().orderBy("code").collect():  # at most 2**bits rows
        parts = ceil(row["count"] / most)
        sizes.append((row["code"], first, parts))
        first += parts
    known = anchors.sparkSession.createDataFrame(sizes, "code bigint, first int, parts int")
    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    joined = coded.join(F.broadcast(known), "code").withColumn("block", block)
    return joined.select(*anchors.columns, "block"), first


# -- cells ----------------------------------------------------------------------------------------


class Interval:
    """What is known of the scores of a portion of rows with one anchor."""

    __slots__ = ("low", "high", "known", "score")

    def __init__(self, low, high, known, score):
        self.low, self.high, self.known, self.score = low, high, known, score


class Portion:
    """Rows of a cell, in ascending order of id or not."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, packed: list[bytes], width: int):
        self.ids, self.labels = ids, labels
        self.vectors = _matrix(packed, max(width, _width(packed)))
        self.floats = self.vectors.astype(np.float64)
        squared = np.einsum("ij,ij->i", self.floats, self.floats)
        self.norms = np.sqrt(squared) * (1 + _ROOM)
        self.largest = float(self.norms.max(initial=0.0))


class Cell:
    """The anchors of a block, in the order of their tree, and what has been found for them."""

    def __init__(self, ids, labels, packed, parents, edges, asked):
        self.ids, self.labels = ids, labels
        self.parents, self.edges, self.asked = parents, edges, asked
        self.packed, self.width = packed, _width(packed)
        self.vectors = _matrix(packed, self.width)
        floats = self.vectors.astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", floats, floats)) * (1 + _ROOM)
        self.children = np.bincount(parents[parents >= 0], minlength=len(ids))
        self.scored = 0

    def walk(self, rows: Portion) -> Iterator[tuple[int, Interval]]:
        """Each anchor with the intervals of the rows, a parent before its children."""
        if rows.vectors.shape[1] > self.width:
            self.width = rows.vectors.shape[1]
            self.vectors = _matrix(self.packed, self.width)
        open_ones: dict[int, Interval] = {}
        waiting = self.children.copy()
        n = len(rows.ids)
        for i, parent in enumerate(self.parents.tolist()):
            most = self.norms[i] * rows.norms
            if parent < 0:
                own = Interval(-most, most, np.zeros(n, bool), np.zeros(n, np.int64))
            else:
                above = open_ones[parent]
                waiting[parent] -= 1
                if not waiting[parent]:
                    del open_ones[parent]
                if not self.edges[i]:
                    own = Interval(
                        above.low.copy(), above.high.copy(), above.known.copy(), above.score.copy()
                    )
                else:
                    room = self.edges[i] * rows.norms + _ROOM * most
                    own = Interval(
                        np.maximum(above.low - room, -most),
                        np.minimum(above.high + room, most),
                        np.zeros(n, bool),
                        np.zeros(n, np.int64),
                    )
            yield i, own
            if self.children[i]:
                open_ones[i] = own

    def score(self, i: int, rows: Portion, own: Interval, chosen: np.ndarray) -> None:
        """Score the chosen rows that are not known yet."""
        new = np.flatnonzero(chosen & ~own.known)
        if not len(new):
            return
        self.scored += len(new)
        exact = self.norms[i] * rows.largest < _EXACT
        table = rows.floats if exact else rows.vectors
        table = table if len(new) == len(table) else table[new]
        found = table @ self.vectors[i].astype(table.dtype)
        own.score[new] = found.astype(np.int64)
        own.low[new] = own.high[new] = found
        own.known[new] = True


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by descending score, ascending id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        scores, ids = scores[some], ids[some]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Best:
    """The best k found so far."""

    __slots__ = ("k", "scores", "ids")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            some = scores >= self.scores[-1]
            scores, ids = scores[some], ids[some]
        if len(scores):
            self.scores, self.ids = _best(
                np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), self.k
            )


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest: so many are at least as high."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class PositiveSearch:
    """The best rows of the anchors' label, other than the anchors themselves."""

    columns = ("anchor_id", "positive_id", "positive_score")

    def __init__(self, cell: Cell, mining: Mining):
        self.cell = cell
        self.found = [Best(mining.positives) for _ in cell.ids]

    def take(self, rows: Portion) -> None:
        for i, own in self.cell.walk(rows):
            best = self.found[i]
            other = (rows.ids != self.cell.ids[i]) & (rows.labels == self.cell.labels[i])
            bar = max(best.least(), _kth(own.low[other], best.k))
            asked = other & (own.high >= bar - _slack(bar))
            self.cell.score(i, rows, own, asked)
            best.take(own.score[asked], rows.ids[asked])

    def results(self) -> list[tuple]:
        return [
            (anchor, row, score)
            for anchor, best in zip(self.cell.ids.tolist(), self.found)
            for row, score in zip(best.ids.tolist(), best.scores.tolist())
        ]


class NegativeSearch:
    """The best rows of other labels in the window below each positive."""

    columns = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def __init__(self, cell: Cell, mining: Mining):
        self.cell = cell
        self.windows = [
            [
                (p["id"], p["score"], low, high, Best(mining.negatives))
                for p in positives
                for low, high in [window(p["score"], mining)]
                if low <= high
            ]
            for positives in cell.asked
        ]

    def take(self, rows: Portion) -> None:
        for i, own in self.cell.walk(rows):
            other = rows.labels != self.cell.labels[i]
            asked = np.zeros(len(other), bool)
            for _, _, low, high, best in self.windows[i]:
                bar = max(best.least(), float(low))
                sure = other & (own.low >= low) & (own.high <= high)
                bar = max(bar, _kth(own.low[sure], best.k))
                asked |= (own.high >= bar - _slack(bar)) & (own.low <= high + _slack(high))
            asked &= other
            if not asked.any():
                continue
            self.cell.score(i, rows, own, asked)
            scores, ids = own.score[asked], rows.ids[asked]
            for _, _, low, high, best in self.windows[i]:
                some = (scores >= low) & (scores <= high)
                best.take(scores[some], ids[some])

    def results(self) -> list[tuple]:
        return [
            (anchor, positive, score, row, found)
            for anchor, windows in zip(self.cell.ids.tolist(), self.windows)
            for positive, score, _, _, best in windows
            for row, found in zip(best.ids.tolist(), best.scores.tolist())
        ]


def window(score: int, mining: Mining) -> tuple[int, int]:
    """The least and largest score that a negative of this positive may have."""
    return -(-mining.low * score // 100), mining.high * score // 100


def _slack(bar: float) -> float:
    """Room for what a double can't tell apart."""
    return abs(bar) * _ROOM if np.isfinite(bar) else 0.0


def _runs(batch: pa.RecordBatch, names: list[str]) -> list[int]:
    """Where rows of another cell or kind begin, and the end."""
    changed = np.zeros(max(0, batch.num_rows - 1), bool)
    for name in names:
        column = batch.column(name)
        changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]


def _search(cells: DataFrame, by: list[str], parts: int, kind: type, mining: Mining) -> DataFrame:
    """Run a search in every cell: rows of kind 0 are its anchors, those of kind 1 the rows."""

    def portions(batch: pa.RecordBatch, cell: Cell) -> Iterator[Portion]:
        for at in range(0, batch.num_rows, mining.portion):
            part = batch.slice(at, mining.portion)
            yield Portion(
                part.column("id").to_numpy(),
                part.column("label").to_numpy(zero_copy_only=False),
                part.column("vec").to_pylist(),
                cell.width,
            )

    def planted_cell(batches: list[pa.RecordBatch]) -> Cell:
        table = pa.Table.from_batches(batches).sort_by("place")
        return Cell(
            table["id"].to_numpy(),
            table["label"].to_numpy(),
            table["vec"].to_pylist(),
            table["parent"].to_numpy(),
            table["edge"].to_numpy(),
            table["positives"].to_pylist(),
        )

    def run(batches):
        one_blas_thread()
        here, anchors, search = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            rows = search.results() if search else []
            for at in range(0, len(rows), 50_000):
                arrays = [pa.array(x, pa.int64()) for x in zip(*rows[at : at + 50_000])]
                yield pa.RecordBatch.from_arrays(arrays, list(kind.columns))

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = _runs(batch, [*by, "kind"])
            for begin, end in zip(ends, ends[1:]):
                part = batch.slice(begin, end - begin)
                cell = tuple(part.column(c)[0].as_py() for c in by)
                if cell != here:
                    yield from done()
                    here, anchors, search = cell, [], None
                if part.column("kind")[0].as_py() == 0:
                    anchors.append(part)
                elif anchors or search:
                    if search is None:
                        search, anchors = kind(planted_cell(anchors), mining), []
                    for portion in portions(part, search.cell):
                        search.take(portion)
        yield from done()

    dealt = cells.repartition(parts, *by).sortWithinPartitions(*by, "kind", "id")
    return dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in kind.columns))


_POSITIVES = "array<struct<id: bigint, score: bigint>>"


def _cells(anchors: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Anchors and rows in one table, with the columns of the other side empty."""
    names = list(dict.fromkeys([*by, "id", "label", "vec"]))
    first = anchors.select(*names, "place", "parent", "edge", "positives", F.lit(0).alias("kind"))
    then = rows.select(
        *names,
        F.lit(None).cast("bigint").alias("place"),
        F.lit(None).cast("bigint").alias("parent"),
        F.lit(None).cast("double").alias("edge"),
        F.lit(None).cast(_POSITIVES).alias("positives"),
        F.lit(1).alias("kind"),
    )
    return first.unionByName(then)


def _dealt(count: Column) -> Column:
    """One row for each number below the count."""
    return F.explode(F.sequence(F.lit(0), count.cast("int") - 1))


def _part(count: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), count).cast("int")


def _first(found: DataFrame, by: list[str], score: str, row: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(row))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: float = 256.0,
    mining: Mining = Mining(),
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    `anchor` tells the anchors among the rows. Ids are integers; labels can be of any type that can
    be compared.
    """
    spark = rows.sparkSession
    table, _ = written(vector_rows(rows, key, label, vector, anchor, scale), "mining-rows")
    n, m = table.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    # Cells are smaller where there are few rows, so that every core gets some.
    spread = 4 * spark.sparkContext.defaultParallelism
    mining = replace(mining, block_rows=min(mining.block_rows, max(1024, ceil(n / spread))))
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def parts(cells: int) -> int:
        return max(least_parts, min(4 * cells, 10_000))

    # Positives: labels of many rows or anchors have several cells.
    per_row, per_anchor = F.lit(mining.block_rows), F.lit(mining.block_anchors)
    large = (
        table.groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("m"))
        .where((F.col("n") > per_row) | (F.col("m") > per_anchor))
        .select(
            "label",
            F.ceil(F.col("n") / per_row).alias("row_parts"),
            F.greatest(F.lit(1), F.ceil(F.col("m") / per_anchor)).alias("anchor_parts"),
        )
    )
    known = table.join(F.broadcast(large), "label", "left").fillna(1, ["row_parts", "anchor_parts"])
    own = known.where("anchor").withColumn("sub", _part(F.col("anchor_parts"), 1))
    own = own.withColumn("positives", F.lit(None).cast(_POSITIVES))
    trees = planted(own.drop("anchor", "anchor_parts"), ["label", "sub"])
    by = ["label", "sub", "row_part"]
    cells = _cells(
        trees.withColumn("row_part", _dealt(F.col("row_parts"))),
        known.withColumn("row_part", _part(F.col("row_parts"), 2)).withColumn(
            "sub", _dealt(F.col("anchor_parts"))
        ),
        by,
    )
    found = _search(cells, by, parts(ceil(n / mining.block_rows)), PositiveSearch, mining)
    positives = _first(found, ["anchor_id"], "positive_score", "positive_id", mining.positives)
    listed = positives.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
            )
        ).alias("positives")
    )
    asked, _ = written(table.where("anchor").drop("anchor").join(listed, "id"), "mining-anchors")

    # Negatives: all rows against all blocks of anchors.
    blocked, n_blocks = near_blocks(asked, m, mining.block_anchors)
    row_parts = max(1, ceil(n / mining.block_rows))
    by = ["block", "row_part"]
    trees, _ = written(planted(blocked, ["block"]), "mining-trees")
    cells = _cells(
        trees.withColumn("row_part", _dealt(F.lit(row_parts))),
        table.withColumn("row_part", _part(F.lit(row_parts), 2)).withColumn(
            "block", _dealt(F.lit(n_blocks))
        ),
        by,
    )
    found = _search(cells, by, parts(row_parts * n_blocks), NegativeSearch, mining)
    best = _first(
        found, ["anchor_id", "positive_id"], "negative_score", "negative_id", mining.negatives
    )
    return best.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
