"""Graphs given as tables of links: degrees, connected components, chains in time.

A node may be in a third of all links. Joins against one row for each node send such hubs through a
broadcast list of their own (at most twice the links / `hub_rows` nodes, which is checked), so that
no task gets a hub's links; everything else is one shuffle by node. Each step of an iteration is
written to the shared folder, where the next one starts; the folder of the step before goes.

Defined results: links with a null end, and links of a node to itself, join nothing and are left
out; repeated links count once; a table without links gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import cents, money
from riskloom.operators.asof import as_of
from riskloom.operators.running import HOT_ROWS, hot_groups
from riskloom.sources.workspace import remove_path, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(links: DataFrame) -> DataFrame:
    """`node`, `degree` (different neighbours) for each node of the links `a`, `b`."""
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (
        _both_ways(edges.distinct())
        .groupBy(F.col("a").alias("node"))
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def join_by_node(rows: DataFrame, nodes: DataFrame, hub_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of `rows` and `nodes` on `a`; `nodes` has one row a node, with its `n` in `rows`.

    `nodes` should be stored, as it is read twice. The nodes with more than `hub_rows` rows, at most
    all rows / `hub_rows`, are broadcast, and their rows stay where they are.
    """
    hubs = nodes.where(F.col("n") > hub_rows)
    if hubs.isEmpty():
        return rows.join(nodes, "a")
    hubs = F.broadcast(hubs)
    others = rows.join(hubs.select("a"), "a", "left_anti")
    return others.join(nodes.where(F.col("n") <= hub_rows), "a").unionByName(rows.join(hubs, "a"))


def _large_star(edges: DataFrame, hub_rows: int) -> tuple[DataFrame, list[str]]:
    """Each node's larger neighbours go to its least neighbour, or itself if that is smaller."""
    both = _both_ways(edges)
    least, path = written(
        both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")),
        "least",
    )
    moved = join_by_node(both.where("b > a"), least, hub_rows)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")), [path]


def _small_star(edges: DataFrame, hub_rows: int) -> tuple[DataFrame, list[str]]:
    """Each node's smaller neighbours and itself go to the least of them."""
    least, path = written(
        edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least"
    )
    moved = join_by_node(edges, least, hub_rows).where("b <> m")
    own = least.select("a", F.col("m").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own), [path]


def _checksum(edges: DataFrame) -> tuple:
    pair = F.xxhash64("a", "b")
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(pair), F.sum(pair.cast("decimal(38,0)"))).first()
    )


def components(links: DataFrame, hub_rows: int = HOT_ROWS) -> DataFrame:
    """`node`, `label` (the least node reachable) for each node of the links `a`, `b`.

    Large-star and small-star in turn, as published by Kiveris et al. (2014), until the edges stay as
    they are: each node then points to its label. Rounds grow with the logarithm of the nodes.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, path = written(edges.distinct(), "links")
    before = _checksum(edges)
    while True:
        large, used = _large_star(edges, hub_rows)
        large, at = written(large.distinct(), "large-star")
        small, more = _small_star(large, hub_rows)
        edges, made = written(small.distinct(), "links")
        for old in (path, at, *used, *more):
            remove_path(spark, old)
        path, after = made, _checksum(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


# -- payments -------------------------------------------------------------------------------------

#: Payments that move money on, and out.
PASSING = ("TRANSFER", "CASH_OUT")


def fraud_rings(
    rows: DataFrame,
    min_frauds: int = 3,
    period_steps: int | None = None,
    hub_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(rings, members): accounts that fraudulent payments link, directly or over others.

    A ring is a connected component of the graph of fraudulent transfers and cash-outs with at least
    `min_frauds` of them, within a period of `period_steps` steps if that is given. `rings` has
    `period`, `ring` (the least account in it), `accounts`, `frauds`, `amount`; `members` has `period`,
    `ring`, `account`. A payment to oneself links nothing and isn't counted.
    """
    period = F.floor((F.col("step") - 1) / period_steps) if period_steps else F.lit(0)

    def node(account: str):
        return F.struct(period.cast("long").alias("period"), F.col(account).alias("account"))

    payments, _ = written(
        rows.where(F.col("type").isin(*PASSING) & (F.col("isFraud") == 1))
        .where("nameOrig <> nameDest")
        .select(node("nameOrig").alias("a"), node("nameDest").alias("b"), cents("amount").alias("c")),
        "fraud-payments",
    )
    labels, _ = written(components(payments.select("a", "b"), hub_rows), "fraud-labels")
    # Both ends of a payment are in one ring, so one of them tells which.
    senders, _ = written(
        payments.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("c").cast("long").alias("c")),
        "fraud-senders",
    )
    accounts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("accounts"))
    rings = (
        senders.join(labels.withColumnRenamed("node", "a"), "a")
        .groupBy("label")
        .agg(F.sum("n").cast("long").alias("frauds"), F.sum("c").cast("long").alias("c"))
        .where(F.col("frauds") >= min_frauds)
        .join(accounts, "label")
    )
    stored, _ = written(rings, "fraud-rings")
    named = [F.col("a.period").alias("period"), F.col("a.account").alias("ring")]
    members = join_by_node(
        labels.withColumnRenamed("label", "a"),
        stored.select(F.col("label").alias("a"), F.col("accounts").alias("n")),
        hub_rows,
    )
    report = stored.withColumnRenamed("label", "a")
    return (
        report.select(*named, "accounts", "frauds", money("c").alias("amount")),
        members.select(*named, F.col("node.account").alias("account")),
    )


def payment_degrees(rows: DataFrame) -> DataFrame:
    """`account`, `sent_to`, `received_from`: different partners of transfers and cash-outs."""
    pairs = rows.where(F.col("type").isin(*PASSING) & (F.col("nameOrig") != F.col("nameDest")))
    pairs = pairs.select("nameOrig", "nameDest").distinct()

    def side(account: str, sent: int):
        return F.struct(F.col(account).alias("account"), F.lit(sent).alias("sent"))

    ends = pairs.select(F.inline(F.array(side("nameOrig", 1), side("nameDest", 0))))
    return ends.groupBy("account").agg(
        F.sum("sent").cast("long").alias("sent_to"),
        F.sum(1 - F.col("sent")).cast("long").alias("received_from"),
    )


def cash_out_chains(
    rows: DataFrame, max_steps: int = 24, hot_rows: int | None = HOT_ROWS, slice_bits: int = 16
) -> DataFrame:
    """Each transfer with the next cash-out by the account that received it, within `max_steps`.

    `event_id`, `account`, `step`, `amount`, `isFraud` of the transfer; `out_id`, `out_step`,
    `out_amount`, `out_fraud` of the cash-out; `lag_steps`. A lookup along the order of events, ahead
    instead of back, so a transfer gives one row at most, however many cash-outs follow.
    """
    eid = F.col("event_id")
    transfers = rows.where("type = 'TRANSFER'").select(
        F.col("nameDest").alias("account"), (-eid - 1).alias("place"), "event_id", "step", "amount", "isFraud"
    )
    outs = rows.where("type = 'CASH_OUT'").select(
        F.col("nameOrig").alias("account"),
        (-eid).alias("place"),
        eid.alias("out_id"),
        F.col("step").alias("out_step"),
        F.col("amount").alias("out_amount"),
        F.col("isFraud").alias("out_fraud"),
    )
    hot = None
    if hot_rows is not None:
        hot = hot_groups(transfers.select("account").union(outs.select("account")), ["account"], hot_rows)
    found = as_of(transfers, outs, ["account"], "place", hot, slice_bits)
    lag = F.col("out_step") - F.col("step")
    return found.where(lag <= max_steps).drop("place").withColumn("lag_steps", lag)
