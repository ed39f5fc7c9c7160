"""Exploratory reports over a transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import cents, share
from riskloom.operators.features import add_balance_errors, add_balance_errors_reversed
from riskloom.operators.quantiles import describe

RISKY_TYPES = ("TRANSFER", "CASH_OUT")


def label_totals(df: DataFrame, *groups: str) -> DataFrame:
    """Rows, frauds and fraud rate, per group or overall."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("isFraud"), F.lit(0)).cast("long").alias("frauds"),
        F.avg("isFraud").alias("fraud_rate"),
    )


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Counts of a low-cardinality column, largest first; with their share on request."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    if normalize:
        everything = Window.partitionBy()
        counted = counted.withColumn("share", F.col("rows") / F.sum("rows").over(everything))
    return counted.orderBy(F.desc("rows"), column)


def step_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("step").alias("min_step"), F.max("step").alias("max_step"))


def amount_range_by_label(df: DataFrame) -> DataFrame:
    return df.groupBy("isFraud").agg(
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount")
    )


def label_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("isFraud") == 1).alias("frauds"),
        F.count_if(F.col("isFraud") == 0).alias("genuine"),
    )


def by_label(df: DataFrame, label: int) -> DataFrame:
    return df.where(F.col("isFraud") == label)


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: its nulls, and whether the table holds any null at all."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    total = sum((F.col(c) for c in df.columns), F.lit(0))
    return (
        counted.withColumn("any_null", total > 0)
        .unpivot(["any_null"], df.columns, "column_name", "nulls")
        .select("column_name", "nulls", "any_null")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Repeats after the first of each set of equal rows. Copies collapse before the shuffle."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).cast("long").alias("duplicates")
    )


def crosstab(df: DataFrame, rows: str, columns: str = "isFraud", values=(0, 1)) -> DataFrame:
    """Counts of `rows` by the given values of `columns`, zero where a pair never occurs."""
    return df.groupBy(rows).agg(
        *[F.count_if(F.col(columns) == v).alias(f"{columns}_{v}") for v in values]
    )


def fraud_rate_by_type(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("type").agg(F.avg("isFraud").alias("fraud_rate")).orderBy(F.desc("fraud_rate"))
    )


def describe_amount(df: DataFrame) -> DataFrame:
    return describe(df, "amount", ["isFraud"])


def describe_errors(df: DataFrame) -> DataFrame:
    """Both balance errors by label, in long form."""
    errors = ["error_balance_orig", "error_balance_dest"]
    long = add_balance_errors(df).unpivot(["isFraud"], errors, "error", "value")
    return describe(long, "value", ["error", "isFraud"])


def fraud_types(df: DataFrame) -> DataFrame:
    return by_label(df, 1).select("type").distinct()


def account_profile(df: DataFrame) -> DataFrame:
    """Per account: how often it sent or received in fraud / genuine TRANSFER / CASH_OUT rows.

    Every membership question below reads this one table. The counting happens before the shuffle,
    so an account in a third of all rows is one row per task.
    """
    legs = (
        df.where(F.col("type").isin(*RISKY_TYPES))
        .select(
            "type",
            "isFraud",
            F.inline(
                F.array(
                    F.struct(F.lit("sent").alias("side"), F.col("nameOrig").alias("account")),
                    F.struct(F.lit("received").alias("side"), F.col("nameDest").alias("account")),
                )
            ),
        )
        .where(F.col("account").isNotNull())
    )
    counters = [
        F.count_if(
            (F.col("side") == side) & (F.col("type") == kind) & (F.col("isFraud") == label)
        ).alias(f"{side}_{name}_{kind.lower()}")
        for side in ("sent", "received")
        for label, name in ((1, "fraud"), (0, "genuine"))
        for kind in RISKY_TYPES
    ]
    return legs.groupBy("account").agg(*counters)


# Question -> (rows that are counted, rows whose accounts they must be among).
MEMBERSHIP_QUESTIONS = {
    "fraud transfer receivers among fraud cash-out senders":
        ("received_fraud_transfer", "sent_fraud_cash_out"),
    "fraud transfer receivers among genuine cash-out senders":
        ("received_fraud_transfer", "sent_genuine_cash_out"),
    "genuine transfer receivers among fraud cash-out senders":
        ("received_genuine_transfer", "sent_fraud_cash_out"),
    "genuine transfer receivers among fraud transfer receivers":
        ("received_genuine_transfer", "received_fraud_transfer"),
    "genuine transfer senders among fraud transfer receivers":
        ("sent_genuine_transfer", "received_fraud_transfer"),
    "genuine transfer senders among fraud transfer senders":
        ("sent_genuine_transfer", "sent_fraud_transfer"),
    "genuine transfer receivers among fraud transfer senders":
        ("received_genuine_transfer", "sent_fraud_transfer"),
}


def membership_counts(df: DataFrame) -> DataFrame:
    """Rows whose account belongs to another set of rows: seven semi-joins in one shuffle."""
    names = list(MEMBERSHIP_QUESTIONS)
    answers = account_profile(df).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(member) > 0, F.col(counted))), F.lit(0))
            .cast("long")
            .alias(name)
            for name, (counted, member) in MEMBERSHIP_QUESTIONS.items()
        ]
    )
    return answers.unpivot([], names, "question", "rows")


def members(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str
) -> DataFrame:
    """The rows themselves: those of `left` whose key occurs in `right`.

    The key set is deduplicated before the join; AQE splits a busy key on the left.
    """
    keys = right.select(F.col(right_key).alias(left_key)).where(F.col(left_key).isNotNull())
    return left.join(keys.distinct(), left_key, "left_semi")


def distinct_parties(df: DataFrame) -> DataFrame:
    """Distinct senders and receivers next to the row count, per fraud type."""
    profile = account_profile(df)
    wide = profile.agg(
        *[
            expr.cast("long").alias(f"{kind}|{what}")
            for kind in RISKY_TYPES
            for what, expr in (
                ("rows", F.sum(f"sent_fraud_{kind.lower()}")),
                ("senders", F.count_if(F.col(f"sent_fraud_{kind.lower()}") > 0)),
                ("receivers", F.count_if(F.col(f"received_fraud_{kind.lower()}") > 0)),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("type"),
                F.coalesce(F.col(f"`{kind}|rows`"), F.lit(0)).alias("rows"),
                F.col(f"`{kind}|senders`").alias("senders"),
                F.col(f"`{kind}|receivers`").alias("receivers"),
            )
            for kind in RISKY_TYPES
        ]
    )
    return wide.select(F.inline(rows))


def zero_destination_share(df: DataFrame) -> DataFrame:
    """Part of the TRANSFER / CASH_OUT rows that moved money yet left the receiver at zero."""
    hit = (
        (F.col("oldbalanceDest") == 0) & (F.col("newbalanceDest") == 0) & (F.col("amount") != 0)
    )
    risky = df.where(F.col("type").isin(*RISKY_TYPES))
    return risky.groupBy("isFraud").agg(share(hit).alias("zero_dest_share"))


def _error_cents() -> dict:
    """Balance errors in cents, so that float noise does not count as an error."""
    return {
        "orig_c": cents("newbalanceOrig") + cents("amount") - cents("oldbalanceOrg"),
        "dest_c": cents("oldbalanceDest") + cents("amount") - cents("newbalanceDest"),
    }


def nonzero_error_share(df: DataFrame) -> DataFrame:
    errors = _error_cents()
    return df.groupBy("type").agg(
        share(errors["orig_c"] != 0).alias("orig_share"),
        share(errors["dest_c"] != 0).alias("dest_share"),
    )


def nonzero_error_rows(df: DataFrame) -> DataFrame:
    return add_balance_errors_reversed(df.where(_error_cents()["dest_c"] != 0))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows in table order. The limit is the feature."""
    return df.orderBy("event_id").limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("long")
    )
