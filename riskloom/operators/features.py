"""Feature build: balance errors, type dummies and per-account velocity, in two velocity modes.

`by_role`  counts an account as sender and as receiver separately.
`shared`   counts an account's earlier events in either role; this is what a stream keeps per
           account, and what serving uses.
Both look only at earlier events of the same step.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import (
    cents,
    error_balance_dest,
    error_balance_orig,
    money,
    type_dummies,
)
from riskloom.operators.running import (
    HOT_ROWS,
    SLICE_BITS,
    grouped_running_totals,
    hot_groups,
)
from riskloom.schemas import MODEL_FEATURES

MAX_CATEGORIES = 1000


def add_balance_errors(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"error_balance_orig": error_balance_orig(), "error_balance_dest": error_balance_dest()}
    )


def add_balance_errors_reversed(df: DataFrame) -> DataFrame:
    """The reports' opposite sign: money expected less money found."""
    return df.withColumns(
        {
            "errorBalanceOrig": F.col("newbalanceOrig") + F.col("amount") - F.col("oldbalanceOrg"),
            "errorBalanceDest": F.col("oldbalanceDest") + F.col("amount") - F.col("newbalanceDest"),
        }
    )


def add_type_dummies(df: DataFrame) -> DataFrame:
    return df.withColumns(type_dummies())


def categories(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list[str]:
    """Distinct values in alphabetical order. Eager, and an error beyond `limit`, never a cut."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1)
    values = sorted(row[0] for row in found.collect())
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values: not a category")
    return values


def add_dummies_drop_first(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """One 0/1 column per known category but the first; the source column goes away.

    With the training categories passed for every split, all splits get the same columns: a
    category missing here gives zeros, one unknown to training gives no column.
    """
    flags = {
        f"{column}_{c}": F.coalesce(F.col(column) == c, F.lit(False)).cast("int")
        for c in known[1:]
    }
    return df.withColumns(flags).drop(column)


def hot_accounts(df: DataFrame, hot_rows: int | None) -> DataFrame | None:
    """(step, account) seen in more than `hot_rows` rows, in either role: one pass for both, over steps
    that have so many rows at all."""
    if hot_rows is None:
        return None
    accounts = df.select("step", F.explode(F.array("nameOrig", "nameDest")).alias("account"))
    upper = df.groupBy("step").agg((2 * F.count(F.lit(1))).alias("__rows"))
    return hot_groups(accounts, ["step", "account"], hot_rows, upper)


def add_velocity_by_role(
    df: DataFrame, hot_rows: int | None = HOT_ROWS, slice_bits: int = SLICE_BITS
) -> DataFrame:
    base = df.withColumns({"__n": F.lit(1), "__c": cents("amount")})
    hot = hot_accounts(df, hot_rows)

    def of(role: str) -> DataFrame | None:
        return None if hot is None else hot.withColumnRenamed("account", role)

    sent = grouped_running_totals(
        base, ["step", "nameOrig"], "event_id", ["__n", "__c"], of("nameOrig"), slice_bits
    ).withColumnsRenamed({"__n_before": "orig_tx_count_1h", "__c_before": "__sent_c"})
    received = grouped_running_totals(
        sent, ["step", "nameDest"], "event_id", ["__n"], of("nameDest"), slice_bits, source=base
    )
    return received.select(
        *df.columns,
        "orig_tx_count_1h",
        money("__sent_c").alias("orig_amount_sum_1h"),
        F.col("__n_before").alias("dest_tx_count_1h"),
    )


def account_sides(df: DataFrame) -> DataFrame:
    """Slim rows (event_id, step, account, n, c, role): one per account an event touches.

    An event to oneself gives one row that counts twice, so neither side sees the other.
    role: 1 sender, 2 receiver, 3 both.
    """
    c = cents("amount")

    def side(account: str, times: int, role: int):
        return F.struct(
            F.col(account).alias("account"),
            F.lit(times).alias("n"),
            (c * times).alias("c"),
            F.lit(role).alias("role"),
        )

    both = F.array(side("nameOrig", 2, 3))
    apart = F.array(side("nameOrig", 1, 1), side("nameDest", 1, 2))
    sides = F.when(F.col("nameOrig") == F.col("nameDest"), both).otherwise(apart)
    return df.select("event_id", "step", F.inline(sides))


def pair_sides(sides: DataFrame) -> DataFrame:
    """Back to one row per event: the sender's count and sum, the receiver's count.

    The sides of an event come from different tasks, so combining before the shuffle would find
    nothing to combine: the rows are moved first.
    """
    sender, receiver = F.col("role") != 2, F.col("role") != 1
    slim = sides.select("event_id", "role", "n_before", "c_before").repartition("event_id")
    return slim.groupBy("event_id").agg(
        F.max(F.when(sender, F.col("n_before"))).alias("orig_tx_count_1h"),
        F.max(F.when(sender, F.col("c_before"))).alias("__sent_c"),
        F.max(F.when(receiver, F.col("n_before"))).alias("dest_tx_count_1h"),
    )


def add_velocity_shared(
    df: DataFrame,
    hot_rows: int | None = HOT_ROWS,
    slice_bits: int = SLICE_BITS,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Velocity over one key space for both roles.

    Only the slim sides go through the account shuffle; the wide rows are shuffled once, to meet
    their counters on the unique event_id, so a busy account never weighs on that join.
    `carried` (step, account, n, c) holds totals of rows seen before this DataFrame.
    """
    sides = account_sides(df)
    if carried is not None:
        first = carried.select(
            F.lit(-1).cast("long").alias("event_id"),
            "step",
            "account",
            F.col("n").cast("long").alias("n"),
            F.col("c").cast("long").alias("c"),
            F.lit(0).alias("role"),
        )
        sides = sides.withColumn("n", F.col("n").cast("long")).unionByName(first)
    counted = grouped_running_totals(
        sides, ["step", "account"], "event_id", ["n", "c"], hot_accounts(df, hot_rows), slice_bits
    ).where(F.col("role") > 0)
    paired = pair_sides(counted)
    return df.join(paired, "event_id").select(
        *df.columns,
        "orig_tx_count_1h",
        money("__sent_c").alias("orig_amount_sum_1h"),
        "dest_tx_count_1h",
    )


def add_velocity(df: DataFrame, mode: str = "by_role", **options) -> DataFrame:
    if mode == "by_role":
        return add_velocity_by_role(df, **options)
    if mode == "shared":
        return add_velocity_shared(df, **options)
    raise ValueError(f"unknown velocity mode {mode!r}")


def engineer_features(df: DataFrame, velocity_mode: str = "by_role", **options) -> DataFrame:
    """All input columns plus the nine derived ones.

    Accounts must not be null (the contract rejects such rows): they would all be one account.
    """
    return (
        df.transform(add_velocity, velocity_mode, **options)
        .transform(add_balance_errors)
        .transform(add_type_dummies)
    )


def feature_columns(df: DataFrame, single_precision: bool = True) -> DataFrame:
    """event_id, the ten features in model order (rounded to float32 on request), the label."""
    kind = "float" if single_precision else "double"
    return df.select(
        "event_id",
        *[F.col(f).cast(kind).cast("double").alias(f) for f in MODEL_FEATURES],
        F.col("isFraud").cast("int").alias("isFraud"),
    )


def assemble(df: DataFrame, output: str = "features", single_precision: bool = True) -> DataFrame:
    """Add the model vector, keeping the columns of `df` as they are."""
    kind = "float" if single_precision else "double"
    raw = [f"__f{i}" for i in range(len(MODEL_FEATURES))]
    typed = df.withColumns(
        {r: F.col(f).cast(kind).cast("double") for r, f in zip(raw, MODEL_FEATURES)}
    )
    return VectorAssembler(inputCols=raw, outputCol=output).transform(typed).drop(*raw)
