"""Reusable column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.schemas import DUMMY_TYPES


def cents(col: Column | str) -> Column:
    """Money in integer cents: sums are exact and do not depend on the order of addition."""
    return F.rint((F.col(col) if isinstance(col, str) else col) * 100).cast("long")


def money(cents_col: Column | str) -> Column:
    col = F.col(cents_col) if isinstance(cents_col, str) else cents_col
    return col.cast("double") / F.lit(100.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 on an empty denominator."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator.cast("double")
    )


def share(condition: Column) -> Column:
    """Aggregate: part of the rows that meet `condition`."""
    return ratio(F.count_if(condition), F.count(F.lit(1)))


def error_balance_orig() -> Column:
    return (F.col("oldbalanceOrg") - F.col("newbalanceOrig")) - F.col("amount")


def error_balance_dest() -> Column:
    return (F.col("newbalanceDest") - F.col("oldbalanceDest")) - F.col("amount")


def type_dummies() -> dict[str, Column]:
    """PAYMENT is the baseline: all four are zero."""
    return {
        f"type_{t}": F.coalesce(F.col("type") == t, F.lit(False)).cast("int")
        for t in DUMMY_TYPES
    }


def decision_of(score: Column | str, review: float = 0.3, block: float = 0.7) -> Column:
    """Decision band of an unrounded score."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= block, "BLOCK").when(s >= review, "REVIEW").otherwise("APPROVE")


def is_flagged(decision: Column | str = "decision") -> Column:
    d = F.col(decision) if isinstance(decision, str) else decision
    return d.isin("REVIEW", "BLOCK")


def top_contributions(contributions: Column | str, k: int, digits: int = 4) -> Column:
    """Largest `k` entries of an array<struct<feature,value>> by magnitude.

    Equal magnitudes keep the order of the array, which is the model's feature order.
    """
    arr = F.col(contributions) if isinstance(contributions, str) else contributions
    ranked = F.array_sort(
        F.transform(
            arr,
            lambda c, i: F.struct(
                (-F.abs(c["value"])).alias("rank"),
                i.alias("position"),
                c["feature"].alias("feature"),
                c["value"].alias("value"),
            ),
        )
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda c: F.struct(
            c["feature"].alias("feature"), F.round(c["value"], digits).alias("value")
        ),
    )


def contributions_map(contributions: Column | str) -> Column:
    arr = F.col(contributions) if isinstance(contributions, str) else contributions
    return F.map_from_entries(arr)
