"""Row contract: which rows are accepted, and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import decision_of
from riskloom.schemas import BALANCES, TXN_TYPES


def _fails(condition: Column) -> Column:
    return F.coalesce(~condition, F.lit(True))


def rules() -> dict[str, Column]:
    """Violation name -> expression that is true when the row breaks the rule."""
    amount = F.col("amount")
    found = {
        "step": F.col("step").isNull(),
        "type": _fails(F.col("type").isin(*TXN_TYPES)),
        # NaN sorts above every number in Spark, so it has to be ruled out by name.
        "amount": _fails((amount > 0) & ~F.isnan(amount)),
        "nameOrig": F.col("nameOrig").isNull(),
        "nameDest": F.col("nameDest").isNull(),
    }
    for name in BALANCES:
        found[name] = _fails((F.col(name) >= 0) & ~F.isnan(F.col(name)))
    return found


def _unreadable(df: DataFrame) -> bool:
    """Whether the rows come from messages, with the fields that could not be read."""
    return "unreadable" in df.columns


def violations(df: DataFrame) -> Column:
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules().items()]))
    return F.array_union(broken, "unreadable") if _unreadable(df) else broken


def is_valid(df: DataFrame) -> Column:
    ok = F.size("unreadable") == 0 if _unreadable(df) else F.lit(True)
    for bad in rules().values():
        ok = ok & ~bad
    return ok


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where(is_valid(df)).drop("unreadable")


def quarantined_rows(df: DataFrame) -> DataFrame:
    """Rejected rows with the names of the rules they break."""
    return df.where(~is_valid(df)).withColumn("violations", violations(df)).drop("unreadable")


def violation_counts(df: DataFrame) -> DataFrame:
    """One row per rule: how many rows break it. One pass, no explode."""
    named = rules()
    counted = df.agg(*[F.count_if(bad).alias(n) for n, bad in named.items()])
    return counted.unpivot([], list(named), "rule", "rows")


def decision_violations(
    df: DataFrame, score: str = "risk_score", review: float = 0.3, block: float = 0.7
) -> DataFrame:
    """Stored decisions that are not the band of their score, or whose score is not in [0, 1]."""
    expected = decision_of(score, review, block)
    in_range = F.col(score).between(0.0, 1.0)
    return df.withColumn("expected_decision", expected).where(
        _fails(in_range) | ~F.col("decision").eqNullSafe(F.col("expected_decision"))
    )


def require_matching_decisions(
    df: DataFrame, score: str = "risk_score", review: float = 0.3, block: float = 0.7
) -> DataFrame:
    """Strict form: the job fails on the first row whose decision contradicts its score."""
    expected = decision_of(score, review, block)
    check = F.assert_true(
        F.col(score).between(0.0, 1.0) & F.col("decision").eqNullSafe(expected),
        F.format_string(
            "decision %s is inconsistent with score %s", F.col("decision"), F.col(score)
        ),
    )
    return df.where(check.isNull())
