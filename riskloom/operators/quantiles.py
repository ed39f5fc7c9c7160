"""Exact percentiles of a distributed column, with linear interpolation between ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.running import VALUE_LEVELS, running_totals, value_buckets


def exact_percentiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    groups: Sequence[str] = (),
) -> DataFrame:
    """One row per group with a column per entry of `probabilities`.

    Spark's own `percentile` merges all distinct values of a group in one task. Here equal values
    are first counted (map-side combine, so a value held by a third of the rows is one row per
    task), then ranked by running totals over buckets whose cut points come from the data.
    """
    number = F.col(value).cast("double")
    counts = (
        df.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(*groups, number.alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ranked = running_totals(
        value_buckets(counts, "__v", groups), ["__n"], ["__v"], VALUE_LEVELS, groups, overall=True
    )

    def at(rank: Column) -> Column:
        here = (F.col("__n_before") <= rank) & (rank < F.col("__n_before") + F.col("__n"))
        return F.max(F.when(here, F.col("__v")))

    parts = {}
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("__n_all") - 1)
        parts[f"__{name}_low"] = at(F.floor(position))
        parts[f"__{name}_high"] = at(F.ceil(position))
    found = ranked.groupBy(*groups).agg(
        F.max("__n_all").alias("__size"), *[c.alias(n) for n, c in parts.items()]
    )

    def interpolated(name: str, p: float) -> Column:
        position = F.lit(float(p)) * (F.col("__size") - 1)
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        return low + (high - low) * (position - F.floor(position))

    return found.select(
        *groups, *[interpolated(n, p).alias(n) for n, p in probabilities.items()]
    )


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max of a column per (small) report group."""
    number = F.col(value)
    basic = df.groupBy(*groups).agg(
        F.count(number).alias("count"),
        F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
    )
    quartiles = exact_percentiles(df, value, QUARTILES, groups)
    return basic.join(quartiles, list(groups), "left").select(
        *groups, "count", "mean", "std", "min", *QUARTILES, "max"
    )
