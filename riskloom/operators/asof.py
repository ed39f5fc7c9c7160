"""Joins and totals along an order within each key: point-in-time lookups, sliding windows.

Both sides of a lookup, and both ends of a window, are laid along one order, so each is one shuffle by
key and one sorted pass, never a join of ranges. Keys listed in `hot` (see `hot_groups`) are cut into
slices of the order; what a slice ends with is carried to the next ones, so no task holds a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.running import NOT_SLICED, SLICE_BITS, running_totals


def _sliced(
    df: DataFrame, keys: Sequence[str], order: str, hot: DataFrame | None, slice_bits: int
) -> DataFrame:
    if hot is None:
        return df.withColumn("__slice", F.lit(NOT_SLICED).cast("long"))
    part = F.when(F.col("__hot"), F.shiftright(order, slice_bits)).otherwise(F.lit(NOT_SLICED))
    return df.join(hot, list(keys), "left").withColumn("__slice", part).drop("__hot")


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: str,
    hot: DataFrame | None = None,
    slice_bits: int = SLICE_BITS,
) -> DataFrame:
    """Each left row with the other columns of the last right row of its keys at or before it.

    `order` is an integer column of both sides. Of right rows at the same place the one with the
    greatest values counts. A row with a null key or order meets nothing; its columns stay null, as do
    those of a row with nothing before it. Columns of the right side must have names of their own.
    """
    keys = list(keys)
    found = [c for c in right.columns if c not in (*keys, order)]
    clash = set(found) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    given = right.dropna(subset=[*keys, order]).select(
        *keys, F.col(order).cast("long").alias(order), F.struct(*found).alias("__found")
    )
    asked = left.select(
        *keys, F.col(order).cast("long").alias(order), F.struct(*left.columns).alias("__row")
    )
    both = _sliced(asked.unionByName(given, allowMissingColumns=True), keys, order, hot, slice_bits)
    side = F.col("__row").isNotNull()
    in_slice = Window.partitionBy(*keys, "__slice").orderBy(order, side, "__found")
    within = both.withColumn("__last", F.last("__found", ignorenulls=True).over(in_slice))
    rows = within.where(side)
    if hot is not None:
        end = F.max(F.when(~side, F.struct(order, "__found")))
        ends = (
            both.where(F.col("__slice") != NOT_SLICED).groupBy(*keys, "__slice").agg(end.alias("__end"))
        )
        earlier = (
            Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = ends.select(
            *keys, "__slice", F.last("__end.__found", ignorenulls=True).over(earlier).alias("__before")
        )
        rows = rows.join(carried, [*keys, "__slice"], "left").withColumn(
            "__last", F.coalesce("__last", "__before")
        )
    known = F.col("__row")
    meets = F.lit(True)
    for name in (*keys, order):
        meets = meets & known[name].isNotNull()
    return rows.select(
        *[known[c].alias(c) for c in left.columns],
        *[F.when(meets, F.col("__last")[c]).alias(c) for c in found],
    )


def sliding_totals(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    width: int,
    totals: Sequence[str],
    row_id: str = "event_id",
    hot: DataFrame | None = None,
    slice_bits: int = 32,
) -> DataFrame:
    """`row_id` and `<total>_in_window` of each row: the sum over earlier rows of its keys that are at
    most `width` older. `time` and `totals` are integers; `row_id` is unique and breaks ties.

    A row's sum is the running total before it, less that before the beginning of its window. Each
    row goes in twice, once for either end.
    """
    keys, totals = list(keys), list(totals)
    ends = df.select(*keys, F.col(time).cast("long").alias("__at"), row_id, F.lit(1).alias("__end"), *totals)
    begins = df.select(
        *keys,
        (F.col(time).cast("long") - width).alias("__at"),
        row_id,
        F.lit(0).alias("__end"),
        *[F.lit(0).cast(df.schema[t].dataType).alias(t) for t in totals],
    )
    both = _sliced(ends.unionByName(begins), keys, "__at", hot, slice_bits)
    levels = [["__slice"]] if hot is not None else []
    run = running_totals(both, totals, ["__at", "__end", row_id], levels, keys)
    # The two of a row come from different tasks: nothing to combine before the shuffle.
    slim = run.select(row_id, "__end", *[f"{t}_before" for t in totals]).repartition(row_id)

    def at(end: int, total: str):
        return F.max(F.when(F.col("__end") == end, F.col(f"{total}_before")))

    return slim.groupBy(row_id).agg(
        *[(at(1, t) - at(0, t)).cast("long").alias(f"{t}_in_window") for t in totals]
    )
