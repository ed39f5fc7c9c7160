"""Running totals over data of any size and any skew.

A window without partition keys, or with one hot key, would sort everything in one task.
Two forms avoid that, both exact:

* `running_totals`: the caller names coarser and coarser buckets of the sort order. Each bucket
  is scanned on its own, bucket totals are scanned one level up, and the carried total is joined
  back on the very keys the bucket scan was partitioned by, so the large side is not shuffled again.
* `grouped_running_totals`: many small groups and perhaps a few hot ones. Only groups above
  `hot_rows` are cut into slices of the sort order; all others are one plain window.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SLICE_BITS = 16
HASH_COUNTERS = 4096
NOT_SLICED = -(2**62)
CUTS = 32


def _list(names: Iterable[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def _before(total: str, keys: Sequence[str], order: Sequence[str]) -> str:
    by = f"PARTITION BY {_list(keys)} " if keys else ""
    frame = f"{by}ORDER BY {_list(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"CAST(coalesce(sum(`{total}`) OVER ({frame}), 0) AS BIGINT) AS `{total}_before`"


def _overall(total: str, keys: Sequence[str]) -> str:
    by = f"PARTITION BY {_list(keys)}" if keys else ""
    return f"CAST(sum(`{total}`) OVER ({by}) AS BIGINT) AS `{total}_all`"


def _sums(totals: Sequence[str]) -> list:
    return [F.expr(f"CAST(sum(`{t}`) AS BIGINT) AS `{t}`") for t in totals]


def _carried(df: DataFrame, keys: Sequence[str], totals: Sequence[str], overall: bool):
    return df.selectExpr(
        *[f"`{k}`" for k in keys],
        *[f"`{t}_before` AS `__carried_{t}`" for t in totals],
        *[f"`{t}_all`" for t in totals if overall],
    )


def _add_carried(
    within: DataFrame,
    carried: DataFrame,
    keys: Sequence[str],
    totals: Sequence[str],
    kept: Sequence[str],
    overall: bool,
) -> DataFrame:
    return within.join(carried, list(keys), "left").selectExpr(
        *[f"`{c}`" for c in kept],
        *[f"`{t}_before` + coalesce(`__carried_{t}`, 0) AS `{t}_before`" for t in totals],
        *[f"`{t}_all`" for t in totals if overall],
    )


def running_totals(
    df: DataFrame,
    totals: Sequence[str],
    order: Sequence[str],
    levels: Sequence[Sequence[str]] = (),
    groups: Sequence[str] = (),
    overall: bool = False,
) -> DataFrame:
    """Add `<total>_before`: the sum over all earlier rows of the group.

    `totals` are integer columns, `order` is unique within a group. `levels` runs from fine to
    coarse; each lists columns that are non-decreasing along `order` and non-null, and each level
    must determine the next one. With `overall`, `<total>_all` is the sum of the whole group: it
    comes down with the carried totals, so it needs no further shuffle or join.
    """
    keys = [*groups, *(levels[0] if levels else ())]
    within = df.selectExpr(
        "*",
        *[_before(t, keys, order) for t in totals],
        *[_overall(t, keys) for t in totals if overall and not levels],
    )
    if not levels:
        return within

    # Columns of the coarser levels are fixed by this level, so any aggregate brings them along.
    coarser = sorted({c for level in levels[1:] for c in level} - set(keys))
    bucket_totals = df.groupBy(*keys).agg(
        *_sums(totals), *[F.expr(f"max(`{c}`) AS `{c}`") for c in coarser]
    )
    above = running_totals(bucket_totals, totals, levels[0], levels[1:], groups, overall)
    carried = _carried(above, keys, totals, overall)
    return _add_carried(within, carried, keys, totals, df.columns, overall)


def _listed(groups: DataFrame, hot_rows: int) -> DataFrame:
    return F.broadcast(groups) if hot_rows >= HOT_ROWS else groups


def hot_groups(
    df: DataFrame, groups: Sequence[str], hot_rows: int, upper: DataFrame | None = None
) -> DataFrame:
    """Groups of more than `hot_rows` rows, with `__hot` = true.

    Rows are first counted per first group column and hash of the others: few counters, so next to
    nothing is shuffled. A counter is never below the size of a group in it, so only rows under a
    large counter, usually none, are counted by group. At most rows / hot_rows counters or groups
    can be large (a million keys, tens of MB, for 10**12 rows): those lists get broadcast. Below
    HOT_ROWS the lists have no such bound, and the optimizer chooses the join. `upper` has, for each
    value of the first group column, `__rows`, which are no fewer than it has: if that is cheaper to
    know, only rows under a large value, perhaps none, are read for the counters.
    """
    lead, rest = groups[0], groups[1:] or groups
    counter = f"pmod(xxhash64({_list(rest)}), {HASH_COUNTERS}) AS __counter"
    if upper is not None:
        leads = upper.where(f"__rows > {hot_rows}").select(lead)
        df = df.join(_listed(leads, hot_rows), lead)
    rows = df.selectExpr(*[f"`{g}`" for g in groups], counter)
    large = (
        rows.groupBy(lead, "__counter")
        .agg(F.expr("count(1) AS __rows"))
        .where(f"__rows > {hot_rows}")
        .select(lead, "__counter")
    )
    return (
        rows.join(_listed(large, hot_rows), [lead, "__counter"])
        .groupBy(*groups)
        .agg(F.expr("count(1) AS __rows"))
        .where(f"__rows > {hot_rows}")
        .selectExpr(*[f"`{g}`" for g in groups], "true AS __hot")
        .transform(_listed, hot_rows)
    )


def grouped_running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    totals: Sequence[str],
    hot: DataFrame | None = None,
    slice_bits: int = SLICE_BITS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add `<total>_before` per group, ordered by the integer column `order`, unique in a group.

    Groups listed in `hot` (see `hot_groups`) are cut into slices of 2**slice_bits order values, so
    no window holds more rows than that, or than the limit the list was made with. `None` is for
    groups that are bounded already. `source` holds the same groups, order and totals as `df` when
    those are cheaper to read from an earlier step.
    """
    groups = list(groups)
    if hot is None:
        return running_totals(df, totals, [order], (), groups)
    source = (df if source is None else source).select(*groups, order, *totals)
    slice_of = f"shiftright(`{order}`, {slice_bits})"
    keys = [*groups, "__slice"]

    within = (
        df.join(hot, groups, "left")
        .selectExpr(
            *[f"`{c}`" for c in df.columns],
            f"CASE WHEN __hot THEN {slice_of} ELSE {NOT_SLICED} END AS __slice",
        )
        .selectExpr("*", *[_before(t, keys, [order]) for t in totals])
    )
    slices = (
        source.join(hot, groups, "inner")
        .selectExpr(*[f"`{c}`" for c in source.columns], f"{slice_of} AS __slice")
        .groupBy(*keys)
        .agg(*_sums(totals))
        .selectExpr("*", f"shiftright(__slice, {slice_bits}) AS __block")
    )
    above = running_totals(slices, totals, ["__slice"], [["__block"]], groups)
    carried = _carried(above, keys, totals, False)
    return _add_carried(within, carried, keys, totals, df.columns, False)


def value_buckets(df: DataFrame, value: str, cut_by: Sequence[str] = ()) -> DataFrame:
    """Two levels of buckets over a number: `__b1` is one of CUTS**2 buckets, `__b2` one of CUTS.

    The cut points are a quantile sketch of the rows of `df`, which should have each value once, so
    buckets hold about equally many rows however the values are spread. A bucket is the number of cut
    points below the value, which never decreases along it: totals are exact wherever the cuts lie.
    `cut_by` are columns with a few values (features, report groups) that get cut points each: they
    reach the tasks as one row each of CUTS**2 numbers.
    """
    number = F.col(value).cast("double")
    shares = [(i + 1) / (CUTS * CUTS) for i in range(CUTS * CUTS - 1)]
    cuts = df.groupBy(*cut_by).agg(
        F.percentile_approx(number, shares, 20 * CUTS * CUTS).alias("__cuts")
    )
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in cut_by]
    cuts = cuts.withColumnsRenamed({c: f"__of_{c}" for c in cut_by})
    condition = on[0] if on else F.lit(True)
    for part in on[1:]:
        condition = condition & part
    joined = df.join(F.broadcast(cuts), condition, "left")
    coarse = f"size(filter(sequence(1, {CUTS - 1}), i -> __cuts[i * {CUTS} - 1] < __number))"
    fine = f"size(filter(slice(__cuts, __b2 * {CUTS} + 1, {CUTS - 1}), c -> c < __number))"
    kept = [f"`{c}`" for c in df.columns]
    return (
        joined.selectExpr(*kept, "__cuts", f"CAST(`{value}` AS DOUBLE) AS __number")
        .selectExpr(*kept, "__cuts", "__number", f"coalesce({coarse}, 0) AS __b2")
        .selectExpr(*kept, f"__b2 * {CUTS} + coalesce({fine}, 0) AS __b1", "__b2")
    )


VALUE_LEVELS = (("__b1",), ("__b2",))
