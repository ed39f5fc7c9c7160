"""First or newest rows of a table in a total order, for any number of rows asked for.

A plain ordered limit makes every task send that many rows to one task: with many tasks that is
far more than the answer, and that task gets them all. Here the rows are first counted per bucket of
the order, which gives a cutoff value; rows up to the cutoff get their position by running totals,
bucket by bucket, and those beyond the limit go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.running import running_totals


def first_rows(
    df: DataFrame, n: int, order: Sequence[str], bits: int = 0, newest: bool = False
) -> DataFrame:
    """`df.orderBy(*order).limit(n)`, or its mirror image with `newest`; the order is total.

    `order` are integer columns. The first one is the coarse order: 2**bits of its values form a
    bucket. The cutoff is a scalar subquery on that column itself, which a scan can push down.
    """
    lead = order[0]
    sign = "-" if newest else ""
    counted = (
        df.where(F.col(lead).isNotNull())
        .groupBy(F.expr(f"shiftright({sign}`{lead}`, {bits})").alias("__bucket"))
        .agg(
            F.count(F.lit(1)).alias("__n"),
            (F.min(lead) if newest else F.max(lead)).alias("__edge"),
        )
        .selectExpr("*", "shiftright(__bucket, 16) AS __block")
    )
    placed = running_totals(counted, ["__n"], ["__bucket"], [["__block"]])
    needed = placed.where(F.col("__n_before") < n)
    edge = needed.agg((F.min if newest else F.max)("__edge")).scalar()
    near = df.where(F.col(lead) >= edge) if newest else df.where(F.col(lead) <= edge)
    ranks = {f"__o{i}": F.expr(f"{sign}`{c}`") for i, c in enumerate(order)}
    rows = near.withColumns(ranks).withColumn("__one", F.lit(1))
    names, last = list(ranks), list(ranks)[-1]
    rows = rows.withColumn("__slice", F.shiftright(last, 16)).withColumn(
        "__block", F.shiftright(last, 32)
    )
    levels = [[*names[:-1], "__slice"], [*names[:-1], "__block"]]
    levels += [names[:i] for i in range(len(names) - 1, 0, -1)]
    numbered = running_totals(rows, ["__one"], names, levels)
    by = [F.desc(c) if newest else F.asc(c) for c in order]
    return numbered.where(F.col("__one_before") < n).select(*df.columns).orderBy(*by)
