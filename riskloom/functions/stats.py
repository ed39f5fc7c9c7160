"""Test statistics as column expressions over small summary rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KS_TERMS = 100


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value: the alternating Kolmogorov series, clamped to [0, 1]."""
    lam = d * F.sqrt(n.cast("double") * m / (n + m))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    series = 2.0 * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def exact_ks_p():
    """Pandas UDF (d, n, m) -> exact two-sample p-value.

    All orderings of the pooled samples are equally likely under the null hypothesis. An ordering
    is a walk of n right and m up steps; the p-value is the chance that it somewhere leaves the
    band |i/n - j/m| < d. The walk is advanced one step at a time, for all positions inside the
    band at once. A p-value that is certain to round to zero is not worked out.
    """

    @F.pandas_udf("double")
    def p_value(d, n, m):
        import numpy as np
        import pandas as pd

        def one(d, n, m):
            # Two-sample tail bound e * exp(-2 lambda^2), which holds for all n and m.
            bound = np.exp(1.0 - 2.0 * d * d * n * m / (n + m))
            if bound < 1e-7:
                return float(bound)
            limit, total = round(d * n * m), n + m
            if limit == 0:
                return 1.0
            low, inside = 0, np.ones(1)
            for step in range(total):
                i = np.arange(low, low + len(inside))
                left = total - step
                grown = np.zeros(len(inside) + 1)
                grown[:-1] = inside * np.maximum(m - (step - i), 0) / left
                grown[1:] += inside * (n - i) / left
                # Positions i after this step with |i m - j n| < limit, j = step + 1 - i.
                middle = (step + 1) * n
                first = max(low, (middle - limit) // total + 1)
                last = min(low + len(grown) - 1, -((-middle - limit) // total) - 1)
                inside = grown[first - low : last - low + 1]
                low = first
                if not len(inside):
                    return 1.0
            return min(1.0, max(0.0, 1.0 - float(inside.sum())))

        return pd.Series(
            [
                float("nan") if x != x else one(float(x), int(a), int(b))
                for x, a, b in zip(d, n, m)
            ]
        )

    return p_value


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0; relative error below 1.2e-7."""
    t = 1.0 / (1.0 + 0.5 * z)
    # The published Chebyshev fit, constant term first.
    fit = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    poly = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-z * z + poly)


def chi2_one_dof_p(statistic: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.sqrt(statistic / 2.0)))
