"""Drift between a reference and a current sample of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.stats import chi2_one_dof_p, exact_ks_p, kolmogorov_p
from riskloom.operators.evaluate import average_precision
from riskloom.operators.running import VALUE_LEVELS, running_totals, value_buckets
from riskloom.schemas import DUMMY_FEATURES, MODEL_FEATURES

P_LIMIT = 0.05


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def reference_snapshot(df: DataFrame) -> DataFrame:
    """What a reference keeps: features, label, and scores when there are any."""
    _require(df, [*MODEL_FEATURES, "isFraud"])
    score = ["risk_score"] if "risk_score" in df.columns else []
    return df.select(*MODEL_FEATURES, "isFraud", *score)


def two_samples(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Both samples as one DataFrame with `is_reference`.

    When both are parts of one table, put that column on the table instead: it is then read, and
    its features are built, only once.
    """
    columns = [c for c in reference.columns if c in current.columns]
    return (
        reference.select(*columns)
        .withColumn("is_reference", F.lit(True))
        .unionByName(current.select(*columns).withColumn("is_reference", F.lit(False)))
    )


def _long(samples: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, is_reference, feature, value): one row per sample row and feature, nulls left out."""
    _require(samples, [*features, "is_reference"])
    # Not `unpivot`: two copies of an Expand are never recognised as one shuffle.
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
            for f in features
        ]
    )
    return samples.select(*by, "is_reference", F.inline(pairs)).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def ks_by_feature(
    samples: DataFrame,
    features: Sequence[str] = MODEL_FEATURES,
    method: str = "asymptotic",
    by: Sequence[str] = (),
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test per feature: statistic, p-value, sample sizes, flag.

    `by` are columns with a few values, such as the number of a window: each is tested on its own.

    Equal values are counted before the shuffle, then both distribution functions are running
    totals by value interval. `method` is "asymptotic" at any size; "exact" is for callers that ask
    for it, since its work grows with the product of the sample sizes.
    """
    if method not in ("exact", "asymptotic"):
        raise ValueError(f"unknown method {method!r}")
    counts = (
        _long(samples, features, by)
        .groupBy(*by, "feature", "value")
        .agg(
            F.count_if(F.col("is_reference")).alias("ref"),
            F.count_if(~F.col("is_reference")).alias("cur"),
        )
    )
    steps = running_totals(
        value_buckets(counts, "value", [*by, "feature"]),
        ["ref", "cur"],
        ["value"],
        VALUE_LEVELS,
        [*by, "feature"],
        overall=True,
    )
    gap = F.abs(
        (F.col("ref_before") + F.col("ref")) / F.col("ref_all")
        - (F.col("cur_before") + F.col("cur")) / F.col("cur_all")
    )
    tested = steps.groupBy(*by, "feature").agg(
        F.max(F.when((F.col("ref_all") > 0) & (F.col("cur_all") > 0), gap)).alias("d"),
        F.max("ref_all").alias("reference_rows"),
        F.max("cur_all").alias("current_rows"),
    )
    return _flagged(tested, method, by)


def _flagged(tested: DataFrame, method: str, by: Sequence[str]) -> DataFrame:
    n, m = F.col("reference_rows"), F.col("current_rows")
    p = kolmogorov_p(F.col("d"), n, m)
    tested = tested.withColumn("p", exact_ks_p()(F.col("d"), n, m) if method == "exact" else p)
    return tested.select(
        *by,
        "feature",
        F.round("d", 4).alias("ks_stat"),
        F.round("p", 6).alias("p_value"),
        "reference_rows",
        "current_rows",
        F.coalesce(F.col("p") < P_LIMIT, F.lit(False)).alias("drifted"),
    )


def ks_by_window(
    reference: DataFrame,
    current: DataFrame,
    first: int,
    last: int,
    features: Sequence[str] = MODEL_FEATURES,
) -> DataFrame:
    """`ks_by_feature` of each window from `first` to `last` of `current`, which has that column,
    against the one `reference`: the same rows as with a copy of the reference for each window.

    Between two values of a window only the reference's distribution moves, so the largest gap is at
    a value of the window, or just below one. The reference rows up to and below each value are running
    totals over one order of both sides, so the work grows with reference plus windows, not with their
    product. A window's own distribution is a plain window: its rows are bounded by its width.
    """
    columns = [c for c in reference.columns if c in current.columns]
    _require(reference.select(*columns), features)

    def counted(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        values = _long(rows.withColumn("is_reference", F.lit(name == "ref")), features, by)
        return values.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias(name))

    ref, cur = counted(reference, (), "ref"), counted(current, ["window"], "cur")
    nothing = F.lit(0).cast("long")

    def points(rows: DataFrame, kind: int, upto, below) -> DataFrame:
        window, own = (F.col(c) if c in rows.columns else F.lit(None) for c in ("window", "cur"))
        return rows.select(
            "feature",
            "value",
            F.lit(kind).alias("kind"),
            window.cast("long").alias("window"),
            own.cast("long").alias("cur"),
            upto.alias("upto"),
            below.alias("below"),
        )

    both = points(cur, 1, nothing, nothing)  # after the reference's `upto`, before its `below`
    for kind, upto, below in ((0, F.col("ref"), nothing), (2, nothing, F.col("ref"))):
        both = both.unionByName(points(ref, kind, upto, below))
    placed = running_totals(
        value_buckets(both, "value", ["feature"]),
        ["upto", "below"],
        ["value", "kind", "window"],
        VALUE_LEVELS,
        ["feature"],
        overall=True,
    ).where("kind = 1")
    steps = running_totals(placed, ["cur"], ["value"], (), ["window", "feature"], overall=True)

    def gap(upto: str, own):
        return F.abs(F.col(upto) / F.col("upto_all") - own / F.col("cur_all"))

    largest = F.greatest(
        gap("upto_before", F.col("cur_before") + F.col("cur")), gap("below_before", F.col("cur_before"))
    )
    found = steps.groupBy("window", "feature").agg(
        F.max(F.when(F.col("upto_all") > 0, largest)).alias("d"),
        F.max("cur_all").alias("__current"),
    )
    # A feature that a window has no values of is reported too: windows x features, and ten totals.
    numbers = reference.sparkSession.range(first, last + 1).toDF("window")
    names = ref.groupBy("feature").agg(F.sum("ref").alias("__reference"))
    named = reference.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    pairs = numbers.crossJoin(F.broadcast(named.join(names, "feature", "left")))
    tested = (
        pairs.join(found, ["window", "feature"], "left")
        .where("__reference is not null or __current is not null")
        .withColumns(
            {
                "reference_rows": F.coalesce("__reference", nothing),
                "current_rows": F.coalesce("__current", nothing),
            }
        )
    )
    return _flagged(tested, "asymptotic", ["window"])


def chi2_by_dummy(samples: DataFrame, features: Sequence[str] = DUMMY_FEATURES) -> DataFrame:
    """2 x 2 chi-square test (no correction) per 0/1 feature; a constant feature never drifts."""
    one, ref = F.col("value") == 1, F.col("is_reference")
    cells = (
        _long(samples, features)
        .groupBy("feature")
        .agg(
            F.count_if(ref & one).cast("double").alias("a"),
            F.count_if(ref & ~one).cast("double").alias("b"),
            F.count_if(~ref & one).cast("double").alias("c"),
            F.count_if(~ref & ~one).cast("double").alias("e"),
        )
    )
    a, b, c, e = (F.col(x) for x in "abce")
    margins = (a + b) * (c + e) * (a + c) * (b + e)
    stat = F.when(margins == 0, 0.0).otherwise(
        (a + b + c + e) * (a * e - b * c) * (a * e - b * c) / margins
    )
    tested = cells.withColumn("chi2", stat).withColumn("p", chi2_one_dof_p(F.col("chi2")))
    return tested.select(
        "feature",
        F.round("chi2", 4).alias("chi2"),
        F.round("p", 6).alias("p_value"),
        (F.col("p") < P_LIMIT).alias("drifted"),
    )


def drift_by_column(samples: DataFrame, method: str = "asymptotic") -> DataFrame:
    """Preset per column: KS for numbers, chi-square for dummies, KS on the score if there is one."""
    numbers = [f for f in MODEL_FEATURES if f not in DUMMY_FEATURES]
    if "risk_score" in samples.columns:
        numbers.append("risk_score")
    ks = ks_by_feature(samples, numbers, method).select(
        "feature", F.lit("ks").alias("test"), F.col("ks_stat").alias("statistic"), "p_value",
        "drifted",
    )
    chi2 = chi2_by_dummy(samples).select(
        "feature", F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), "p_value",
        "drifted",
    )
    return ks.unionByName(chi2)


def drift_summary(
    tests: DataFrame, threshold: float = 0.3, by: Sequence[str] = ()
) -> DataFrame:
    """One row (for each value of `by`): flag, ratio over the model features, drifted features,
    sizes, time.

    Score drift is not counted in the ratio. The sizes are the largest ones tested: amounts are
    never null, so that is the number of rows. Ten rows come in, bounded by the model.
    """
    names = F.array(*[F.lit(f) for f in MODEL_FEATURES])
    row = tests.where(F.col("feature").isin(*MODEL_FEATURES)).groupBy(*by).agg(
        F.collect_set(F.when(F.col("drifted"), F.col("feature"))).alias("hits"),
        F.coalesce(F.max("current_rows"), F.lit(0)).alias("current_size"),
        F.coalesce(F.max("reference_rows"), F.lit(0)).alias("reference_size"),
    )
    drifted = F.filter(names, lambda f: F.array_contains("hits", f))
    share = F.size("drifted_features") / F.lit(float(len(MODEL_FEATURES)))
    return row.withColumn("drifted_features", drifted).select(
        *by,
        (share > threshold).alias("is_drifted"),
        share.alias("drift_ratio"),
        "drifted_features",
        "current_size",
        "reference_size",
        F.current_timestamp().alias("timestamp"),
    )


def check_drift(
    samples: DataFrame,
    threshold: float = 0.3,
    method: str = "asymptotic",
    by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(summary, tests): KS on all ten features, the share of drifted ones against `threshold`."""
    tests = ks_by_feature(samples, MODEL_FEATURES, method, by)
    return drift_summary(tests, threshold, by), tests


def window_samples(
    reference: DataFrame, current: DataFrame, first: int, last: int
) -> DataFrame:
    """Both samples for tests by `window`: the reference once for each window from `first` to `last`,
    and the rows of `current`, which has that column."""
    columns = [c for c in reference.columns if c in current.columns]
    numbers = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))
    windows = F.explode(numbers).alias("window")
    return (
        reference.select(*columns, windows)
        .withColumn("is_reference", F.lit(True))
        .unionByName(current.select(*columns, "window").withColumn("is_reference", F.lit(False)))
    )


def score_drift(samples: DataFrame, method: str = "asymptotic") -> DataFrame:
    return ks_by_feature(samples, ["risk_score"], method)


def performance_by_period(df: DataFrame, steps: int = 24) -> DataFrame:
    """Average precision per period of `steps` steps: a decline is performance drift."""
    period = F.floor((F.col("step") - 1) / steps).cast("long")
    return average_precision(df.withColumn("period", period), ["period"])


def save_drift_report(summary: DataFrame, tests: DataFrame, path: str) -> None:
    """Append the summary row and the per-feature rows to two tables below `path`."""
    summary.write.mode("append").parquet(f"{path}/drift_summary")
    tests.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(
        f"{path}/drift_features"
    )
