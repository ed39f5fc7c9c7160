"""Quality of scores against labels: class ratio, confusion, reports, precision-recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import ratio
from riskloom.operators.running import VALUE_LEVELS, running_totals, value_buckets


def class_ratio(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """One row: negatives, positives, and the weight of a positive row."""
    counted = df.agg(
        F.count_if(F.col(label) != 1).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )
    weight = F.col("negatives") / F.greatest(F.col("positives"), F.lit(1))
    return counted.withColumn("positive_weight", weight)


def add_prediction(df: DataFrame, threshold: float = 0.5, score: str = "risk_score") -> DataFrame:
    return df.withColumn("prediction", (F.col(score) >= threshold).cast("int"))


def confusion(
    df: DataFrame,
    thresholds: Sequence[float] = (0.5,),
    label: str = "isFraud",
    score: str = "risk_score",
) -> DataFrame:
    """(threshold, label, prediction, rows) over the full 2 x 2 grid; all thresholds in one pass."""
    cells = [(t, y, p) for t in thresholds for y in (0, 1) for p in (0, 1)]

    def cell(t, y, p):
        above = F.col(score) >= t
        return F.count_if((F.col(label) == y) & (above if p else ~above))

    counted = df.agg(*[cell(*c).alias(f"c{i}") for i, c in enumerate(cells)])
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.lit(y).alias("label"),
                F.lit(p).alias("prediction"),
                F.col(f"c{i}").alias("rows"),
            )
            for i, (t, y, p) in enumerate(cells)
        ]
    )
    return counted.select(F.inline(rows))


def class_report(
    df: DataFrame,
    threshold: float = 0.5,
    names: tuple[str, str] = ("Legitimate", "Fraud"),
    label: str = "isFraud",
    score: str = "risk_score",
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    above, positive = F.col(score) >= threshold, F.col(label) == 1
    counted = df.agg(
        F.count_if(positive & above).alias("tp"),
        F.count_if(~positive & above).alias("fp"),
        F.count_if(positive & ~above).alias("fn"),
        F.count_if(~positive & ~above).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def one(hit, wrong, missed):
        return {
            "precision": ratio(hit, hit + wrong),
            "recall": ratio(hit, hit + missed),
            "f1": ratio(2 * hit, 2 * hit + wrong + missed),
        }, hit + missed

    (neg, neg_n), (pos, pos_n) = one(tn, fn, fp), one(tp, fp, fn)
    everything = neg_n + pos_n
    accuracy = ratio(tp + tn, everything)
    none = F.lit(None).cast("double")

    def row(name, scores, support):
        return F.struct(
            F.lit(name).alias("class"),
            *[scores[m].alias(m) for m in ("precision", "recall", "f1")],
            support.alias("support"),
        )

    macro = {m: (neg[m] + pos[m]) / 2 for m in neg}
    weighted = {m: ratio(neg[m] * neg_n + pos[m] * pos_n, everything) for m in neg}
    return counted.select(
        F.inline(
            F.array(
                row(names[0], neg, neg_n),
                row(names[1], pos, pos_n),
                row("accuracy", {"precision": none, "recall": none, "f1": accuracy}, everything),
                row("macro avg", macro, everything),
                row("weighted avg", weighted, everything),
            )
        )
    )


def _ranked_scores(df: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """Per distinct score, from the highest down: positives and rows so far (`_at`), and overall.

    Equal scores collapse before the shuffle; the running sums go by score interval, so no task
    ever sees the whole curve.
    """
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(*groups, F.col(score).alias("threshold"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("__down", -F.col("threshold"))
    )
    ranked = running_totals(
        value_buckets(counts, "__down"),
        ["pos", "n"],
        ["__down"],
        VALUE_LEVELS,
        groups,
        overall=True,
    )
    return ranked.select(
        *groups,
        "threshold",
        "pos",
        (F.col("pos_before") + F.col("pos")).alias("pos_at"),
        (F.col("n_before") + F.col("n")).alias("n_at"),
        "pos_all",
    )


def average_precision(
    df: DataFrame,
    groups: Sequence[str] = (),
    label: str = "isFraud",
    score: str = "risk_score",
) -> DataFrame:
    """Sum of precision times recall step over the distinct scores; 0 without positives.

    Not the trapezoid area of MLlib's evaluator, which is another number.
    """
    gain = F.col("pos") * (F.col("pos_at") / F.col("n_at"))
    return (
        _ranked_scores(df, groups, label, score)
        .groupBy(*groups)
        .agg(F.sum(gain).alias("__gain"), F.max("pos_all").alias("__pos"))
        .select(
            *groups,
            F.coalesce(ratio(F.col("__gain"), F.col("__pos")), F.lit(0.0)).alias("pr_auc"),
        )
    )


def pr_curve(df: DataFrame, label: str = "isFraud", score: str = "risk_score") -> DataFrame:
    """(threshold, precision, recall), plus the closing point (null, 1, 0)."""
    points = _ranked_scores(df, (), label, score).select(
        "threshold",
        (F.col("pos_at") / F.col("n_at")).alias("precision"),
        # Without any positive label, recall is taken as 1 everywhere.
        F.when(F.col("pos_all") == 0, 1.0)
        .otherwise(F.col("pos_at") / F.col("pos_all"))
        .alias("recall"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def best_f1(df: DataFrame, label: str = "isFraud", score: str = "risk_score") -> DataFrame:
    """The threshold with the highest F1; the smallest one among equals."""
    f1 = ratio(2 * F.col("pos_at"), F.col("n_at") + F.col("pos_all"))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("down")))
    return (
        _ranked_scores(df, (), label, score)
        .agg(best.alias("best"))
        .select(
            (-F.col("best.down")).alias("best_threshold"), F.col("best.f1").alias("best_f1")
        )
    )
