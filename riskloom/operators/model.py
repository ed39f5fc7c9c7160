"""Model training, scoring, importance and versioned storage, on Spark MLlib."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.evaluate import average_precision, class_ratio
from riskloom.operators.explain import add_prefix_scores, read_trees, split_counts
from riskloom.operators.features import add_dummies_drop_first, assemble, categories
from riskloom.schemas import BALANCES, MODEL_FEATURES
from riskloom.sources.workspace import ensure_checkpoint_dir, fresh_path, read_or_empty


@dataclass(frozen=True)
class BoostingParams:
    """The documented training settings."""

    rounds: int = 500
    learning_rate: float = 0.05
    max_depth: int = 6
    min_rows_per_leaf: int = 50
    row_sampling: float = 0.8
    feature_sampling: float = 0.8
    max_bins: int = 255
    seed: int = 42
    patience: int = 50
    probe_every: int = 10


VERSIONS_SCHEMA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("saved_at", T.TimestampType()),
    ]
)


def add_class_weight(df: DataFrame, positive_weight: float, label: str = "isFraud") -> DataFrame:
    return df.withColumn(
        "weight", F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))
    )


def positive_weight(df: DataFrame, label: str = "isFraud") -> float:
    """Eager: one row."""
    return float(class_ratio(df, label).first()["positive_weight"])


def _fit(rows: DataFrame, params: BoostingParams) -> GBTClassificationModel:
    ensure_checkpoint_dir(rows.sparkSession)
    return GBTClassifier(
        featuresCol="features",
        labelCol="isFraud",
        weightCol="weight",
        maxIter=params.rounds,
        stepSize=params.learning_rate,
        maxDepth=params.max_depth,
        minInstancesPerNode=params.min_rows_per_leaf,
        subsamplingRate=params.row_sampling,
        featureSubsetStrategy=str(params.feature_sampling),
        maxBins=params.max_bins,
        seed=params.seed,
        checkpointInterval=10,
    ).fit(rows)


def choose_rounds(scores_by_round: Sequence[tuple[int, float]], patience: int) -> int:
    """Round with the best score before `patience` rounds passed without a better one."""
    best_round, best = 0, float("-inf")
    for rounds, score in sorted(scores_by_round):
        if score > best:
            best_round, best = rounds, score
        elif rounds - best_round >= patience:
            break
    return best_round


def train_boosted(
    train: DataFrame,
    validation: DataFrame | None = None,
    params: BoostingParams = BoostingParams(),
) -> GBTClassificationModel:
    """Class-weighted boosted trees over engineered features.

    With `validation`, the number of rounds is the one with the best average precision there:
    the full model is scored after every `probe_every` trees in one pass, and its first trees are
    the shorter model. They are those that a fit of so many rounds with the same seed would give.
    """
    weight = positive_weight(train)
    rows = add_class_weight(assemble(train), weight).select("features", "isFraud", "weight")
    model = _fit(rows, params)
    if validation is None or params.rounds <= params.probe_every:
        return model

    spark = train.sparkSession
    path = fresh_path(spark, "early-stop")
    model.write().save(path)
    probes = list(range(params.probe_every, params.rounds + 1, params.probe_every))
    if probes[-1] != params.rounds:
        probes.append(params.rounds)
    scored = add_prefix_scores(
        assemble(validation).select("features", "isFraud"), read_trees(spark, path), probes
    )
    by_round = [
        (row["rounds"], row["pr_auc"])
        for row in average_precision(scored, ["rounds"]).collect()  # one row per probe
    ]
    best = choose_rounds(by_round, params.patience)
    return model if best >= params.rounds else first_trees(spark, path, best)


def first_trees(spark: SparkSession, path: str, rounds: int) -> GBTClassificationModel:
    """The model of the first trees of a saved one: its node table, cut, under its own metadata."""
    target = fresh_path(spark, "first-trees")
    for part in ("data", "treesMetadata"):
        saved = spark.read.parquet(f"{path}/{part}")
        saved.where(F.col(saved.columns[0]) < rounds).write.parquet(f"{target}/{part}")
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    metadata["numTrees"] = metadata["paramMap"]["maxIter"] = rounds
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(
        f"{target}/metadata"
    )
    return GBTClassificationModel.load(target)


def add_scores(
    df: DataFrame, model: GBTClassificationModel, output: str = "risk_score", keep_vector=False
) -> DataFrame:
    """Probability of fraud per row of engineered features."""
    vectors = assemble(df)
    scored = model.transform(vectors)
    probability = F.get(vector_to_array("probability"), F.lit(1))
    kept = [F.col(c) for c in df.columns] + ([F.col("features")] if keep_vector else [])
    return scored.select(*kept, probability.alias(output))


def importance(spark: SparkSession, model: GBTClassificationModel, path: str) -> DataFrame:
    """Per feature: number of splits (the usual default) and normalised gain, largest first.

    `path` is where `model` was saved; the splits are counted from its node table.
    """
    gains = model.featureImportances
    rows = [(i, name, float(gains[i])) for i, name in enumerate(MODEL_FEATURES)]
    names = spark.createDataFrame(rows, "feature_index int, feature string, gain double")
    return (
        names.join(split_counts(spark, path), "feature_index", "left")
        .select("feature", F.coalesce("splits", F.lit(0)).cast("long").alias("splits"), "gain")
        .orderBy(F.desc("splits"), F.desc("gain"), "feature")
    )


LOGISTIC_COLUMNS = ("step", "amount", *BALANCES, "isFlaggedFraud")


def logistic_features(df: DataFrame, known_types: list[str]) -> DataFrame:
    """Raw columns and type dummies (first category dropped) as one vector."""
    flags = [f"type_{t}" for t in known_types[1:]]
    return VectorAssembler(
        inputCols=[*LOGISTIC_COLUMNS, *flags], outputCol="features"
    ).transform(add_dummies_drop_first(df, "type", known_types))


def train_logistic(
    train: DataFrame, max_iter: int = 1000
) -> tuple[LogisticRegressionModel, list[str]]:
    """Baseline on raw columns, with a unit L2 penalty on the summed loss.

    MLlib averages the loss, so that penalty is 1 / rows there. Returns the model and the type
    categories it was trained with.
    """
    known = categories(train, "type")
    rows = logistic_features(train, known).select("features", "isFraud")
    model = LogisticRegression(
        featuresCol="features",
        labelCol="isFraud",
        maxIter=max_iter,
        regParam=1.0 / max(1, rows.count()),
        standardization=False,
    ).fit(rows)
    return model, known


def add_logistic_scores(
    df: DataFrame, model: LogisticRegressionModel, known_types: list[str]
) -> DataFrame:
    scored = model.transform(logistic_features(df.withColumn("__type", F.col("type")), known_types))
    return scored.select(
        *[F.col("__type").alias("type") if c == "type" else F.col(c) for c in df.columns],
        F.get(vector_to_array("probability"), F.lit(1)).alias("risk_score"),
    )


def save_model(spark: SparkSession, model: GBTClassificationModel, root: str, version: str) -> str:
    """Write the model below `root`/`version` and add the version to the table of versions."""
    path = f"{root}/{version}"
    model.write().overwrite().save(path)
    row = spark.range(1).select(
        F.lit(version).alias("version"),
        F.array(*[F.lit(f) for f in MODEL_FEATURES]).alias("features"),
        F.current_timestamp().alias("saved_at"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{root}/_saved")
    return path


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    saved = read_or_empty(spark, f"{root}/_saved", VERSIONS_SCHEMA)
    return saved.select("version").distinct().orderBy("version")


def load_model(spark: SparkSession, root: str, version: str) -> GBTClassificationModel:
    saved = read_or_empty(spark, f"{root}/_saved", VERSIONS_SCHEMA)
    found = saved.where(F.col("version") == version).agg(
        F.max_by("features", "saved_at").alias("features")
    ).first()
    if found["features"] is None:
        raise FileNotFoundError(
            f"no model {version!r} below {root}: train one first with riskloom.plans.train"
        )
    if tuple(found["features"]) != MODEL_FEATURES:
        raise ValueError(f"model {version!r} was trained on other features: {found['features']}")
    return GBTClassificationModel.load(f"{root}/{version}")

