"""Corpus pipeline: documents in, token ids of those that are fit for training out.

Each stage gets all documents that the one before it kept, as they are, and its own decision takes
effect: toxic documents go, of each group of near copies one stays, documents with benchmark passages
go, and the rest is encoded. Every stage is written to the shared folder and read again, so a later
stage never repeats an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import byte_bpe, decontaminate, jaccard_join, toxicity
from riskloom.llm.queries import byte_bpe_digests
from riskloom.sources.workspace import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learnt from the labels doesn't predict to be toxic."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in five-word shingles, the one with the least id."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy or near copy of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of each document, and of the text they decode to."""
    return byte_bpe_digests(docs, byte_bpe.FEW_ENTRIES)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("byte_bpe", token_ids),
]
#: SQL does not express the learnt model: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
