"""Session and argument helpers shared by the jobs."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from riskloom.schemas import TXN_SCHEMA
from riskloom.sources import transactions


def session(name: str) -> SparkSession:
    """Master, memory and partition counts come from spark-submit; only semantics are set here."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def add_input_arguments(parser: argparse.ArgumentParser) -> argparse.ArgumentParser:
    parser.add_argument("--input", required=True, help="transaction table")
    parser.add_argument(
        "--format", default="parquet", choices=["parquet", "partitioned", "csv", "events"]
    )
    return parser


def read_input(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "csv":
        return transactions.read_csv(spark, path)
    if kind == "events":
        return transactions.from_events(spark.read.parquet(path))
    if kind == "partitioned":
        return transactions.read_partitioned(spark, path)
    return spark.read.schema(TXN_SCHEMA).parquet(path)
