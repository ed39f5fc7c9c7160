"""Shared folder for checkpoints, streaming state and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting falls back to a temporary folder: on a cluster, also
    one of local processes, a machine-local folder would be invisible to the other executors.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors can reach")
    folder = getattr(spark, "_riskloom_folder", None)
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark._riskloom_folder = folder
    return folder


def fresh_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder, never one that was used before."""
    return f"{shared_folder(spark)}/riskloom/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """The table from the shared folder, and its path: later plans start there, and lost executors
    do no harm."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, by whatever file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def create_if_absent(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if there was one. Of several callers one gets true.

    Local files are created exclusively by the operating system, others by their file system, which has
    to refuse to create a file twice (HDFS does).
    """
    if path.startswith(("file:", "/")):
        name = "/" + path.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(name), exist_ok=True)
        try:
            os.close(os.open(name, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        files.create(target, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(target):
            return False
        raise
    return True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let `DataFrame.checkpoint` and MLlib cut lineage in the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(spark)}/riskloom/lineage")


def read_or_empty(
    spark: SparkSession, path: str, schema: StructType, reader: DataFrameReader | None = None
) -> DataFrame:
    """A parquet table that may not have been written yet."""
    try:
        return (reader or spark.read).schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
