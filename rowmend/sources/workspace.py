"""Shared working folder for intermediate tables.

An intermediate that must be read twice, or whose row positions must not change, is
written as Parquet where every executor can read it. That cuts lineage in a way that
survives lost executors, which caching and local checkpoints do not.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
OWN_SETTING = "spark.rowmend.workspace"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; operators never choose one themselves."""
    folder = spark.conf.get(SETTING, None) or spark.conf.get(OWN_SETTING, None)
    if not folder:
        raise RuntimeError(f"set {SETTING} to a folder all executors share")
    return folder.rstrip("/")


def ensure_workspace(spark: SparkSession) -> None:
    """For entry points, benchmark and tests: give a one-machine session a folder if it has none.

    The folder goes when Python ends. Any other session must name a shared folder.
    """
    if spark.conf.get(SETTING, None) or spark.conf.get(OWN_SETTING, None):
        return
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="rowmend-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(OWN_SETTING, folder)


def run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rowmend/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediates; call it once their results are consumed."""
    remove(spark, run_folder(spark))


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write once and return the table read back, so its size is known to the planner."""
    path = path or new_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
