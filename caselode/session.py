"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder that the cluster names in spark.checkpoint.dir; where none is set a temporary one is used in local mode (tests), and a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="caselode-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows go to all cores, for costly functions: only if it has fewer splits than there are cores is it shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


@contextmanager
def job_group(spark: SparkSession, name: str, description: str = ""):
    """Jobs begun inside can be cancelled together from another thread with ``cancel``."""
    spark.sparkContext.setJobGroup(name, description or name, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)
