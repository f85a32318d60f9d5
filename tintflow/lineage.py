"""Rows that are written once to the folder that all machines share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where none is named or set, a local session gets a temporary one, and a cluster an error: its machines share no such folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    now = sc.getCheckpointDir()
    if named:
        if not now:
            sc.setCheckpointDir(named)
        return named
    if not now:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tintflow-checkpoints"))
    return sc.getCheckpointDir()


#: Spark removes a query's shuffle files as soon as it has run, where this is set when its frame is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, so that they are neither computed again nor lost with an executor. What was shuffled for them is
    removed at once: else it stays until the driver happens to collect garbage, and the disk holds all shuffles of a long job together."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
