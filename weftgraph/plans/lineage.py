"""Lineage is cut by reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a local one, dropped at exit, where that is unset and the master is local.

    RuntimeError on a cluster without the setting, as a folder of one machine would lose what other machines need.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weft_shared_")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df read back from a reliable checkpoint in the shared folder.

    Spark deletes a checkpoint once nothing refers to it if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    at = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)
