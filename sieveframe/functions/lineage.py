"""Cutting lineage in loops, through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir, or the one that was set on the context.

    Without either, executors share no folder that is known here: an error says so. Only in local mode, where there is one machine, a
    temporary folder is taken, which goes with the process. On a cluster, files go with the objects that need them where
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the plan ends here, and a lost executor costs no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
