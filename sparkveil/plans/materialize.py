"""Tables that a plan uses more than once, computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkveil-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def materialized(frame: DataFrame) -> DataFrame:
    """The frame's rows, written to the shared folder in spark.checkpoint.dir; plans after it begin there.

    A lost executor does not lose them, and neither the scan of all rules nor its plan is repeated by what follows.
    """
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
