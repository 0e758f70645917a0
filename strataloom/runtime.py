"""Session preparation shared by all operators that run Python on executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables, which the cluster names in spark.checkpoint.dir.

    Where that is unset, a local run gets one of its own; on a cluster that is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strataloom-")
        sc.setCheckpointDir(named)
    return named


def prepare(spark: SparkSession, batch_rows: int = 256) -> SparkSession:
    """Python workers on this host find the package; Arrow batches stay small, since one text may be long.

    On a cluster the package is installed or shipped with --py-files; the added path is then unused.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_HOME, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return spark
