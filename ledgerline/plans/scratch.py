"""Cuts lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints to the folder in ``spark.checkpoint.dir``. Where that is unset, to one of our own on a machine that is
    driver and executor at once; a cluster's machines share no folder of ours, so there it is an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
