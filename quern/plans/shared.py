"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint under ``spark.checkpoint.dir``; a folder of its own only where a session on one machine names none."""
    spark = df.sparkSession
    if not spark._jsc.sc().getCheckpointDir().isDefined():
        root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not root and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="quern-"))
    return df.checkpoint()
