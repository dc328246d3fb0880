"""Folders that executors share, lineage cuts and bounded broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side table that may be broadcast; a larger one is joined by a shuffle.
SMALL = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made only on a local master that has none."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sigspark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted and is small; it should be cut or cheap."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
