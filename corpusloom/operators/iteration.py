"""Cutting the lineage of iterations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df in the folder that driver and executors share, which a cluster names in spark.checkpoint.dir; only where that is unset (tests) a local one is made."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="corpusloom-"))
    return df.checkpoint(eager=True)
