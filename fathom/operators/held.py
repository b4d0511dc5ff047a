"""Intermediate results that later steps read more than once, written where all executors see them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, where it may be unset, a temporary one of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="fathom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def hold(df: DataFrame) -> DataFrame:
    """df computed once and read back from reliable checkpoint files, which go when nothing refers to them any more."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
