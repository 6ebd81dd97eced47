"""The shared folder for intermediate data."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may leave that unset, and gets a temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="docloom-")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: what follows sees these rows in these partitions."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(True)
