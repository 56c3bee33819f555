"""Intermediate results on the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder does on a single machine; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return spark.sparkContext.getCheckpointDir()


def made_once(df: DataFrame) -> DataFrame:
    """df, written to the shared folder now and read from there: what several branches of a plan read is made once, and the loss of executors does not bring it back to be made. (A checkpoint would make it twice, to count and to write.) Like checkpoints, the files stay until the folder is cleared."""
    at = f"{shared_dir(df.sparkSession)}/made-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
