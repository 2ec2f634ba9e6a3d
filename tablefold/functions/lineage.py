"""Cutting a plan where its rows are kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in the folder of spark.checkpoint.dir, so that they are made once and outlive executors.

    Only a session on one machine may do without that setting.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, in Parquet, which is read by column and several times as fast; kept until the application ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()
