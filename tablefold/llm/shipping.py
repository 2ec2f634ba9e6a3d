"""Makes this package importable on executors, and finds the shared folder of a session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{root.name}_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def _shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, in which drivers and executors see each other's files; one must be set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured is None and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # a single machine's session shares its own folders
        sc.setCheckpointDir(configured or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    _shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written as Parquet beside the checkpoints and read again.

    The folder is deleted when the session's application ends.
    """
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)
