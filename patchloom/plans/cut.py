"""Cutting lineage between the parts of a plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session checkpoints to; it is set here where the session has not done so."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder; executors of a cluster need a shared one")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="patchloom-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the program ends."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, at)
    return at


def _delete(spark: SparkSession, at: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JError, OSError, AttributeError):  # the session has ended before
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and written in the shared folder of ``spark.checkpoint.dir``, in columns and compressed.

    Later plans start from the files and read what they need of them: they are small to plan, and they survive lost
    executors. Where the setting is missing a temporary folder takes its place under a local master only.
    """
    spark = df.sparkSession
    at = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)
