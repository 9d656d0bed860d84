"""Tables written between the jobs of one operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from functools import partial

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a job whose result is written are of no more use.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder, for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder; executors of a cluster need a shared one")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="patchloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows that a Python worker and its task hold at once; the engine's own default is ten times as many.
_BATCH, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def lean(spark: SparkSession) -> None:
    """Smaller batches for Python workers, where the session has left their size as it is: texts are long rows."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except (Py4JError, OSError, AttributeError):  # the session has ended before
        pass


class Scratch:
    """A folder of tables of one run. Each is cut from its lineage and survives lost executors.

    Tables that no later step reads are dropped on the way; :meth:`close` deletes the rest once the caller is done
    with the result, and the end of the program does otherwise.
    """

    def __init__(self, spark: SparkSession, name: str):
        lean(spark)
        self.spark, self.at, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._end = atexit.register(partial(_at_exit, spark, self.at))

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.at}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        before = self.spark.conf.get(_FREE)
        self.spark.conf.set(_FREE, "true")
        try:
            df.write.option("compression", "zstd").parquet(at)
        finally:
            self.spark.conf.set(_FREE, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.kept_at = at
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Free kept tables that no later step reads."""
        for table in tables:
            if table is not None:
                _delete(self.spark, table.kept_at)

    def close(self) -> None:
        _delete(self.spark, self.at)
        atexit.unregister(self._end)
