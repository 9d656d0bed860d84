"""Patches that keep arriving: each micro-batch goes through the batch plan, and scores feed event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.analysis import analyse
from ..sources.config import Config
from ..sources.rules import RuleSet


def arriving(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """patch_id, text of the files that appear in a folder, a patch each, with the time they were written."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder)
    return files.select(F.col("_metadata.file_path").alias("patch_id"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("at"))


def arriving_tables(spark: SparkSession, folder: str, max_bytes: int = 1 << 30) -> DataFrame:
    """The same of Parquet files (patch_id string, text string) that appear in a folder, many patches in each.

    A micro-batch takes files of about ``max_bytes``, so there are as many batches as there is to read and not as there
    are patches: each pays for the planning of the whole analysis.
    """
    rows = spark.readStream.schema("patch_id string, text string").option("maxBytesPerTrigger", max_bytes).parquet(folder)
    return rows.select("patch_id", "text", F.col("_metadata.file_modification_time").alias("at"))


def analysed(patches: DataFrame, rules: RuleSet, out: str, checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """Write findings and scores under ``out``, a folder for each micro-batch.

    The plan has windows, which streams do not allow, so it runs inside each batch. A batch that runs again after
    a failure overwrites its own folders, so every patch counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        # Texts are read once, for the lines, which are kept; the times need none of them.
        a = analyse(batch.select("patch_id", "text"), rules, cfg)
        a.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        times = batch.groupBy("patch_id").agg(F.max("at").alias("at"))
        a.scores.join(times, "patch_id").drop("languages").write.mode("overwrite").parquet(f"{out}/scores/batch={number}")

    return patches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def risk_by_time(scores: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Scores (at, total) by tumbling windows; those later than ``late`` are left out of a stream's results."""
    rows = scores.withWatermark("at", late).groupBy(F.window("at", window).alias("window"))
    return rows.agg(F.count("*").alias("patches"), F.max("total").alias("worst"), F.avg("total").alias("mean"))
