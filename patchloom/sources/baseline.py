"""Baselines: accepted findings by fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "version int, generated string, entries array<struct<fingerprint: string, rule: string, file: string, reason: string, added_at: string>>"
ACCEPTED = "accepted in baseline"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "fingerprint string, rule string, file string, reason string, added_at string")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON baseline; of a repeated fingerprint the last. A path without files has none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return empty(spark)
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    if raw.where("coalesce(version, 0) not in (0, 1)").head(1):
        raise ValueError(f"{path}: unsupported baseline version")
    rows = raw.select(F.posexplode("entries").alias("ord", "e")).select("ord", "e.*")
    last = Window.partitionBy("fingerprint").orderBy(F.desc("ord"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "ord")


def reasons(rows: DataFrame) -> DataFrame:
    """fingerprint, reason for matching; entries without a reason get a standing one."""
    blank = F.coalesce(F.col("reason"), F.lit("")) == ""
    return rows.select("fingerprint", F.when(blank, ACCEPTED).otherwise(F.col("reason")).alias("reason"))


def merged(existing: DataFrame, findings: DataFrame, reason: str, today: str) -> DataFrame:
    """Existing entries and one for every fingerprint, repeats included, of live and suppressed findings."""
    prints = F.concat(F.array("fingerprint"), "related_fingerprints")
    said = F.lit(reason) if reason else F.col("suppression_reason")
    rows = findings.select(F.posexplode(prints).alias("k", "fp"), "suppressed", "file", "rule_id", "line", said.alias("reason"))
    new = rows.select(F.col("fp").alias("fingerprint"), F.col("rule_id").alias("rule"), "file", "reason", F.lit(today).alias("added_at"), F.when(F.col("suppressed"), 2).otherwise(1).alias("turn"), "line", "k")
    every = existing.select("fingerprint", "rule", "file", "reason", "added_at", F.lit(0).alias("turn"), F.lit(0).alias("line"), F.lit(0).alias("k")).unionByName(new)
    first = Window.partitionBy("fingerprint").orderBy("turn", "file", "line", "rule", "k")
    return every.withColumn("n", F.row_number().over(first)).where("n = 1").select("fingerprint", "rule", "file", "reason", "added_at").orderBy("file", "rule", "fingerprint")


def write(rows: DataFrame, path: str, generated: str) -> int:
    """One JSON file for a repository's baseline, written entry by entry as partitions arrive; the number of entries.

    The driver holds one partition at a time. For baselines of many repositories see :mod:`.baseline_table`.
    """
    import json
    import os
    import textwrap

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{\n  "version": 1,\n  "generated": {json.dumps(generated)},\n  "entries": [')
        for r in rows.toLocalIterator():
            said = json.dumps({k: v for k, v in r.asDict().items() if v is not None}, indent=2, ensure_ascii=False)
            f.write(("," if n else "") + "\n" + textwrap.indent(said, "    "))
            n += 1
        f.write("\n  ]\n}\n" if n else "]\n}\n")
    return n
