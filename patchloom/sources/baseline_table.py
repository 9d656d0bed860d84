"""A baseline as a maintained table: additions and removals by version, for any number of repositories.

A version is a folder of what was added and removed by one call, dealt to buckets by fingerprint; nothing is ever
rewritten. What holds at a version are the entries added since they were last removed, and of several the first. A
version counts once Spark has marked its folder as written, so a job that fails leaves the table as it was.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["repo", "fingerprint", "rule", "file", "reason", "added_at"]
SCHEMA = "repo string, fingerprint string, rule string, file string, reason string, added_at string, removed boolean, bucket int"
BUCKETS = 16


class BaselineTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that were written whole, in order."""
        at, fs = self._at(self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        numbers = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
        return [n for n in numbers if fs.exists(self._at(f"{self._folder(n)}/_SUCCESS")[0])]

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version:08d}"

    def changes(self, version: int | None = None) -> DataFrame:
        """All additions and removals up to a version, the last one by default, with the version of each."""
        found = [n for n in self.versions() if version is None or n <= version]
        if not found:
            return self.spark.createDataFrame([], SCHEMA + ", version int")
        return self.spark.read.schema(SCHEMA + ", version int").option("basePath", self.path).parquet(*map(self._folder, found))

    def entries(self, version: int | None = None) -> DataFrame:
        """The entries that hold at a version, with the version that added each."""
        rows = self.changes(version)
        gone = F.coalesce(F.max(F.when(F.col("removed"), F.col("version"))), F.lit(0))
        kept = F.sort_array(F.collect_set(F.when(~F.col("removed"), F.struct("version", "rule", "file", "reason", "added_at"))))
        # An entry has a row for each time it was added, which only a removal allows.
        each = rows.groupBy("repo", "fingerprint").agg(gone.alias("gone"), kept.alias("added"))
        first = F.get(F.filter("added", lambda x: x["version"] > F.col("gone")), F.lit(0))
        return each.withColumn("e", first).where("e is not null").select("repo", "fingerprint", "e.rule", "e.file", "e.reason", "e.added_at", "e.version")

    def _write(self, rows: DataFrame) -> int:
        version = max(self.versions(), default=0) + 1
        bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(BUCKETS)).cast("int")
        rows.withColumn("bucket", bucket).repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(version))
        return version

    def add(self, found: DataFrame) -> int:
        """Add what ``found`` (the columns of an entry) holds and the table does not; the new version.

        Of several rows of one fingerprint the first by file and rule is taken. Rows with a null fingerprint are left out.
        """
        found = found.where("fingerprint is not null").withColumn("repo", F.coalesce("repo", F.lit("")))
        one = found.groupBy("repo", "fingerprint").agg(F.min(F.struct("file", "rule", "added_at", "reason")).alias("e"))
        one = one.join(self.entries().select("repo", "fingerprint"), ["repo", "fingerprint"], "left_anti")
        return self._write(one.select("repo", "fingerprint", "e.rule", "e.file", "e.reason", "e.added_at", F.lit(False).alias("removed")))

    def add_findings(self, findings: DataFrame, repo: str, reason: str = "", today: str = "") -> int:
        """Add the fingerprints, repeats included, of folded ``findings``."""
        prints = F.explode(F.concat(F.array("fingerprint"), "related_fingerprints")).alias("fingerprint")
        said = F.lit(reason) if reason else F.col("suppression_reason")
        return self.add(findings.select(F.lit(repo).alias("repo"), prints, F.col("rule_id").alias("rule"), "file", said.alias("reason"), F.lit(today or datetime.date.today().isoformat()).alias("added_at")))

    def remove(self, gone: DataFrame) -> int:
        """Remove the entries of ``gone`` (repo, fingerprint); the new version. They can be added again later."""
        rows = self.entries().join(gone.select("repo", "fingerprint").distinct(), ["repo", "fingerprint"], "left_semi")
        return self._write(rows.select("repo", "fingerprint", "rule", "file", "reason", "added_at", F.lit(True).alias("removed")))

    def export(self, folder: str, generated: str, version: int | None = None) -> None:
        """One JSON baseline a repository under ``folder``, written row by row: no task holds a repository's entries at once.

        Files are named by Spark, in a folder for each repository.
        """
        rows = self.entries(version)
        entry = F.to_json(F.struct("fingerprint", "rule", "file", "reason", "added_at"))
        lead = rows.groupBy("repo").agg(F.min(F.struct("file", "rule", "fingerprint")).alias("first"))
        key = F.struct("file", "rule", "fingerprint")
        body = rows.join(lead, "repo").select("repo", F.lit(1).alias("part"), key.alias("key"), F.concat(F.when(key == F.col("first"), "").otherwise(","), entry).alias("value"))
        none = F.lit(None).cast(body.schema["key"].dataType)
        head = F.concat(F.lit('{"version":1,"generated":'), F.to_json(F.array(F.lit(generated))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(generated)))) - 2), F.lit(',"entries":['))
        ends = lead.select("repo", F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("value")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")))).alias("x"))
        every = body.unionByName(ends.select("repo", "x.part", none.alias("key"), "x.value"))
        dealt = every.repartition("repo").sortWithinPartitions("repo", "part", "key")
        dealt.select("repo", "value").write.mode("overwrite").partitionBy("repo").text(folder)
