"""Findings: baseline, de-duplication, folding of repeats, and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where a finding stands among those of its patch, as they were met.
ORDER = ["file_idx", "rule_ord", "hunk_idx", "line_idx"]
#: Lines of repeats that a folded finding lists.
OTHER_LINES = 8


def baselined(hits: DataFrame, baseline: DataFrame) -> DataFrame:
    """Hits whose fingerprint is in ``baseline`` (fingerprint, reason) are suppressed by it, whatever else did."""
    known = baseline.select("fingerprint", F.col("reason").alias("_reason")).dropDuplicates(["fingerprint"])
    rows = hits.join(known, "fingerprint", "left")
    hit = F.col("_reason").isNotNull()
    return rows.withColumns({
        "suppressed": F.col("suppressed") | hit, "suppressed_by": F.when(hit, "baseline").otherwise(F.col("suppressed_by")),
        "suppression_reason": F.when(hit, F.col("_reason")).otherwise(F.col("suppression_reason")),
    }).drop("_reason")


def first_only(hits: DataFrame) -> DataFrame:
    """The first hit of each fingerprint and line of a patch."""
    at = Window.partitionBy("patch_id", "fingerprint", "line").orderBy(*ORDER)
    return hits.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def folded(hits: DataFrame) -> DataFrame:
    """One finding per patch, rule, file and suppression: the first hit with occurrences, other_lines and
    related_fingerprints of the rest in their order. Columns that nobody reads leave the plan."""
    own = [c for c in hits.columns if c not in ("patch_id", "rule_id", "file", "suppressed")]
    place = F.struct(*ORDER)
    groups = hits.groupBy("patch_id", "rule_id", "file", "suppressed").agg(
        *[F.min_by(c, place).alias(f"_{c}") for c in own], F.count("*").cast("int").alias("occurrences"),
        F.sort_array(F.collect_list(F.struct(*ORDER, "line", "fingerprint"))).alias("all"),
    )
    rest = F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(1)))
    lines = F.transform(F.filter(rest, lambda x: x["line"] > 0), lambda x: x["line"])
    return groups.select(
        "patch_id", "rule_id", "file", "suppressed", *[F.col(f"_{c}").alias(c) for c in own], "occurrences",
        F.slice(lines, 1, OTHER_LINES).alias("other_lines"), F.transform(rest, lambda x: x["fingerprint"]).alias("related_fingerprints"),
    )


def severity_rank(severity):
    rank = F.lit(0)
    for name, n in (("critical", 5), ("high", 4), ("medium", 3), ("low", 2), ("info", 1)):
        rank = F.when(severity == name, n).otherwise(rank)
    return rank


def confidence_weight(confidence):
    return F.when(confidence == "high", 1.0).when(confidence == "low", 0.45).otherwise(0.7)


def sort_keys() -> list:
    """Worst first: severity, confidence, then file, line and rule."""
    return [F.desc("severity_rank"), F.desc("confidence_weight"), F.asc("file"), F.asc("line"), F.asc("rule_id")]


def ranked(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"severity_rank": severity_rank(F.col("severity")), "confidence_weight": confidence_weight(F.col("confidence"))})


def by_severity(findings: DataFrame) -> DataFrame:
    """patch_id, severity, n of live findings."""
    return findings.where("not suppressed").groupBy("patch_id", "severity").agg(F.count("*").alias("n"))


def by_category(findings: DataFrame) -> DataFrame:
    return findings.where("not suppressed").groupBy("patch_id", "category").agg(F.count("*").alias("n"))


def highest(findings: DataFrame) -> DataFrame:
    """patch_id, severity: the worst of the live ones."""
    return ranked(findings.where("not suppressed")).groupBy("patch_id").agg(F.max_by("severity", "severity_rank").alias("severity"))


def by_file(findings: DataFrame) -> DataFrame:
    """patch_id, file, n, worst of live findings, and file_order: the file's place, worst first."""
    groups = ranked(findings.where("not suppressed")).groupBy("patch_id", "file").agg(F.count("*").alias("n"), F.max("severity_rank").alias("rank"), F.max_by("severity", "severity_rank").alias("worst"))
    return groups.withColumn("file_order", F.row_number().over(Window.partitionBy("patch_id").orderBy(F.desc("rank"), "file"))).drop("rank")
