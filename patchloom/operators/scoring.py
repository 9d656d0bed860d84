"""Risk scores: contributions, their saturating sum, blast radius, bands and the gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rules import SEVERITIES
from .findings import confidence_weight, ranked, severity_rank, sort_keys

#: Points by severity, and the thresholds of the bands.
BASE = {"critical": 40.0, "high": 24.0, "medium": 10.0, "low": 4.0, "info": 1.0}
BANDS = {"critical": 75.0, "high": 45.0, "medium": 20.0, "low": 5.0}


@dataclass(frozen=True)
class Weights:
    """What a configuration may change; values of 0 and less mean the default."""

    base: dict[str, float] = field(default_factory=dict)
    removal_multiplier: float = 0
    saturation: float = 0
    lead_scale: float = 0
    blast_radius_weight: float = 0
    bands: dict[str, float] = field(default_factory=dict)

    def get(self, name: str) -> float:
        given = getattr(self, name)
        return given if given > 0 else {"removal_multiplier": 1.3, "saturation": 70.0, "lead_scale": 38.0, "blast_radius_weight": 15.0}[name]


@dataclass(frozen=True)
class Gate:
    fail_on: str = ""
    fail_score: float = 0


def round1(x: Column) -> Column:
    """To a tenth, halves away from zero."""
    return F.round(x * 10, 0) / 10


def contribution(severity: Column, confidence: Column, trigger: Column, w: Weights = Weights()) -> Column:
    """A finding's points, by its severity, confidence and the trigger of its rule."""
    base = F.lit(0.0)
    for name, points in {**BASE, **{k: v for k, v in w.base.items() if k in BASE}}.items():
        base = F.when(severity == name, points).otherwise(base)
    return round1(base * confidence_weight(confidence) * F.when(trigger == "removed", w.get("removal_multiplier")).otherwise(1.0))


def scored(findings: DataFrame, w: Weights = Weights()) -> DataFrame:
    return findings.withColumn("score", contribution(F.col("severity"), F.col("confidence"), F.col("trigger"), w))


def signals(raw: Column, lead: Column, w: Weights = Weights()) -> Column:
    """The worst finding sets a floor and the rest fill what is left below the cap."""
    cap = F.lit(100.0 - w.get("blast_radius_weight"))
    floor = cap * (1 - F.exp(-lead / w.get("lead_scale")))
    return floor + (cap - floor) * (1 - F.exp(-(raw - lead) / w.get("saturation")))


def blast_radius(files: Column, changed: Column, w: Weights = Weights()) -> Column:
    return F.lit(w.get("blast_radius_weight")) * (1 - F.exp(-(files / 25.0 + changed / 800.0)))


def band(total: Column, w: Weights = Weights()) -> Column:
    out = F.lit("minimal")
    for name, least in reversed({**BANDS, **{k: v for k, v in w.bands.items() if k in BANDS}}.items()):
        out = F.when(total >= least, name).otherwise(out)
    return out


def category_scores(findings: DataFrame) -> DataFrame:
    """patch_id, category, score, count, worst, category_order of live findings, highest score first."""
    rows = ranked(findings.where("not suppressed"))
    groups = rows.groupBy("patch_id", "category").agg(
        F.sum(F.col("score").cast("decimal(18,1)")).cast("double").alias("score"), F.count("*").cast("int").alias("count"), F.max_by("severity", "severity_rank").alias("worst")
    )
    return groups.withColumn("category_order", F.row_number().over(Window.partitionBy("patch_id").orderBy(F.desc("score"), "category")))


def patch_scores(findings: DataFrame, stats: DataFrame, w: Weights = Weights(), gate: Gate = Gate()) -> DataFrame:
    """A row for each patch of ``stats`` (patch_id, files_changed, additions, deletions), with findings or without:
    raw, lead, signals, blast_radius, total, band, gate_failed, gate_reason.

    Contributions are tenths, so they are summed as decimals and the order of rows cannot change a score.
    """
    live = ranked(findings.where("not suppressed"))
    sums = live.groupBy("patch_id").agg(
        F.sum(F.col("score").cast("decimal(18,1)")).cast("double").alias("raw"), F.max("score").alias("lead"), F.max("severity_rank").alias("worst_rank"), F.count("*").alias("n_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES],
    )
    rows = stats.join(sums, "patch_id", "left").na.fill(0, ["raw", "lead", "worst_rank", "n_findings", *(f"n_{s}" for s in SEVERITIES)])
    blast = blast_radius(F.col("files_changed"), F.col("additions") + F.col("deletions"), w)
    rows = rows.withColumns({"signals": F.when(F.col("n_findings") > 0, signals(F.col("raw"), F.col("lead"), w)).otherwise(0.0), "blast_radius": blast})
    rows = rows.withColumn("_total", F.least(F.lit(100.0), F.col("signals") + F.col("blast_radius")))
    rows = rows.withColumns({"band": band(F.col("_total"), w), "total": round1(F.col("_total")), "signals": round1(F.col("signals")), "blast_radius": round1(F.col("blast_radius"))})
    return gated(rows.drop("_total"), gate)


def gated(rows: DataFrame, gate: Gate) -> DataFrame:
    """The severity gate first, then the score gate on the rounded total."""
    reason = F.lit("")
    if gate.fail_score > 0:
        limit = f"{gate.fail_score:g}"
        over = F.col("total") >= gate.fail_score
        reason = F.when(over, F.concat(F.lit("risk score "), F.regexp_replace(F.format_string("%.1f", "total"), r"\.0$", ""), F.lit(f" reached the configured threshold {limit}"))).otherwise(reason)
    if gate.fail_on:
        worst, n = F.lit(""), F.lit(0).cast("long")
        for name, rank in reversed(SEVERITIES.items()):
            worst, n = F.when(F.col("worst_rank") == rank, name).otherwise(worst), F.when(F.col("worst_rank") == rank, F.col(f"n_{name}")).otherwise(n)
        plural = F.when(n == 1, " finding").otherwise(" findings")
        bad = F.col("worst_rank") >= SEVERITIES[gate.fail_on]
        reason = F.when(bad, F.concat(n.cast("string"), F.lit(" "), worst, plural, F.lit(f" (gate: --fail-on {gate.fail_on})"))).otherwise(reason)
    return rows.withColumn("gate_reason", reason).withColumn("gate_failed", F.col("gate_reason") != "")


def top_drivers(findings: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` live findings of the highest score of each patch, with driver_order; ties as findings are sorted."""
    at = Window.partitionBy("patch_id").orderBy(F.desc("score"), *sort_keys())
    return ranked(findings.where("not suppressed")).withColumn("driver_order", F.row_number().over(at)).where(F.col("driver_order") <= n)


__all__ = ["BANDS", "BASE", "Gate", "Weights", "band", "blast_radius", "category_scores", "contribution", "gated", "patch_scores", "round1", "scored", "severity_rank", "signals", "top_drivers"]
