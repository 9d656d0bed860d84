"""Rules and settings as data: what a pack overrides, and what each repository runs, joined to hits of all repositories.

All rules run over all patches once; which of their hits count, and how severe they are, is a join with the settings of
the patch's repository. So one run serves repositories of different settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rules import CONFIDENCES, SEVERITIES, Rule

SETTINGS = "repo string, only array<string>, disable array<string>, enable array<string>, severity map<string, string>, min_confidence string"
RULES = "pack_ord int, pack string, rule_id string, severity string, confidence string, category string, trigger string, enabled boolean"


def rule_rows(spark: SparkSession, packs: list[list[Rule]]) -> DataFrame:
    """A row for every rule of every pack, in the order of the packs: pack_ord and what decides about a rule."""
    rows = [(k, r.pack, r.id, r.severity, r.confidence, r.category, r.trigger, r.enabled) for k, pack in enumerate(packs) for r in pack]
    return spark.createDataFrame(rows, RULES)


def compiled(rules: DataFrame) -> DataFrame:
    """One row a rule: that of the last pack which has it, with the packs it replaces in their order."""
    rest = [c for c in rules.columns if c not in ("rule_id", "pack_ord")]
    each = rules.groupBy("rule_id").agg(F.max_by(F.struct(*rest), "pack_ord").alias("r"), F.sort_array(F.collect_list(F.struct("pack_ord", "pack"))).alias("packs"))
    replaced = F.transform(F.slice("packs", F.lit(1), F.size("packs") - 1), lambda x: x["pack"])
    return each.select("rule_id", "r.*", replaced.alias("replaces"))


def _rank(column, ranks: dict[str, int]):
    out = F.lit(None).cast("int")
    for name, n in ranks.items():
        out = F.when(column == name, n).otherwise(out)
    return out


def broken(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """repo, problem: overrides of rules that do not exist or to severities that do not, and unknown confidences."""
    said = settings.select("repo", F.explode("severity").alias("rule_id", "level"))
    unknown = said.join(rules.select("rule_id"), "rule_id", "left_anti").select("repo", F.format_string("severity override: no such rule '%s'", "rule_id").alias("problem"))
    level = said.where(~F.col("level").isin(list(SEVERITIES))).select("repo", F.format_string("severity override of '%s': invalid severity '%s'", "rule_id", "level").alias("problem"))
    asked = settings.where(~F.coalesce("min_confidence", F.lit("")).isin("", *CONFIDENCES)).select("repo", F.format_string("unknown confidence '%s'", "min_confidence").alias("problem"))
    return unknown.union(level).union(asked)


def settled(hits: DataFrame, settings: DataFrame) -> DataFrame:
    """The ``hits`` (repo, rule_id, severity, confidence and more) that count by the settings of their repository, with its severities.

    A repository without settings, or with null ones, runs every rule as it is. ``settings`` has one row a repository.
    """
    own = settings.select(F.col("repo").alias("_repo"), *[F.col(c).alias(f"_{c}") for c in ("only", "disable", "enable", "severity", "min_confidence")])
    rows = hits.join(own, F.col("repo") == F.col("_repo"), "left")
    named = lambda c: F.coalesce(F.array_contains(f"_{c}", F.col("rule_id")), F.lit(False))
    every = F.coalesce(F.size("_only"), F.lit(0)) <= 0
    ranks = {k: v[0] for k, v in CONFIDENCES.items()}
    sure = F.coalesce(_rank(F.col("confidence"), ranks) >= _rank(F.col("_min_confidence"), ranks), F.lit(True))
    rows = rows.where((every | named("only")) & ~(named("disable") & ~named("enable")) & sure)
    level = F.coalesce(F.try_element_at("_severity", F.col("rule_id")), F.col("severity"))
    return rows.withColumn("severity", level).drop("_repo", "_only", "_disable", "_enable", "_severity", "_min_confidence")
