"""The analysis: patches and rules to findings, scores and reviewers, a plan over all patches at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import text as T
from ..functions.languages import language
from ..operators import detectors, diff, findings, matching, routing, scoring
from ..sources import baseline as B
from ..sources.config import Config
from ..sources.rules import Rule, RuleSet, to_frame
from .cut import cut


@dataclass
class Analysis:
    """``findings`` live and suppressed, ``stats``, ``category_scores`` and ``scores`` per patch, ``rejected`` patches."""

    findings: DataFrame
    stats: DataFrame
    category_scores: DataFrame
    scores: DataFrame
    rejected: DataFrame

    def views(self) -> None:
        """Register the relations as findings, stats, category_scores and scores for SQL."""
        for name in ("findings", "stats", "category_scores", "scores"):
            getattr(self, name).createOrReplaceTempView(name)


def stats_of(files: DataFrame, n_rules: int, exclude_paths=()) -> DataFrame:
    """A row per patch; excluded files count in all but what is matched."""
    rows = files.withColumn("lang", language(F.col("path"))).withColumn("out", globs.any_of(F.col("path"), list(exclude_paths)))
    base = rows.groupBy("patch_id").agg(
        F.count("*").cast("int").alias("files_changed"), F.sum("additions").cast("int").alias("additions"), F.sum("deletions").cast("int").alias("deletions"),
        F.count_if("binary").cast("int").alias("binary_files"), F.count_if("out").cast("int").alias("files_skipped"),
    )
    langs = rows.groupBy("patch_id", "lang").agg(F.count("*").alias("n")).groupBy("patch_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n")))).alias("languages"))
    return base.join(langs, "patch_id").withColumn("rules_evaluated", F.lit(n_rules))


def hits_of(files: DataFrame, lines: DataFrame, rules: list[Rule], cfg: Config, detecting: list[detectors.Detector] = ()) -> DataFrame:
    """Every match as it is met: place, rule_ord, line, texts and inline suppression, before any folding.

    A detector's rule_ord follows those of ``rules``.
    """
    keep = ~globs.any_of(F.col("path"), list(cfg.exclude_paths)) if cfg.exclude_paths else F.lit(True)
    files = files.where(keep)
    lines = lines.where(keep & ~F.col("binary"))
    catalogue = [*rules, *(d.rule for d in detecting)]
    ids = F.array(*[F.lit(r.id) for r in catalogue])
    rule_id = F.element_at(ids, F.col("rule_ord") + 1)
    common = ["patch_id", "file_idx", "hunk_idx", "line_idx", "path", "text", "section", "old_line", "rule_ord", "match", "line", "title_of", "suppressed", "suppressed_by", "suppression_reason", "snippet_of"]
    by_rule = matching.line_hits(lines, rules, cfg.slow_pattern_line).withColumns({"line": F.col("anchor_line"), "title_of": F.lit(None).cast("string"), "snippet_of": F.col("text")})
    parts = [matching.noted(by_rule, rule_id, cfg.marker).select(common)]
    was = F.when((F.col("old_path") != "") & (F.col("old_path") != F.col("path")), F.concat(F.lit(" (was "), "old_path", F.lit(")"))).otherwise("")
    whole = matching.file_hits(files, rules).select(
        "patch_id", "file_idx", F.lit(0).alias("hunk_idx"), F.lit(0).alias("line_idx"), "path", F.col("path").alias("text"), F.lit("").alias("section"), F.lit(0).alias("old_line"), "rule_ord",
        F.lit("").alias("match"), F.when(F.col("status") == "deleted", 0).otherwise(F.coalesce("first_start", F.lit(1))).alias("line"), F.lit(None).cast("string").alias("title_of"),
        F.lit(False).alias("suppressed"), F.lit("").alias("suppressed_by"), F.lit("").alias("suppression_reason"), F.concat("status", F.lit(" "), "path", was).alias("snippet_of"),
    )
    parts.append(whole)
    if detecting:
        lagged = lines.withColumn("prev_text", F.lag("text").over(Window.partitionBy(*matching.HUNK).orderBy("line_idx")))
    for k, d in enumerate(detecting):
        found = d.hits(lagged, cfg).withColumns({"rule_ord": F.lit(len(rules) + k), "snippet_of": F.col("text")})
        parts.append(matching.noted(found, rule_id, cfg.marker).select(common))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rule_id", rule_id).withColumn("fingerprint", T.fingerprint(F.col("rule_id"), F.col("path"), F.col("text")))


def described(hits: DataFrame, rules: list[Rule], cfg: Config, detecting: list[detectors.Detector] = ()) -> DataFrame:
    """Hits with what their rules say and their texts as they may be shown."""
    meta = to_frame(hits.sparkSession, [*rules, *(d.rule for d in detecting)]).drop("rule_id")
    rows = hits.join(F.broadcast(meta), "rule_ord")
    own = F.array("match")
    if cfg.redact_across_rules:
        # Whatever redacting rules found on a line, all of it, is masked in every finding of that line.
        of_line = Window.partitionBy("patch_id", "file_idx", "hunk_idx", "line_idx")
        rows = rows.withColumn("_secrets", F.collect_set(F.when(F.col("redact") & (F.col("match") != ""), F.col("match"))).over(of_line))
        some = F.size("_secrets") > 0
        rows = rows.withColumn("redact", F.col("redact") | some)
        own = F.when(some, F.col("_secrets")).otherwise(own)
    # A match holds its own secret for certain, and others where they lie within it.
    inside = F.filter(own, lambda s: F.contains("match", T.trimmed(s)))
    in_match = F.when(F.size(inside) > 0, inside).otherwise(own)
    shown = lambda text, secrets: F.when(F.col("match") == "", T.truncated(T.trimmed(text))).otherwise(T.displayed(text, secrets, F.col("redact")))
    return rows.withColumns({
        "snippet": F.when(F.col("trigger") == "file", F.col("snippet_of")).otherwise(shown(F.col("snippet_of"), own)), "match": F.when(F.col("match") == "", "").otherwise(shown(F.col("match"), in_match)),
        "title": F.coalesce("title_of", "title"), "section": T.cleaned_section(F.coalesce("section", F.lit(""))), "file": F.col("path"),
    }).drop("title_of", "snippet_of", "path", "text", "_secrets")


def analyse(patches: DataFrame, rules: RuleSet, cfg: Config = Config(), baseline: DataFrame | None = None, strict_hunks: bool = False) -> Analysis:
    """All relations of the analysis of ``patches`` (patch_id, text); every patch with a file has a score."""
    parsed = diff.parse(patches, strict_hunks, cut)
    return analyse_changes(parsed.files, parsed.lines, rules, cfg, baseline, parsed.rejected)


def analyse_changes(files: DataFrame, lines: DataFrame, rules: RuleSet, cfg: Config = Config(), baseline: DataFrame | None = None, rejected: DataFrame | None = None) -> Analysis:
    """The same from files and lines that are parsed already."""
    chosen = rules.selected(cfg.only, cfg.disable, cfg.enable, cfg.severity, cfg.min_confidence)
    detecting = detectors.running(cfg)
    # The conditions of all rules make a wide plan: what follows starts from the few rows that it leaves.
    hits = findings.first_only(cut(hits_of(files, lines, chosen, cfg, detecting)))
    known = baseline if baseline is not None else B.empty(files.sparkSession)
    hits = findings.baselined(hits, B.reasons(known))
    rows = cut(findings.folded(described(hits, chosen, cfg, detecting)))
    rows = routing.routed(scoring.scored(rows, cfg.weights), cfg.router)
    stats = stats_of(files, len(rules), cfg.exclude_paths)
    none = rejected if rejected is not None else files.select("patch_id", F.lit("").alias("reason")).where("false")
    return Analysis(rows, stats, scoring.category_scores(rows), scoring.patch_scores(rows, stats, cfg.weights, cfg.gate), none)
