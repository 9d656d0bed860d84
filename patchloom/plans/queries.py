"""The registered queries of the engine, each with its SQL for a second engine.

All run over every document. The SQL is built from the same rules, whose patterns the second engine reads in their own
dialect; globs, languages and everything else are written for it apart from the functions that Spark runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import text as T
from ..functions.languages import language
from ..operators import diff, entropy, findings, matching, owners, routing, scoring, summaries
from ..sources import baseline as B
from ..sources.baseline_table import BaselineTable
from ..sources.config import Config
from ..sources.rules import Rule, default
from . import catalogue, corpus, settings
from .analysis import Analysis, analyse, described, hits_of, stats_of
from .cut import cut, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ["patch_id", "file_idx", "hunk_idx", "line_idx"]
RULES = corpus.rules().rules
BY_ID = {r.id: r for r in RULES}
IDS = [r.id for r in RULES]
SEVERITY_RANK = "CASE {} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
LANG = "CASE regexp_extract(path, '\\.[^.]*$') WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.tf' THEN 'terraform' WHEN '.yml' THEN 'yaml' ELSE 'markdown' END"


def query(sql: str = "") -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _glob_body(g: str) -> str:
    out, k = "", 0
    while k < len(g):
        if g.startswith("**/", k):
            out, k = out + "([^/]+/)*", k + 3
        elif g.startswith("**", k):
            out, k = out + ".*", k + 2
        elif g[k] == "{":
            end = g.index("}", k)
            out, k = out + "(" + "|".join(map(_glob_body, g[k + 1 : end].split(","))) + ")", end + 1
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(g[k], re.escape(g[k])), k + 1
    return out


def sql_glob(path: str, found: tuple[str, ...]) -> str:
    """Globs read character by character for the second engine; a glob without a slash holds at any depth."""
    whole = lambda g: "(?i)^" + ("" if "/" in g else "(.*/)?") + _glob_body(g) + "$"
    return "(" + " OR ".join(f"regexp_matches({path}, {q(whole(g))})" for g in found) + ")" if found else "false"


def sql_any(text: str, found: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in found) + ")"


def sql_match(text: str, found: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {q(p)}, 0), '')" for p in found) + ")"


def sql_path(r: Rule, lang: str = LANG) -> str:
    out = f"NOT {sql_glob('path', r.exclude_paths)}"
    if r.languages:
        out += f" AND {lang} IN ({', '.join(map(q, r.languages))})"
    return out + (f" AND {sql_glob('path', r.paths)}" if r.paths else "")


def sql_hits(r: Rule, source: str = "ln", lang: str = LANG, order: int | None = None) -> str:
    """The lines that a line rule matches, with its number and the match."""
    kinds = {"added": "('added')", "removed": "('removed')", "any": "('added', 'removed')"}[r.trigger]
    where = f"kind IN {kinds} AND trim(text) <> '' AND {sql_any('text', r.patterns)} AND {sql_path(r, lang)}"
    if r.exclude_patterns:
        where += f" AND NOT {sql_any('text', r.exclude_patterns)}"
    extra = ""
    if r.near:
        over = "PARTITION BY patch_id, file_idx" if r.near.scope == "file" else f"PARTITION BY patch_id, file_idx, hunk_idx ORDER BY line_idx ROWS BETWEEN {r.near.window} PRECEDING AND {r.near.window} FOLLOWING"
        for side, found in (("a", r.near.absent), ("p", r.near.present)):
            if found:
                section = f"section <> '' AND {sql_any('section', found)}"
                inner = f"bool_or({sql_any('text', found)} OR ({section})) OVER ({over})" if r.near.scope == "file" else f"(bool_or({sql_any('text', found)}) OVER ({over}) OR ({section}))"
                extra += f", {inner} AS near_{side}"
                where += f" AND {'NOT ' * (side == 'a')}near_{side}"
    columns = "patch_id, file_idx, hunk_idx, line_idx, path, kind, text, prev_text, section, old_line, new_line, anchor_line"
    return f"SELECT {columns}, {IDS.index(r.id) if order is None else order} AS rule_ord, {q(r.id)} AS rule_id, {sql_match('text', r.patterns)} AS match FROM (SELECT *{extra} FROM {source}) WHERE {where}"


_LINE_RULES = [r for r in RULES if r.trigger != "file"]
_FILE_RULES = [r for r in RULES if r.trigger == "file"]
_META = ", ".join(f"({k}, {q(r.id)}, {q(r.category)}, {q(r.severity)}, {q(r.confidence)}, {q(r.trigger)}, {str(r.redact).lower()}, {q(r.title)})" for k, r in enumerate(RULES))


def sql_noted(text: str, rule: str = "rule_id") -> str:
    """Whether a note in ``text`` names the rule: by id, by a prefix that ends in a star, or by naming none."""
    ids = f"string_split(regexp_extract({text}, {q(T.MARKER + chr(92) + '[([^' + chr(92) + ']]*)' + chr(92) + ']')}, 1), ',')"
    named = f"len(list_filter({ids}, lambda i: trim(i) = {rule} OR (ends_with(trim(i), '*') AND starts_with({rule}, trim(i)[:-2])))) > 0"
    return f"(contains({text}, {q(T.MARKER)}) AND (NOT contains({text}, {q(T.MARKER + '[')}) OR {named}))"


_FINGERPRINT = "substr(sha256(rule_id || chr(0) || path || chr(0) || regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s+', ' ', 'g')), 1, 16)"


def sql_findings(files: bool = True, more: str = "", meta: str = "") -> str:
    """hits: every match; dd: without repeats of a fingerprint and line; fd: folded; sc: with scores."""
    whole = " UNION ALL ".join(
        f"SELECT patch_id, file_idx, 0, 0, path, path AS text, CASE WHEN status = 'deleted' THEN 0 ELSE 1 END, {IDS.index(r.id)}, {q(r.id)}, '', false FROM fl WHERE {sql_path(r)} AND status IN ({', '.join(map(q, r.file_events))})"
        for r in _FILE_RULES
    )
    return f"""
hl AS ({' UNION ALL '.join(sql_hits(r) for r in _LINE_RULES)}),
hits AS (SELECT patch_id, file_idx, hunk_idx, line_idx, path, text, anchor_line AS line, rule_ord, rule_id, match,
    ({sql_noted('text')} OR {sql_noted("coalesce(prev_text, '')")}) AS suppressed FROM hl {'UNION ALL ' * files + whole * files} {more}),
fp AS (SELECT *, {_FINGERPRINT} AS fingerprint FROM hits),
dd AS (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY patch_id, fingerprint, line ORDER BY file_idx, rule_ord, hunk_idx, line_idx) = 1),
meta AS (SELECT * FROM (VALUES {_META}{meta}) m(rule_ord, rid, category, severity, confidence, trigger, redact, title)),
fd AS (SELECT patch_id, rule_id, path AS file, suppressed, rule_ord, list(line ORDER BY file_idx, rule_ord, hunk_idx, line_idx) AS all_lines,
  list(fingerprint ORDER BY file_idx, rule_ord, hunk_idx, line_idx) AS prints, count(*) AS occurrences FROM dd GROUP BY ALL),
sc AS (SELECT fd.*, all_lines[1] AS line, prints[1] AS fingerprint, category, severity, confidence, trigger, title,
  round(CASE severity WHEN 'critical' THEN 40.0 WHEN 'high' THEN 24.0 WHEN 'medium' THEN 10.0 WHEN 'low' THEN 4.0 ELSE 1.0 END
    * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.45 END * CASE trigger WHEN 'removed' THEN 1.3 ELSE 1.0 END * 10.0) / 10.0 AS score
  FROM fd JOIN meta USING (rule_ord))
"""


SQL_HITS = sql_findings()
ALL = f"WITH RECURSIVE {corpus.SQL}, {SQL_HITS}"
LINES = f"WITH {corpus.SQL}"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(spark, sf_dir)


def _hits(spark: SparkSession, sf_dir: str, rules: list[Rule] = RULES) -> DataFrame:
    return hits_of(corpus.files(spark, sf_dir), corpus.lines(spark, sf_dir), rules, Config())


def _folded(spark: SparkSession, sf_dir: str, cfg: Config = Config()) -> DataFrame:
    rows = described(findings.first_only(_hits(spark, sf_dir)), RULES, cfg)
    return scoring.scored(findings.folded(rows), cfg.weights)


def _one(rule_id: str) -> Query:
    return lambda spark, sf_dir: matching.line_hits(_lines(spark, sf_dir), [BY_ID[rule_id]]).select(*KEY, "match")


def _one_sql(rule_id: str) -> str:
    return f"{LINES} SELECT patch_id, file_idx, hunk_idx, line_idx, match FROM ({sql_hits(BY_ID[rule_id])})"


@query(f"{LINES} SELECT patch_id, file_idx, hunk_idx, line_idx, kind, path, text, section FROM ln")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*KEY, "kind", "path", "text", "section")


@query(f"{LINES} SELECT patch_id, file_idx, hunk_idx, line_idx, old_line, new_line FROM ln")
def line_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*KEY, "old_line", "new_line")


@query(f"{LINES} SELECT patch_id, file_idx, hunk_idx, line_idx, anchor_line FROM ln")
def anchor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*KEY, "anchor_line")


@query(f"{LINES} SELECT patch_id, count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM fl GROUP BY patch_id")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.totals(corpus.files(spark, sf_dir))


@query(f"{LINES} SELECT patch_id, {LANG} AS language, count(*) AS files FROM fl GROUP BY ALL")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).groupBy("patch_id", language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


_GLOBS = ("src1*/**", "**/de/*.{py,tf}", "*_7?.md")


@query(f"{LINES} SELECT patch_id, file_idx, path FROM fl WHERE NOT {sql_glob('path', _GLOBS)}")
def path_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).where(~globs.any_of(F.col("path"), list(_GLOBS))).select("patch_id", "file_idx", "path")


@query(f"{LINES} " + " UNION ALL ".join(f"SELECT patch_id, file_idx, {q(r.id)} AS rule_id FROM fl WHERE {sql_path(r)}" for r in RULES))
def rule_path_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.files(spark, sf_dir).withColumn("lang", language(F.col("path")))
    on = F.array(*[F.when(matching.path_applies(r, F.col("path"), F.col("lang")), F.lit(r.id)) for r in RULES])
    return rows.select("patch_id", "file_idx", F.explode(F.filter(on, lambda x: x.isNotNull())).alias("rule_id"))


@query(f"{LINES} SELECT kind, count(*) AS n, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind <> 'context') AS changed FROM ln GROUP BY kind")
def trigger_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda t: F.count_if(matching.triggered(Rule("x.x", on=t), F.col("kind")))
    return _lines(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), on("added").alias("added"), on("removed").alias("removed"), on("any").alias("changed"))


for _name, _rule in (
    ("rule_match_first", "corpus.rights-reserved"), ("exclude_patterns", "corpus.license-notice"), ("removed_line_rule", "corpus.address-removed"), ("rule_path_and_match", "corpus.mail-address"),
    ("near_absent_hunk", "corpus.shouting"), ("near_present_hunk", "corpus.table-row"), ("near_file_scope", "corpus.marks"),
):
    QUERIES[_name], SQL[_name] = _one(_rule), _one_sql(_rule)


@query(f"{LINES} SELECT patch_id, file_idx, path, status FROM fl WHERE {sql_path(_FILE_RULES[0])} AND status IN ('created', 'deleted')")
def file_event_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.file_hits(corpus.files(spark, sf_dir), _FILE_RULES).select("patch_id", "file_idx", "path", "status")


@query(f"{ALL} SELECT patch_id, file_idx, hunk_idx, line_idx, rule_id, match, line FROM hits")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select(*KEY, "rule_id", "match", "line")


#: Values of documents rarely stand in assignments: every mail-like or marked word is given to a credential's name.
_SECRET = r"([A-Za-z0-9_.+\-@#$%&*]{20,})"
_ASSIGNED = "api_token = \""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.regexp_extract("text", _SECRET, 1)
    return _lines(spark, sf_dir).where(F.col("text").rlike(_SECRET)).withColumn("text", F.concat(F.lit(_ASSIGNED), word, F.lit('"')))


_ASSIGNED_SQL = f"""{LINES}, w AS (SELECT * EXCLUDE (text), regexp_extract(text, {q(_SECRET)}, 1) AS value FROM ln WHERE regexp_matches(text, {q(_SECRET)})),
cand AS (SELECT * FROM w WHERE strlen(value) BETWEEN 20 AND 200 AND NOT regexp_matches(value, {q(entropy.PLACEHOLDERS.replace('(?iu)', '(?i)'))}) AND NOT regexp_matches(value, {q(entropy.STRUCTURAL.replace('(?iu)', '(?i)'))})),
meas AS (SELECT *, -list_sum(list_transform(map_values(histogram_of), lambda c: (c / strlen(value)) * log2(c / strlen(value)))) AS bits
  FROM (SELECT *, (SELECT histogram(ch) FROM (SELECT unnest(string_split(value, '')) AS ch)) AS histogram_of FROM cand))"""


@query(f"{_ASSIGNED_SQL} SELECT patch_id, file_idx, hunk_idx, line_idx, 'api_token' AS name, value FROM cand")
def entropy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.candidates(_assigned(spark, sf_dir)).select(*KEY, "name", "value")


@query(
    f"{_ASSIGNED_SQL} SELECT patch_id, file_idx, hunk_idx, line_idx, value, round(bits, 6) AS bits FROM meas WHERE kind = 'added' AND bits >= 3.0 AND "
    "((regexp_matches(value, '[a-z]')::INT + regexp_matches(value, '[A-Z]')::INT + regexp_matches(value, '[0-9]')::INT + regexp_matches(value, '[^a-zA-Z0-9]')::INT) >= 3 "
    "OR ((regexp_matches(value, '[a-z]')::INT + regexp_matches(value, '[A-Z]')::INT + regexp_matches(value, '[0-9]')::INT + regexp_matches(value, '[^a-zA-Z0-9]')::INT) >= 2 AND strlen(value) >= 32))"
)
def entropy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.hits(_assigned(spark, sf_dir), min_entropy=3.0).select(*KEY, "value", F.round(T.entropy(F.col("value")), 6).alias("bits"))


_MASK = "CASE WHEN strlen({0}) <= 6 THEN '[redacted]' WHEN strlen({0}) <= 16 THEN substr({0}, 1, 3) || '[redacted]' ELSE substr({0}, 1, 4) || '[redacted ' || (strlen({0}) - 4) || ' chars]' END"


@query(f"{LINES}, h AS ({sql_hits(BY_ID['corpus.mail-address'])}) SELECT patch_id, file_idx, hunk_idx, line_idx, {_MASK.format('match')} AS masked, replace(text, match, {_MASK.format('match')}) AS line FROM h")
def mask_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.line_hits(_lines(spark, sf_dir), [BY_ID["corpus.mail-address"]])
    return rows.select(*KEY, T.masked(F.col("match")).alias("masked"), T.redacted(F.col("text"), F.col("match")).alias("line"))


@query(
    f"{LINES} SELECT patch_id, file_idx, hunk_idx, line_idx, CASE WHEN strlen(text) <= 200 THEN text ELSE text[1 : "
    "(SELECT max(k) FROM (SELECT unnest(range(49, 201)) AS k) WHERE strlen(text[1 : k]) <= 200)] || '...' END AS snippet FROM ln"
)
def truncate_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*KEY, T.truncated(F.col("text")).alias("snippet"))


@query(f"{LINES} SELECT patch_id, file_idx, hunk_idx, line_idx, {_FINGERPRINT.replace('rule_id', q('corpus.any'))} AS fingerprint FROM ln")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*KEY, T.fingerprint(F.lit("corpus.any"), F.col("path"), F.col("text")).alias("fingerprint"))


@query(f"{ALL} SELECT patch_id, file_idx, hunk_idx, line_idx, rule_id, suppressed, CASE WHEN suppressed THEN 'vetted' ELSE '' END AS reason FROM hits")
def inline_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select(*KEY, "rule_id", "suppressed", F.col("suppression_reason").alias("reason"))


def _accepted(hits: DataFrame) -> DataFrame:
    """Every eighth fingerprint, as a baseline."""
    return hits.where(F.col("fingerprint").rlike("^[08]")).select("fingerprint", F.lit("").alias("reason")).distinct()


@query(f"{ALL} SELECT patch_id, rule_id, path, line, fingerprint, suppressed OR regexp_matches(fingerprint, '^[08]') AS suppressed, CASE WHEN regexp_matches(fingerprint, '^[08]') THEN 'baseline' WHEN suppressed THEN 'inline' ELSE '' END AS suppressed_by FROM dd")
def baseline_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings.first_only(_hits(spark, sf_dir))
    return findings.baselined(rows, B.reasons(_accepted(rows))).select("patch_id", "rule_id", "path", "line", "fingerprint", "suppressed", "suppressed_by")


@query(f"{ALL} SELECT patch_id, rule_id, path, line, fingerprint FROM dd WHERE NOT regexp_matches(fingerprint, '^[08]')")
def baseline_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings.first_only(_hits(spark, sf_dir))
    return rows.join(_accepted(rows), "fingerprint", "left_anti").select("patch_id", "rule_id", "path", "line", "fingerprint")


@query(f"{ALL} SELECT DISTINCT fingerprint, rule_id AS rule, path AS file FROM dd")
def baseline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _folded(spark, sf_dir)
    existing = _accepted(rows).join(rows.select("fingerprint", F.col("rule_id").alias("rule"), "file").distinct(), "fingerprint").withColumn("added_at", F.lit("2024-01-01"))
    return B.merged(existing, rows, "", "2024-01-02").select("fingerprint", "rule", "file")


@query(f"{ALL} SELECT patch_id, file_idx, hunk_idx, line_idx, rule_id, line, fingerprint FROM dd")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.first_only(_hits(spark, sf_dir)).select(*KEY, "rule_id", "line", "fingerprint")


@query(
    f"{ALL} SELECT patch_id, rule_id, file, suppressed, line, fingerprint, occurrences, array_to_string(list_filter(all_lines[2:], lambda x: x > 0)[1:8], ',') AS other_lines, "
    "array_to_string(prints[2:], ',') AS related FROM sc"
)
def fold_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select(
        "patch_id", "rule_id", "file", "suppressed", "line", "fingerprint", F.col("occurrences").cast("long").alias("occurrences"), F.array_join(F.col("other_lines").cast("array<string>"), ",").alias("other_lines"),
        F.array_join("related_fingerprints", ",").alias("related"),
    )


_OVERRIDE = {"corpus.marks": "critical", "corpus.table-row": "info"}


@query(f"{ALL} SELECT patch_id, rule_id, CASE rule_id WHEN 'corpus.marks' THEN 'critical' WHEN 'corpus.table-row' THEN 'info' ELSE severity END AS severity, count(*) AS n FROM sc GROUP BY ALL")
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = corpus.rules().selected(severity=_OVERRIDE)
    rows = findings.folded(described(findings.first_only(_hits(spark, sf_dir, chosen)), chosen, Config()))
    return rows.groupBy("patch_id", "rule_id", "severity").agg(F.count("*").alias("n"))


@query(f"{ALL} SELECT rule_id, count(*) AS n FROM hits WHERE rule_id IN ('corpus.marks', 'corpus.table-row') GROUP BY rule_id")
def ruleset_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = corpus.rules().selected(only=("corpus.marks", "corpus.table-row", "corpus.shouting"), disable=("corpus.shouting",))
    return _hits(spark, sf_dir, chosen).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"{ALL} SELECT rule_id, count(*) AS n FROM hits JOIN meta USING (rule_ord) WHERE confidence IN ('high', 'medium') GROUP BY rule_id")
def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, corpus.rules().selected(min_confidence="medium")).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"{ALL} SELECT patch_id, rule_id, file, suppressed, severity, confidence, trigger, score FROM sc")
def finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("patch_id", "rule_id", "file", "suppressed", "severity", "confidence", "trigger", "score")


_CATEGORIES = f"cs AS (SELECT patch_id, category, round(sum(score), 1) AS score, count(*) AS n, arg_max(severity, {SEVERITY_RANK.format('severity')}) AS worst FROM sc WHERE NOT suppressed GROUP BY ALL)"


@query(f"{ALL}, {_CATEGORIES} SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY score DESC, category) AS category_order FROM cs")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.category_scores(_folded(spark, sf_dir)).select("patch_id", "category", "score", F.col("count").cast("long").alias("n"), "worst", F.col("category_order").cast("long").alias("category_order"))


_TOTALS = f"""tt AS (SELECT patch_id, round(sum(score), 1) AS raw, max(score) AS lead, max({SEVERITY_RANK.format('severity')}) AS worst_rank, count(*) AS n FROM sc WHERE NOT suppressed GROUP BY patch_id),
st AS (SELECT patch_id, count(*) AS files, sum(additions + deletions) AS changed FROM fl GROUP BY patch_id),
sg AS (SELECT patch_id, files, changed, coalesce(raw, 0) AS raw, coalesce(worst_rank, 0) AS worst_rank, coalesce(n, 0) AS n, 15.0 * (1 - exp(-(files / 25.0 + changed / 800.0))) AS blast,
  CASE WHEN n > 0 THEN 85.0 * (1 - exp(-lead / 38.0)) + (85.0 - 85.0 * (1 - exp(-lead / 38.0))) * (1 - exp(-(raw - lead) / 70.0)) ELSE 0 END AS signals FROM st LEFT JOIN tt USING (patch_id)),
ps AS (SELECT *, least(100.0, signals + blast) AS exact FROM sg)"""
_R1 = "round({} * 10) / 10"


@query(
    f"{ALL}, {_TOTALS} SELECT patch_id, raw, {_R1.format('signals')} AS signals, {_R1.format('blast')} AS blast_radius, {_R1.format('exact')} AS total, "
    "CASE WHEN exact >= 75 THEN 'critical' WHEN exact >= 45 THEN 'high' WHEN exact >= 20 THEN 'medium' WHEN exact >= 5 THEN 'low' ELSE 'minimal' END AS band FROM ps"
)
def patch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stats_of(corpus.files(spark, sf_dir), len(RULES))
    return scoring.patch_scores(_folded(spark, sf_dir), stats).select("patch_id", "raw", "signals", "blast_radius", "total", "band")


@query(
    f"{ALL}, {_TOTALS}, g AS (SELECT *, (SELECT count(*) FROM sc WHERE NOT suppressed AND sc.patch_id = ps.patch_id AND {SEVERITY_RANK.format('severity')} = ps.worst_rank) AS n_worst FROM ps) "
    f"SELECT patch_id, CASE WHEN worst_rank >= 4 THEN n_worst || ' ' || CASE worst_rank WHEN 5 THEN 'critical' ELSE 'high' END || CASE WHEN n_worst = 1 THEN ' finding' ELSE ' findings' END || ' (gate: --fail-on high)' "
    f"WHEN {_R1.format('exact')} >= 40 THEN 'risk score ' || regexp_replace(printf('%.1f', {_R1.format('exact')}), '\\.0$', '') || ' reached the configured threshold 40' ELSE '' END AS gate_reason FROM g"
)
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stats_of(corpus.files(spark, sf_dir), len(RULES))
    return scoring.patch_scores(_folded(spark, sf_dir), stats, gate=scoring.Gate("high", 40)).select("patch_id", "gate_reason")


@query(
    f"{ALL} SELECT patch_id, rule_id, file, score, driver_order FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY score DESC, {SEVERITY_RANK.format('severity')} DESC, "
    "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, file, line, rule_id) AS driver_order FROM sc WHERE NOT suppressed) WHERE driver_order <= 3"
)
def top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_drivers(_folded(spark, sf_dir)).select("patch_id", "rule_id", "file", "score", F.col("driver_order").cast("long").alias("driver_order"))


@query(f"{ALL} SELECT coalesce(severity, 'all') AS severity, coalesce(category, 'all') AS category, count(*) AS n FROM sc WHERE NOT suppressed GROUP BY CUBE (severity, category)")
def severity_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _folded(spark, sf_dir).where("not suppressed").cube("severity", "category").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("severity", F.lit("all")).alias("severity"), F.coalesce("category", F.lit("all")).alias("category"), "n")


@query(f"{ALL} SELECT patch_id, arg_max(severity, {SEVERITY_RANK.format('severity')}) AS severity FROM sc WHERE NOT suppressed GROUP BY patch_id")
def highest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.highest(_folded(spark, sf_dir))


@query(f"{ALL}, g AS (SELECT patch_id, file, count(*) AS n, max({SEVERITY_RANK.format('severity')}) AS k, arg_max(severity, {SEVERITY_RANK.format('severity')}) AS worst FROM sc WHERE NOT suppressed GROUP BY ALL) SELECT patch_id, file, n, worst, row_number() OVER (PARTITION BY patch_id ORDER BY k DESC, file) AS file_order FROM g")
def findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_file(_folded(spark, sf_dir)).withColumn("file_order", F.col("file_order").cast("long"))


_ROUTER = routing.Router(
    (
        routing.Route(("@net", "@privacy"), "addresses", categories=("information-disclosure", "secrets")),
        routing.Route(("@docs",), "notices", rules=("corpus.l*", "corpus.rights-reserved"), paths=("**/*.py", "**/*.md")),
        routing.Route(("@lead",), "worst", min_severity="high"),
    ),
    (("*", ("@everyone",)), ("*.go", ("@gophers",)), ("/src3/", ("@three", "@four")), ("/src4/de/", ())),
    ("@fallback",),
)
_ROUTED = f"""rt AS (SELECT *, list_concat(CASE WHEN category IN ('information-disclosure', 'secrets') THEN ['@net', '@privacy'] ELSE [] END,
  CASE WHEN (starts_with(rule_id, 'corpus.l') OR rule_id = 'corpus.rights-reserved') AND (ends_with(file, '.py') OR ends_with(file, '.md')) THEN ['@docs'] ELSE [] END,
  CASE WHEN {SEVERITY_RANK.format('severity')} >= 4 THEN ['@lead'] ELSE [] END) AS found,
  CASE WHEN starts_with(file, 'src4/de/') THEN [] WHEN starts_with(file, 'src3/') THEN ['@three', '@four'] WHEN ends_with(file, '.go') THEN ['@gophers'] ELSE ['@everyone'] END AS owned FROM sc WHERE NOT suppressed),
rv AS (SELECT *, CASE WHEN len(found) > 0 THEN found WHEN len(owned) > 0 THEN owned ELSE ['@fallback'] END AS reviewers FROM rt)"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routed(_folded(spark, sf_dir), _ROUTER).where("not suppressed")


@query(f"{ALL}, {_ROUTED} SELECT patch_id, rule_id, file, array_to_string(reviewers, ' ') AS reviewers FROM rv")
def route_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("patch_id", "rule_id", "file", F.array_join("reviewers", " ").alias("reviewers"))


@query(f"{LINES} SELECT patch_id, path, CASE WHEN starts_with(path, 'src4/de/') THEN '' WHEN starts_with(path, 'src3/') THEN '@three @four' WHEN ends_with(path, '.go') THEN '@gophers' ELSE '@everyone' END AS owners FROM fl")
def codeowners_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("patch_id", "path", F.array_join(routing.owners_of(F.col("path"), _ROUTER.owners), " ").alias("owners"))


@query(f"{ALL}, {_ROUTED}, ix AS (SELECT patch_id, unnest(reviewers) AS reviewer FROM rv), n AS (SELECT patch_id, reviewer, count(*) AS n FROM ix GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY n DESC, reviewer) AS reviewer_order FROM n")
def reviewer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.reviewer_index(_routed(spark, sf_dir)).select("patch_id", "reviewer", "n", F.col("reviewer_order").cast("long").alias("reviewer_order"))


@query(
    f"{ALL} SELECT patch_id, rule_id, CASE WHEN {SEVERITY_RANK.format('severity')} >= 4 THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, file AS uri, line AS start_line, fingerprint, "
    "CASE WHEN suppressed THEN 'inSource' ELSE '' END AS suppression, row_number() OVER (PARTITION BY patch_id ORDER BY suppressed, "
    f"{SEVERITY_RANK.format('severity')} DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, file, line, rule_id) AS result_order FROM sc"
)
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .reports import sarif_rows

    rows = sarif_rows(_folded(spark, sf_dir).withColumn("reviewers", F.array().cast("array<string>")))
    return rows.select("patch_id", "rule_id", "level", F.col("file").alias("uri"), F.col("line").alias("start_line"), "fingerprint", "suppression", F.col("result_order").cast("long").alias("result_order"))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that several parts of a report read: every line is matched once."""
    rows = described(findings.first_only(cut(_hits(spark, sf_dir))), RULES, Config())
    return scoring.scored(routing.routed(cut(findings.folded(rows)), _ROUTER))


_FIRST = f"SELECT patch_id, arg_min(rule_id, k) AS first_rule, arg_min(file, k) AS first_file, arg_min(fingerprint, k) AS first_print FROM (SELECT *, (-{SEVERITY_RANK.format('severity')}, CASE confidence WHEN 'high' THEN -3 WHEN 'medium' THEN -2 ELSE -1 END, file, line, rule_id) AS k FROM sc WHERE NOT suppressed) GROUP BY patch_id"


@query(
    f"{ALL}, {_TOTALS}, f1 AS ({_FIRST}), hs AS (SELECT patch_id, count(*) AS n FROM sc WHERE suppressed GROUP BY patch_id), hi AS (SELECT patch_id, count(*) AS n FROM sc WHERE NOT suppressed AND severity = 'high' GROUP BY patch_id), "
    f"cs AS (SELECT patch_id, category, sum(score) AS score FROM sc WHERE NOT suppressed GROUP BY ALL), c1 AS (SELECT patch_id, arg_min(category, (-round(score, 1), category)) AS worst_category FROM cs GROUP BY patch_id) "
    f"SELECT ps.patch_id, {_R1.format('exact')} AS total, ps.files AS files_changed, ps.n AS findings, coalesce(hs.n, 0) AS ignored, coalesce(hi.n, 0) AS high, worst_category, first_rule, first_file, first_print "
    "FROM ps LEFT JOIN f1 USING (patch_id) LEFT JOIN hs USING (patch_id) LEFT JOIN hi USING (patch_id) LEFT JOIN c1 USING (patch_id)"
)
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report for each patch, and what a reader finds in it."""
    from .reports import json_reports

    rows = _kept(spark, sf_dir)
    stats = stats_of(corpus.files(spark, sf_dir), len(RULES))
    said = json_reports(rows, stats, scoring.category_scores(rows), scoring.patch_scores(rows, stats))
    of = lambda path: F.get_json_object("report", "$." + path)
    n = lambda path: F.coalesce(of(path).cast("long"), F.lit(0))
    return said.select(
        "patch_id", of("score.total").cast("double").alias("total"), n("stats.files_changed").alias("files_changed"), n("summary.total").alias("findings"), n("summary.suppressed").alias("ignored"),
        n("summary.by_severity.high").alias("high"), of("score.categories[0].category").alias("worst_category"), of("findings[0].rule_id").alias("first_rule"), of("findings[0].file").alias("first_file"),
        of("findings[0].fingerprint").alias("first_print"),
    )


def as_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' changes written out as unified diffs, one patch_id each."""
    rows = corpus.by_patch(spark, sf_dir)
    sign = F.when(F.col("kind") == "added", "+").when(F.col("kind") == "removed", "-").otherwise(" ")
    hunks = rows.groupBy("patch_id", "file_idx", "path", "hunk_idx", "section", "new_start").agg(F.sort_array(F.collect_list(F.struct("line_idx", F.concat(sign, "text").alias("t")))).alias("ls"))
    head = F.concat(F.lit("@@ -"), "new_start", F.lit(" +"), "new_start", F.lit(" @@ "), "section", F.lit("\n"))
    body = hunks.withColumn("h", F.concat(head, F.array_join(F.transform("ls", lambda x: x["t"]), "\n")))
    by_file = body.groupBy("patch_id", "file_idx", "path").agg(F.sort_array(F.collect_list(F.struct("hunk_idx", "h"))).alias("hs"))
    title = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"))
    texts = by_file.withColumn("f", F.concat(title, F.array_join(F.transform("hs", lambda x: x["h"]), "\n")))
    whole = texts.groupBy("patch_id").agg(F.sort_array(F.collect_list(F.struct("file_idx", "f"))).alias("fs"))
    return whole.select(F.col("patch_id").cast("string").alias("patch_id"), F.array_join(F.transform("fs", lambda x: x["f"]), "\n").alias("text"))


@query(f"{LINES} SELECT patch_id::VARCHAR AS patch_id, file_idx, hunk_idx, line_idx, kind, path, trim(section) AS section, old_line, new_line, anchor_line FROM ln")
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the changes as diffs, parse them again, and get the relation that they were written from."""
    parsed = diff.parse(as_patches(spark, sf_dir))
    return parsed.lines.select(*KEY, "kind", "path", "section", "old_line", "new_line", "anchor_line")


_RE2 = lambda p: q(p.replace("(?iu)", "(?i)"))
_MET = q(entropy.ASSIGNMENT)
_ENTROPY_SQL = f"""ev AS (SELECT *, regexp_extract(text, {_MET}, 1) AS name, coalesce(nullif(regexp_extract(text, {_MET}, 2), ''), nullif(regexp_extract(text, {_MET}, 3), ''),
  nullif(regexp_extract(text, {_MET}, 4), ''), nullif(regexp_extract(text, {_MET}, 5), '')) AS value FROM ln WHERE kind = 'added' AND regexp_matches(text, {_MET})),
eb AS (SELECT * EXCLUDE (h), -list_sum(list_transform(map_values(h), lambda c: (c / strlen(value)) * log2(c / strlen(value)))) AS bits FROM
  (SELECT *, (SELECT histogram(b) FROM (SELECT substr(hex(value), 2 * k + 1, 2) AS b FROM (SELECT unnest(range(strlen(value))) AS k))) AS h FROM ev
  WHERE strlen(value) >= 20 AND regexp_matches(name, {_RE2(entropy.NAMES)}) AND NOT regexp_matches(value, {_RE2(entropy.PLACEHOLDERS)}) AND NOT regexp_matches(value, {_RE2(entropy.STRUCTURAL)})
  AND strlen(value) - strlen(replace(value, '/', '')) <= 2)),
eh AS (SELECT *, regexp_matches(value, '[a-z]')::INT + regexp_matches(value, '[A-Z]')::INT + regexp_matches(value, '[0-9]')::INT + regexp_matches(value, '[^a-zA-Z0-9]')::INT AS kinds FROM eb WHERE bits >= 3.6)"""
_ENTROPY_HITS = f"UNION ALL SELECT patch_id, file_idx, hunk_idx, line_idx, path, text, new_line, {len(RULES)}, {q(entropy.RULE.id)}, value, ({sql_noted('text', q(entropy.RULE.id))} OR {sql_noted("coalesce(prev_text, '')", q(entropy.RULE.id))}) FROM eh WHERE kinds >= 3 OR (kinds = 2 AND strlen(value) >= 32)"
_ENTROPY_META = f", ({len(RULES)}, {q(entropy.RULE.id)}, 'secrets', 'high', 'low', 'added', true, '')"


@query(
    f"WITH RECURSIVE {corpus.SQL}, {_ENTROPY_SQL}, {sql_findings(False, _ENTROPY_HITS, _ENTROPY_META)}, {_TOTALS} SELECT patch_id::VARCHAR AS patch_id, files AS files_changed, changed AS lines_changed, n AS findings, raw, "
    f"{_R1.format('signals')} AS signals, {_R1.format('blast')} AS blast_radius, {_R1.format('exact')} AS total, "
    "CASE WHEN exact >= 75 THEN 'critical' WHEN exact >= 45 THEN 'high' WHEN exact >= 20 THEN 'medium' WHEN exact >= 5 THEN 'low' ELSE 'minimal' END AS band FROM ps"
)
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs in, a score per patch out, with the corpus rules and the entropy detector. Every file is a modified one."""
    scores = analyse(as_patches(spark, sf_dir), corpus.rules()).scores
    return scores.select(
        "patch_id", F.col("files_changed").cast("long").alias("files_changed"), (F.col("additions") + F.col("deletions")).cast("long").alias("lines_changed"), F.col("n_findings").alias("findings"),
        "raw", "signals", "blast_radius", "total", "band",
    )


@query(re.sub(r"SELECT patch_id::VARCHAR.*?CASE WHEN exact", f"SELECT patch_id::VARCHAR AS patch_id, n AS findings, raw, {_R1.format('exact')} AS total, CASE WHEN exact", SQL["end_to_end"], flags=re.S))
def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diffs arrive in files of many patches and go through the analysis in micro-batches."""
    from ..streaming.incremental import analysed, arriving_tables

    at = scratch(spark, "stream")
    as_patches(spark, sf_dir).write.option("compression", "zstd").parquet(f"{at}/in")
    analysed(arriving_tables(spark, f"{at}/in"), corpus.rules(), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{at}/out/scores")
    return rows.select("patch_id", F.col("n_findings").alias("findings"), "raw", "total", "band")


BUILTIN = default().rules
_BUILTIN_LINE_RULES = [(k, r) for k, r in enumerate(BUILTIN) if r.trigger != "file"]


def _named(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rule_id", F.element_at(F.array(*[F.lit(r.id) for r in BUILTIN]), F.col("rule_ord") + 1))


_CASE_LANG = "CASE path " + " ".join(f"WHEN {q(p)} THEN {q(lang)}" for p, lang in catalogue.LANGUAGE.items()) + " END"
_DERIVED = f"WITH {catalogue.derived_sql(BUILTIN, q)}, h AS ({' UNION ALL '.join(sql_hits(r, 'dv', _CASE_LANG, k) for k, r in _BUILTIN_LINE_RULES)})"


@query(f'{_DERIVED} SELECT "case", rule_id, count(*) AS n, count(DISTINCT h.patch_id) AS patches FROM h JOIN dv USING (patch_id, file_idx, hunk_idx, line_idx) GROUP BY ALL')
def catalogue_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule finds each of the cases in the changes made of documents."""
    found = _named(matching.line_hits(catalogue.derived(spark, sf_dir, BUILTIN), BUILTIN))
    return found.groupBy("case", "rule_id").agg(F.count("*").alias("n"), F.count_distinct("patch_id").alias("patches"))


_BOTH = [*KEY, "kind", "path", "text", "section", "old_line", "new_line", "anchor_line"]


@query(
    f"{LINES}, {catalogue.derived_sql(BUILTIN, q)}, lm AS MATERIALIZED (SELECT {', '.join(_BOTH)}, prev_text FROM ln UNION ALL SELECT {', '.join(_BOTH).replace('file_idx', 'file_idx + 1000')}, prev_text FROM dv), "
    f"h AS ({' UNION ALL '.join(sql_hits(r, 'lm', f'coalesce({_CASE_LANG}, {LANG})', k) for k, r in _BUILTIN_LINE_RULES)}) SELECT patch_id, file_idx, hunk_idx, line_idx, rule_id, match FROM h"
)
def catalogue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line rule of the packs over the lines of all documents, and over changes made of them and of each rule's cases."""
    made = catalogue.derived(spark, sf_dir, BUILTIN).withColumn("file_idx", F.col("file_idx") + 1000)
    return _named(matching.line_hits(_lines(spark, sf_dir).select(_BOTH).unionByName(made.select(_BOTH)), BUILTIN)).select(*KEY, "rule_id", "match")


@query(f"{ALL} SELECT patch_id, rule_id, count(*) AS n, (SELECT count(*) FROM fl WHERE fl.patch_id = hits.patch_id AND {sql_glob('fl.path', _GLOBS)}) AS files_skipped FROM hits WHERE NOT {sql_glob('path', _GLOBS)} GROUP BY ALL")
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by rule and the files left out, with globs that exclude some paths."""
    files = corpus.files(spark, sf_dir)
    hits = hits_of(files, _lines(spark, sf_dir), RULES, Config(exclude_paths=_GLOBS)).groupBy("patch_id", "rule_id").agg(F.count("*").alias("n"))
    stats = stats_of(files, len(RULES), _GLOBS).select("patch_id", F.col("files_skipped").cast("long").alias("files_skipped"))
    return hits.join(stats, "patch_id").select("patch_id", "rule_id", "n", "files_skipped")


_WEIGHTS = scoring.Weights({"critical": 50.0, "low": 6.0}, 1.5, 50.0, 30.0, 20.0, {"critical": 80.0})


def _reweighted(sql: str) -> str:
    for old, new in (("'critical' THEN 40.0", "'critical' THEN 50.0"), ("'low' THEN 4.0", "'low' THEN 6.0"), ("THEN 1.3 ELSE", "THEN 1.5 ELSE"), ("85.0", "80.0"), ("15.0 *", "20.0 *"), ("/ 38.0", "/ 30.0"), ("/ 70.0", "/ 50.0"), (">= 75", ">= 80")):
        sql = sql.replace(old, new)
    return sql


@query(_reweighted(SQL["patch_score"]))
def weight_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of patches with every weight changed."""
    rows = _folded(spark, sf_dir, Config(weights=_WEIGHTS))
    stats = stats_of(corpus.files(spark, sf_dir), len(RULES))
    return scoring.patch_scores(rows, stats, _WEIGHTS).select("patch_id", "raw", "signals", "blast_radius", "total", "band")


_NOTES = [f"# {T.MARKER}[a.b, c.*] why", f"// {T.MARKER} a.b -- because", f"# {T.MARKER} a.b because", f"/* {T.MARKER} reason only */", f"# {T.MARKER}", f"# {T.MARKER}[a.b not closed"]
_SAID = [("a.b c.*", "false", "why"), ("a.b", "false", "because"), ("a.b", "false", "because"), ("", "true", "reason only"), ("", "true", ""), (None, None, None)]
_PICK = lambda k: "CASE line_idx % 6 " + " ".join(f"WHEN {n} THEN {'NULL' if x[k] is None else q(x[k])}" for n, x in enumerate(_SAID)) + " END"


@query(f"{LINES} SELECT patch_id, file_idx, hunk_idx, line_idx, {_PICK(0)} AS ids, {_PICK(1)} AS every, {_PICK(2)} AS reason FROM ln")
def suppression_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of a suppression note, read from lines that end in it."""
    notes = F.element_at(F.array(*map(F.lit, _NOTES)), F.col("line_idx") % 6 + 1)
    note = T.suppression(F.concat(F.substring(F.md5("text"), 1, 6), F.lit(" = 1 "), notes))
    rows = _lines(spark, sf_dir).select(*KEY, note.alias("note"))
    return rows.select(*KEY, F.array_join("note.ids", " ").alias("ids"), F.col("note.every").cast("string").alias("every"), F.col("note.reason").alias("reason"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each document, of one of six kinds of file headers."""
    one, two, p = F.substring(F.md5("text"), 1, 8), F.substring(F.md5("text"), 9, 8), F.col("path")
    body = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("\n"))
    kinds = [
        body("diff --git a/", p, " b/", p, "\nnew file mode 100644\nindex 000..1\n--- /dev/null\n+++ b/", p, "\n@@ -0,0 +1,2 @@\n+", one, "\n+", two),
        body("diff --git a/", p, " b/", p, "\ndeleted file mode 100755\n--- a/", p, "\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-", one, "\n-", two),
        body("diff --git a/", p, " b/", p, ".new\nsimilarity index 90%\nrename from ", p, "\nrename to ", p, ".new\n--- a/", p, "\n+++ b/", p, ".new\n@@ -1 +1 @@\n-", one, "\n+", two),
        body("diff --git a/", p, " b/", p, "\nBinary files a/", p, " and b/", p, " differ"),
        body("diff --git a/", p, " b/", p, "\nold mode 100644\nnew mode 100755"),
        body('diff --git "a/caf\\303\\251/', p, '" "b/caf\\303\\251/', p, '"\n--- "a/caf\\303\\251/', p, '"\t2024-01-01\n+++ "b/caf\\303\\251/', p, '"\n@@ -1 +1 @@\n-', one, "\n+", two),
    ]
    docs = corpus._keys(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("text is not null")
    return docs.select(F.col("doc_id").cast("string").alias("patch_id"), F.element_at(F.array(*kinds), (F.col("doc_id") % 6 + 1).cast("int")).alias("text"))


@query(
    f"WITH {corpus.SQL} SELECT doc_id::VARCHAR AS patch_id, CASE doc_id % 6 WHEN 2 THEN path || '.new' WHEN 5 THEN 'café/' || path ELSE path END AS path, CASE doc_id % 6 WHEN 2 THEN path ELSE '' END AS old_path, "
    "CASE doc_id % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status, doc_id % 6 = 3 AS \"binary\", CASE doc_id % 6 WHEN 1 THEN '100755' WHEN 4 THEN '100644' ELSE '' END AS old_mode, "
    "CASE doc_id % 6 WHEN 0 THEN '100644' WHEN 4 THEN '100755' ELSE '' END AS new_mode, CASE doc_id % 6 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 1 ELSE 0 END::BIGINT AS additions, "
    "CASE doc_id % 6 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 1 ELSE 0 END::BIGINT AS deletions FROM src"
)
def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created, deleted, renamed, binary, re-moded and quoted files, parsed."""
    return diff.parse(_states(spark, sf_dir)).files.select("patch_id", "path", "old_path", "status", "binary", "old_mode", "new_mode", "additions", "deletions")


@query(f"{LINES} SELECT patch_id, file_idx, hunk_idx, line_idx, CASE WHEN strlen(s) > 80 THEN s[1 : 77] || '...' ELSE s END AS section FROM (SELECT *, trim('fn ' || md5(text) || md5(path) || repeat('x', line_idx)) AS s FROM ln)")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of hunks as findings show them."""
    heading = F.concat(F.lit(" fn "), F.md5("text"), F.md5("path"), F.repeat(F.lit("x"), F.col("line_idx")), F.lit("\t"))
    return _lines(spark, sf_dir).select(*KEY, T.cleaned_section(heading).alias("section"))


def _reported(spark: SparkSession, sf_dir: str) -> Analysis:
    rows = _kept(spark, sf_dir)
    stats = stats_of(corpus.files(spark, sf_dir), len(RULES))
    return Analysis(rows, stats, scoring.category_scores(rows), scoring.patch_scores(rows, stats), rows.limit(0))


_ORDERED = f"""od AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY suppressed, {SEVERITY_RANK.format('severity')} DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, file, line, rule_id) AS k FROM sc),
o1 AS (SELECT *, min(k) OVER (PARTITION BY patch_id, rule_id) AS first FROM od), o2 AS (SELECT *, dense_rank() OVER (PARTITION BY patch_id ORDER BY first) - 1 AS rule_index FROM o1)"""


@query(
    f"{ALL}, {_ORDERED}, rs AS (SELECT patch_id, count(*) AS n_results, string_agg(rule_index, ',' ORDER BY k) AS rule_indexes, string_agg(CASE WHEN {SEVERITY_RANK.format('severity')} >= 4 THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END, ',' ORDER BY k) AS levels, "
    "string_agg(file || ':' || CASE WHEN line > 0 THEN line::VARCHAR ELSE '' END, ',' ORDER BY k) AS places, string_agg(fingerprint, ',' ORDER BY k) AS prints, count(*) FILTER (suppressed) AS n_suppressed FROM o2 GROUP BY patch_id), "
    "ru AS (SELECT patch_id, string_agg(rule_id, ',' ORDER BY rule_index) AS rules FROM (SELECT DISTINCT patch_id, rule_id, rule_index FROM o2) GROUP BY patch_id) "
    "SELECT f.patch_id, coalesce(n_results, 0) AS n_results, coalesce(rules, '') AS rules, coalesce(rule_indexes, '') AS rule_indexes, coalesce(levels, '') AS levels, coalesce(places, '') AS places, coalesce(prints, '') AS prints, coalesce(n_suppressed, 0) AS n_suppressed "
    "FROM (SELECT DISTINCT patch_id FROM fl) f LEFT JOIN rs USING (patch_id) LEFT JOIN ru USING (patch_id)"
)
def sarif_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SARIF log for each patch, written by bucket, and what a reader finds in it."""
    from .reports import sarif_logs, write_by_bucket

    a, at = _reported(spark, sf_dir), scratch(spark, "sarif")
    write_by_bucket(sarif_logs(a.findings, a.stats), at)
    place = "struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>"
    result = f"struct<ruleId: string, ruleIndex: int, level: string, locations: array<{place}>, partialFingerprints: map<string, string>, suppressions: array<struct<kind: string>>>"
    shape = f"runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<{result}>>>"
    run = F.from_json("log", shape)["runs"][0]
    rows = spark.read.parquet(at).select("patch_id", run["results"].alias("r"), run["tool"]["driver"]["rules"].alias("u"))
    joined = lambda f, c="r": F.array_join(F.transform(c, f), ",")
    spot = lambda x: F.concat(x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], F.lit(":"), F.coalesce(x["locations"][0]["physicalLocation"]["region"]["startLine"].cast("string"), F.lit("")))
    return rows.select(
        "patch_id", F.size("r").cast("long").alias("n_results"), joined(lambda x: x["id"], "u").alias("rules"), joined(lambda x: x["ruleIndex"].cast("string")).alias("rule_indexes"), joined(lambda x: x["level"]).alias("levels"),
        joined(spot).alias("places"), joined(lambda x: F.map_values(x["partialFingerprints"])[0]).alias("prints"), F.size(F.filter("r", lambda x: x["suppressions"].isNotNull())).cast("long").alias("n_suppressed"),
    )


@query(
    f"{ALL}, {_TOTALS}, cs AS (SELECT patch_id, category, round(sum(score), 1) AS score, count(*) AS n FROM sc WHERE NOT suppressed GROUP BY ALL), cn AS (SELECT patch_id, count(*) AS n_categories FROM cs GROUP BY patch_id), "
    "hs AS (SELECT patch_id, count(*) AS n FROM sc WHERE suppressed GROUP BY patch_id) "
    f"SELECT ps.patch_id, printf('%.0f', {_R1.format('exact')}) AS risk, ps.n AS questions, coalesce(n_categories, 0) AS categories, coalesce(hs.n, 0) AS ignored, files AS files_changed, "
    f"'score=' || printf('%.1f', {_R1.format('exact')}) AS first_line FROM ps LEFT JOIN cn USING (patch_id) LEFT JOIN hs USING (patch_id)"
)
def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review comment and the lines for CI of each patch, and what they say."""
    from .reports import texts

    said = texts(_reported(spark, sf_dir), ("markdown", "ci"))
    n = lambda p: F.coalesce(F.regexp_extract("markdown", p, 1).try_cast("long"), F.lit(0))
    count = lambda p: F.regexp_count("markdown", F.lit(p)).cast("long")
    return said.select(
        "patch_id", F.regexp_extract("markdown", r"risk \*\*(\d+) / 100", 1).alias("risk"), count(r"(?m)^- \[ \] ").alias("questions"), count(r"(?m)^\| [^|]+ \| `[█·]+`").alias("categories"),
        n(r"<summary>Suppressed: (\d+),").alias("ignored"), n(r"lines in (\d+) changed").alias("files_changed"), F.substring_index("ci", "\n", 1).alias("first_line"),
    )


@query(
    f"{ALL}, e1 AS (SELECT fingerprint, min((path, rule_id)) AS k FROM dd GROUP BY fingerprint) SELECT fingerprint, k[2] AS rule, k[1] AS file, "
    "CASE WHEN regexp_matches(fingerprint, '^[08]') THEN '2024-01-01' ELSE '2024-01-02' END AS added_at, CASE WHEN regexp_matches(fingerprint, '^[08]') THEN 1 ELSE 2 END AS version FROM e1 WHERE NOT regexp_matches(fingerprint, '^[19]')"
)
def baseline_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline kept as a table: some findings accepted, then all, then some removed."""
    table, rows = BaselineTable(spark, scratch(spark, "baseline")), cut(findings.first_only(_hits(spark, sf_dir)))
    entry = lambda df, day: df.select(F.lit("").alias("repo"), "fingerprint", F.col("rule_id").alias("rule"), F.col("path").alias("file"), F.lit("").alias("reason"), F.lit(day).alias("added_at"))
    table.add(entry(rows.where(F.col("fingerprint").rlike("^[08]")), "2024-01-01"))
    table.add(entry(rows, "2024-01-02"))
    table.remove(rows.where(F.col("fingerprint").rlike("^[19]")).select(F.lit("").alias("repo"), "fingerprint"))
    return table.entries().select("fingerprint", "rule", "file", "added_at", "version")


#: A patch an hour, in repositories named by source; a finding is known by its rule, repository and match.
_EPOCH = 1704067200
_QUIET = 6
_MET_AT = f"ev AS (SELECT split_part(path, '/', 1) AS repo, rule_id, {_FINGERPRINT.replace('text', 'match').replace('path', "split_part(path, '/', 1)")} AS fingerprint, patch_id AS hour FROM hits)"


def _met(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.substring_index("path", "/", 1)
    return _hits(spark, sf_dir).select(repo.alias("repo"), "rule_id", T.fingerprint(F.col("rule_id"), repo, F.col("match")).alias("fingerprint"), F.timestamp_seconds(F.col("patch_id") * 3600 + _EPOCH).alias("at"), F.col("patch_id").alias("hour"))


@query(f"{ALL}, {_MET_AT}, gp AS (SELECT DISTINCT repo, fingerprint, hour FROM ev), lg AS (SELECT *, lag(hour) OVER (PARTITION BY repo, fingerprint ORDER BY hour) AS before FROM gp) SELECT repo, fingerprint, hour::BIGINT AS hour FROM lg WHERE before IS NULL OR hour - before > {_QUIET}")
def findings_told_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings arrive in three slices of time, the stream starts again for each, and each finding is told where it opens."""
    from ..streaming.stateful import told_once

    at, rows = scratch(spark, "told"), cut(_met(spark, sf_dir).drop("rule_id"))
    most = rows.agg(F.max("hour")).collect()[0][0] or 0
    schema = rows.drop("hour").schema
    for k in range(3):
        slice_ = rows.where((F.col("hour") * 3 >= k * (most + 1)) & (F.col("hour") * 3 < (k + 1) * (most + 1)))
        slice_.drop("hour").write.mode("append").parquet(f"{at}/in")
        told = told_once(spark.readStream.schema(schema).parquet(f"{at}/in"), _QUIET * 3600)
        told.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    opened = spark.read.parquet(f"{at}/out").where("event = 'opened'")
    return opened.select("repo", "fingerprint", F.floor((F.unix_timestamp("at") - _EPOCH) / 3600).alias("hour"))


@query(
    f"{ALL}, {_MET_AT}, ss AS (SELECT repo || ':' || rule_id AS repo, hour, count(*) AS n FROM ev GROUP BY ALL), lg AS (SELECT *, hour - lag(hour) OVER (PARTITION BY repo ORDER BY hour) AS gap FROM ss), gr AS (SELECT *, sum((coalesce(gap, 0) > 2.5)::INT) OVER (PARTITION BY repo ORDER BY hour ROWS UNBOUNDED PRECEDING) AS g FROM lg) "
    "SELECT repo, min(hour)::BIGINT AS begun, max(hour)::BIGINT AS last, sum(n)::BIGINT AS findings FROM gr GROUP BY repo, g"
)
def finding_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of findings of one rule in one repository."""
    from ..streaming.stateful import sessions

    rows = sessions(_met(spark, sf_dir).select(F.concat("repo", F.lit(":"), "rule_id").alias("repo"), "at"), "150 minutes")
    hour = lambda c, less=0: F.floor((F.unix_timestamp(c) - _EPOCH - less) / 3600)
    return rows.select("repo", hour("begun").alias("begun"), hour("ended", 9000).alias("last"), "findings")


@query(
    f"{ALL}, {_TOTALS} SELECT sc.patch_id, category, count(*) AS n, max(score) AS worst, any_value({_R1.format('ps.exact')}) AS total, any_value(ps.files) AS files_changed FROM sc JOIN ps USING (patch_id) WHERE NOT suppressed GROUP BY sc.patch_id, category"
)
def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis asked in SQL, through its views."""
    _reported(spark, sf_dir).views()
    return spark.sql(
        "SELECT f.patch_id, f.category, count(*) AS n, max(f.score) AS worst, any_value(s.total) AS total, any_value(CAST(t.files_changed AS BIGINT)) AS files_changed "
        "FROM findings f JOIN scores s USING (patch_id) JOIN stats t USING (patch_id) WHERE NOT f.suppressed GROUP BY f.patch_id, f.category"
    )


@query(
    f"{ALL}, d1 AS (SELECT 'day ' || patch_id % 3 AS day, count(DISTINCT path) AS files, count(DISTINCT fingerprint) AS prints, count(*) AS findings, count(*) FILTER (suppressed) AS suppressed FROM dd GROUP BY ALL) "
    "SELECT day, findings, suppressed, true AS files_near, true AS prints_near FROM d1"
)
def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of four batches added up by day; the estimates of distinct files and fingerprints against exact counts."""
    rows = findings.first_only(_hits(spark, sf_dir)).withColumns({"day": F.concat(F.lit("day "), (F.col("patch_id") % 3).cast("string")), "file": F.col("path"), "severity": F.lit("low"), "score": F.lit(1.0)})
    rows = cut(rows.select("day", "file", "fingerprint", "severity", "suppressed", "score"))
    batches = [summaries.summarised(rows.where(F.pmod(F.xxhash64("fingerprint", "file"), F.lit(4)) == k), ("day",)) for k in range(4)]
    every = summaries.told(summaries.merged(batches[0].union(batches[1]).union(batches[2]).union(batches[3]), ("day",)))
    exact = rows.groupBy("day").agg(F.count_distinct("file").alias("f"), F.count_distinct("fingerprint").alias("p"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(2.0), 0.05 * F.col(b))
    return every.join(exact, "day").select("day", "findings", "suppressed", near("files", "f").alias("files_near"), near("fingerprints", "p").alias("prints_near"))


#: Rules of one repository's owners: for all, for an ending, for a folder anywhere, for each source, and for every seventh document its own.
_OWNER_ROWS = "CASE WHEN doc_id % 7 = 0 THEN '@doc' || doc_id WHEN split_part(path, '/', 2) = 'de' THEN '@german' ELSE '@team-' || split_part(path, '/', 1) END"


@query(f"WITH {corpus.SQL} SELECT patch_id, path, {_OWNER_ROWS} AS owners FROM src")
def codeowners_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by a rule for every seventh document and every source, met by joins."""
    files = corpus.files(spark, sf_dir).select(F.lit("").alias("repo"), "patch_id", "path", "file_idx")
    number = F.col("patch_id") * 20 + F.col("file_idx")
    rule = lambda df, order, pattern, name: df.select(F.lit("").alias("repo"), order.cast("long").alias("rule_ord"), pattern.alias("pattern"), F.array(name).alias("owners"))
    source = files.select(F.substring_index("path", "/", 1).alias("s")).distinct()
    wide = spark.createDataFrame([("", 0, "*", ["@everyone"]), ("", 1, "*.py", ["@py"]), ("", 900000, "de/", ["@german"])], "repo string, rule_ord long, pattern string, owners array<string>")
    own = rule(files.where(number % 7 == 0), number + 1000000, F.concat(F.lit("/"), "path"), F.concat(F.lit("@doc"), number.cast("string")))
    rules = wide.unionByName(rule(source, F.lit(10), F.concat(F.lit("/"), "s", F.lit("/")), F.concat(F.lit("@team-"), "s"))).unionByName(own)
    return owners.owners_of_files(files, owners.keyed(rules)).select("patch_id", "path", F.array_join("owners", " ").alias("owners"))


@query(
    f"{ALL}, rp AS (SELECT *, split_part(path, '/', 1) AS repo FROM hits JOIN meta USING (rule_ord)), st AS (SELECT *, length(repo) % 2 = 0 AS strict FROM rp) "
    "SELECT repo, rule_id, CASE WHEN strict AND rule_id = 'corpus.marks' THEN 'critical' WHEN NOT strict AND rule_id = 'corpus.table-row' THEN 'info' ELSE severity END AS severity, count(*) AS n FROM st "
    "WHERE CASE WHEN strict THEN rule_id <> 'corpus.shouting' AND confidence IN ('high', 'medium') ELSE rule_id IN ('corpus.marks', 'corpus.table-row', 'corpus.mail-address') AND rule_id <> 'corpus.mail-address' END GROUP BY ALL"
)
def repository_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all patches once; what counts, and how much, by the settings of each repository."""
    rows = _hits(spark, sf_dir).withColumn("repo", F.substring_index("path", "/", 1))
    meta = settings.compiled(settings.rule_rows(spark, [RULES, []])).select("rule_id", "severity", "confidence")
    strict = F.length("repo") % 2 == 0
    none, level = F.array().cast("array<string>"), lambda k, v: F.create_map(F.lit(k), F.lit(v))
    own = rows.select("repo").distinct().select(
        "repo", F.when(strict, none).otherwise(F.array(*map(F.lit, ("corpus.marks", "corpus.table-row", "corpus.mail-address")))).alias("only"),
        F.when(strict, F.array(F.lit("corpus.shouting"))).otherwise(F.array(F.lit("corpus.mail-address"))).alias("disable"), none.alias("enable"),
        F.when(strict, level("corpus.marks", "critical")).otherwise(level("corpus.table-row", "info")).alias("severity"), F.when(strict, "medium").otherwise("").alias("min_confidence"),
    )
    return settings.settled(rows.join(F.broadcast(meta), "rule_id"), own).groupBy("repo", "rule_id", "severity").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score row per patch, patches without findings included."""
    return patch_score(spark, sf_dir)
