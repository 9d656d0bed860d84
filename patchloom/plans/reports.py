"""Reports of all patches at once: JSON and SARIF as columns, Markdown and terminal text rendered a row a patch."""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions import text as T
from ..operators import findings as FN
from ..operators import routing
from ..sources.rules import CATEGORIES, SEVERITIES
from .analysis import Analysis

#: Levels and ranks that readers of SARIF expect.
LEVELS = {"critical": "error", "high": "error", "medium": "warning"}
SECURITY_SEVERITY = {"critical": "9.3", "high": "7.5", "medium": "5.3", "low": "3.1"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
TOOL, PRINT_KEY = "patchloom", "patchloom/v1"
FINDING = [
    "rule_id", "title", "category", "severity", "confidence", "trigger", "file", "line", "old_line", "section", "snippet", "match", "question", "guidance", "cwe", "owasp", "refs", "tags",
    "occurrences", "other_lines", "related_fingerprints", "fingerprint", "score", "suppressed", "suppressed_by", "suppression_reason", "reviewers",
]


#: Characters that JSON texts hold as escapes only, so that they can stand inside HTML and scripts.
_HTML = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def html_safe(text: Column) -> Column:
    """A JSON text whose strings hold no character that means something to HTML; it reads the same."""
    for raw, escape in _HTML.items():
        text = F.replace(text, F.lit(raw), F.lit(escape))
    return text


def ordered(findings: DataFrame) -> DataFrame:
    """With result_order: live before suppressed, each worst first."""
    at = Window.partitionBy("patch_id").orderBy("suppressed", *FN.sort_keys())
    return FN.ranked(findings).withColumn("result_order", F.row_number().over(at))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """The results of SARIF logs as rows: level, message, suppression, rule_index by first appearance."""
    level = F.coalesce(*[F.when(F.col("severity") == s, v) for s, v in LEVELS.items()], F.lit("note"))
    rows = ordered(findings).withColumn("_first", F.min("result_order").over(Window.partitionBy("patch_id", "rule_id")))
    rows = rows.withColumn("rule_index", F.dense_rank().over(Window.partitionBy("patch_id").orderBy("_first")) - 1).drop("_first")
    ask = T.normalised(F.col("question"))
    place = F.when(F.col("section") != "", F.concat(F.lit(" (in "), "section", F.lit(")"))).otherwise("")
    kind = F.when(F.col("suppressed") & (F.col("suppressed_by") == "baseline"), "external").when(F.col("suppressed"), "inSource").otherwise("")
    return rows.withColumns({"level": level, "message": F.concat("title", F.lit(". "), ask, place), "suppression": kind})


def json_reports(findings: DataFrame, stats: DataFrame, categories: DataFrame, scores: DataFrame, meta: dict[str, str] | None = None) -> DataFrame:
    """patch_id, report: the JSON contract of each patch as text; arrays are never null."""
    entry = F.struct(F.col("result_order").alias("o"), F.struct(*[F.col(c).alias("references" if c == "refs" else c) for c in FINDING]).alias("f"))
    listed = lambda live: F.transform(F.sort_array(F.collect_list(F.when(F.col("suppressed") != live, entry))), lambda x: x["f"])
    rows = ordered(findings).groupBy("patch_id").agg(listed(True).alias("findings"), listed(False).alias("ignored"))
    tally = lambda df, key: df.groupBy("patch_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(f"by_{key}"))
    cats = categories.groupBy("patch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("category_order", F.struct("category", "score", "count", "worst").alias("c")))), lambda x: x["c"]).alias("categories"))
    out = scores.select("patch_id", "total", "band", "signals", "blast_radius", "raw", "gate_failed", "gate_reason").join(stats, "patch_id")
    for part in (rows, cats, tally(FN.by_severity(findings), "severity"), tally(FN.by_category(findings), "category"), tally(routing.reviewer_index(findings).select("patch_id", "reviewer", "n"), "reviewer")):
        out = out.join(part, "patch_id", "left")
    none = F.from_json(F.lit("[]"), rows.schema["findings"].dataType)
    found, ignored = F.coalesce("findings", none), F.coalesce("ignored", none)
    said = F.struct(F.lit(TOOL).alias("tool"), F.lit(__version__).alias("version"), *[F.lit(v).alias(k) for k, v in (meta or {}).items()])
    return out.select(
        "patch_id",
        html_safe(F.to_json(F.struct(
            said.alias("meta"),
            F.struct("total", "band", "signals", "blast_radius", "raw", F.coalesce("categories", F.from_json(F.lit("[]"), cats.schema["categories"].dataType)).alias("categories")).alias("score"),
            F.struct(F.col("gate_failed").alias("failed"), F.when(F.col("gate_failed"), F.col("gate_reason")).alias("reason")).alias("gate"),
            F.struct("files_changed", "additions", "deletions", "binary_files", "rules_evaluated", "files_skipped", "languages").alias("stats"),
            F.struct(F.size(found).alias("total"), F.size(ignored).alias("suppressed"), "by_severity", "by_category", F.col("by_reviewer").alias("reviewers")).alias("summary"),
            found.alias("findings"), ignored.alias("suppressed"),
        ))).alias("report"),
    )


def sarif_logs(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """patch_id, log: a SARIF 2.1.0 log as JSON text for every row of ``patches`` (patch_id), with or without findings.

    Rules stand in the order in which results first name them. A log is one row, as large as its patch's findings.
    """
    rows = sarif_rows(findings)
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"), F.when(some("snippet").isNotNull(), F.struct(F.col("snippet").alias("text"))).alias("snippet")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.filter(F.array(place), lambda x: x["physicalLocation"]["artifactLocation"]["uri"] != "").alias("locations"), F.struct(F.col("fingerprint").alias(PRINT_KEY)).alias("partialFingerprints"),
        F.struct("category", "confidence", "trigger", "score", F.when(F.size("reviewers") > 0, F.col("reviewers")).alias("reviewers")).alias("properties"),
        F.when(F.col("suppressed"), F.array(F.struct(F.col("suppression").alias("kind"), F.col("suppression_reason").alias("justification")))).alias("suppressions"),
    )
    words = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    owasp = F.filter(F.transform(words("owasp"), lambda x: F.element_at(F.split(T.normalised(x), " "), 1)), lambda x: x != "")
    text = F.concat(T.trimmed(F.col("question")), F.coalesce(F.concat(F.lit("\n\n"), some("guidance")), F.lit("")))
    severity = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SECURITY_SEVERITY.items()], F.lit("1.0"))
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(T.normalised(F.col("question")).alias("text")).alias("fullDescription"),
        F.struct(text.alias("text"), text.alias("markdown")).alias("help"), F.struct("level").alias("defaultConfiguration"),
        F.struct(severity.alias("security-severity"), F.col("confidence").alias("precision"), F.concat(F.array(F.lit("security"), "category"), words("cwe"), owasp, words("tags")).alias("tags")).alias("properties"),
        F.get(words("refs"), F.lit(0)).alias("helpUri"),
    )
    in_order = lambda key, c: F.transform(F.sort_array(F.collect_list(F.struct(key, c))), lambda x: x[c])
    rules = rows.withColumn("rule", rule).groupBy("patch_id", "rule_id").agg(F.min("rule_index").alias("rule_index"), F.min_by("rule", "result_order").alias("rule"))
    rules = rules.groupBy("patch_id").agg(in_order("rule_index", "rule").alias("rules"))
    results = rows.withColumn("result", result).groupBy("patch_id").agg(in_order("result_order", "result").alias("results"))
    out = patches.select("patch_id").distinct().join(rules, "patch_id", "left").join(results, "patch_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), out.schema[c].dataType)).alias(c)
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(__version__).alias("version"), none("rules"))
    run = F.struct(
        F.struct(driver.alias("driver")).alias("tool"), none("results"), F.array(F.struct(F.lit(True).alias("executionSuccessful"))).alias("invocations"),
        F.struct(F.lit(f"{TOOL}/pull-request").alias("id")).alias("automationDetails"), F.lit("utf16CodeUnits").alias("columnKind"),
    )
    return out.select("patch_id", html_safe(F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs")))).alias("log"))


def gathered(a: Analysis) -> DataFrame:
    """A row for each patch: findings, suppressed, stats, score, categories, reviewers, nested and in order."""
    entry = F.struct("result_order", F.struct(*FINDING).alias("f"))
    listed = lambda live: F.transform(F.sort_array(F.collect_list(F.when(F.col("suppressed") != live, entry))), lambda x: x["f"])
    within = lambda df, order, into: df.groupBy("patch_id").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c not in ("patch_id", order)]))).alias(into))
    whole = lambda df, into: df.select("patch_id", F.struct(*[c for c in df.columns if c not in ("patch_id", "languages")]).alias(into))
    out = whole(a.scores, "score").join(whole(a.stats, "stats"), "patch_id")
    parts = [ordered(a.findings).groupBy("patch_id").agg(listed(True).alias("findings"), listed(False).alias("suppressed")), within(a.category_scores, "category_order", "categories"), within(routing.reviewer_index(a.findings), "reviewer_order", "reviewers")]
    for part in parts:
        out = out.join(part, "patch_id", "left")
    return out


def texts(a: Analysis, kinds: tuple[str, ...] = ("markdown",)) -> DataFrame:
    """patch_id and a text of each of ``kinds`` (markdown, terminal, ci) for every patch, each rendered where its row is."""
    makers = {"markdown": markdown, "terminal": pretty, "ci": key_values}
    chosen = [makers[k] for k in kinds]
    rows = gathered(a)
    kind = rows.schema["patch_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [{c: v if v is not None else [] for c, v in r.items()} for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("patch_id"), *[pa.array([make(r) for r in found], pa.string()) for make in chosen]], ["patch_id", *kinds])

    return rows.mapInArrow(run, ", ".join([f"patch_id {kind}", *[f"{k} string" for k in kinds]]))


def write_by_bucket(reports: DataFrame, folder: str, buckets: int = 64) -> None:
    """Write one row a patch to a folder a bucket, dealt by a hash of patch_id, so a patch is found without reading the rest."""
    bucket = F.pmod(F.xxhash64("patch_id"), F.lit(buckets)).cast("int")
    reports.withColumn("bucket", bucket).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_from_bucket(reports: DataFrame, patch_id, buckets: int = 64) -> DataFrame:
    """The row of one patch of what :func:`write_by_bucket` wrote; only its bucket is read."""
    lit = F.lit(patch_id).cast(reports.schema["patch_id"].dataType)
    number = reports.sparkSession.range(1).select(F.pmod(F.xxhash64(lit), F.lit(buckets)).cast("int")).collect()[0][0]
    return reports.where((F.col("bucket") == number) & (F.col("patch_id") == lit)).drop("bucket")


def collected(a: Analysis, patch_id: str) -> dict[str, Any]:
    """One patch's rows on the driver, for the texts that people read."""
    of = lambda df: df.where(F.col("patch_id") == patch_id)
    rows = [r.asDict(True) for r in ordered(of(a.findings)).orderBy("result_order").collect()]
    one = lambda df: next((r.asDict(True) for r in of(df).collect()), {})
    return {
        "findings": [r for r in rows if not r["suppressed"]], "suppressed": [r for r in rows if r["suppressed"]], "stats": one(a.stats), "score": one(a.scores),
        "categories": [r.asDict() for r in of(a.category_scores).orderBy("category_order").collect()], "reviewers": [r.asDict() for r in of(routing.reviewer_index(a.findings)).orderBy("reviewer_order").collect()],
    }


def one_line(text: str) -> str:
    return " ".join((text or "").split())


def plural(n: int, one: str, many: str = "") -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def bar(value: float, most: float, width: int = 10) -> str:
    full = 0 if most <= 0 else max(0, min(width, int(value / most * width + 0.5)))
    return "█" * full + "·" * (width - full)


def occurrences(f: dict) -> str:
    """How often a folded finding was met, and where else."""
    if f["occurrences"] <= 1:
        return ""
    lines = f["other_lines"]
    more = f["occurrences"] - 1 - len(lines)
    also = f" (also at {', '.join(map(str, lines))}{f' and {more} more' if more else ''})" if lines else ""
    return f"{f['occurrences']} occurrences{also}"


def location(f: dict) -> str:
    return f"{f['file']}:{f['line']}" if f["line"] > 0 else f["file"]


def escaped(text: str) -> str:
    """Text that cannot leave a table cell or become markup."""
    return re.sub(r"[\r\n]", " ", text).replace("|", "\\|").replace("<", "&lt;").replace(">", "&gt;")


def fenced(text: str) -> str:
    return re.sub(r"[\r\n]", " ", text).replace("```", "` ` `")


def sarif(r: dict[str, Any]) -> str:
    """A SARIF 2.1.0 log of one patch."""
    rules: dict[str, dict] = {}
    results = []
    for f in [*r["findings"], *r["suppressed"]]:
        if f["rule_id"] not in rules:
            help_text = f["question"].strip() + (f"\n\n{f['guidance']}" if f["guidance"] else "")
            tags = ["security", f["category"], *(f["cwe"] or []), *(o.split()[0] for o in f["owasp"] or [] if o.split()), *(f["tags"] or [])]
            rules[f["rule_id"]] = {
                "id": f["rule_id"], "name": f["rule_id"], "shortDescription": {"text": f["title"]}, "fullDescription": {"text": one_line(f["question"])}, "help": {"text": help_text, "markdown": help_text},
                "defaultConfiguration": {"level": LEVELS.get(f["severity"], "note")}, "properties": {"security-severity": SECURITY_SEVERITY.get(f["severity"], "1.0"), "precision": f["confidence"], "tags": tags},
            } | ({"helpUri": f["refs"][0]} if f["refs"] else {})
        where: dict[str, Any] = {"physicalLocation": {"artifactLocation": {"uri": f["file"]}}}
        if f["line"] > 0:
            where["physicalLocation"]["region"] = {"startLine": f["line"]} | ({"snippet": {"text": f["snippet"]}} if f["snippet"] else {})
        said = f"{f['title']}. {one_line(f['question'])}" + (f" (in {f['section']})" if f["section"] else "")
        out = {
            "ruleId": f["rule_id"], "ruleIndex": list(rules).index(f["rule_id"]), "level": LEVELS.get(f["severity"], "note"), "message": {"text": said}, "locations": [where] if f["file"] else [],
            "partialFingerprints": {PRINT_KEY: f["fingerprint"]},
            "properties": {"category": f["category"], "confidence": f["confidence"], "trigger": f["trigger"], "score": f["score"]} | ({"reviewers": f["reviewers"]} if f["reviewers"] else {}),
        }
        if f["suppressed"]:
            out["suppressions"] = [{"kind": "external" if f["suppressed_by"] == "baseline" else "inSource", "justification": f["suppression_reason"]}]
        results.append(out)
    driver = {"name": TOOL, "version": __version__, "rules": list(rules.values())}
    run = {"tool": {"driver": driver}, "results": results, "invocations": [{"executionSuccessful": True}], "automationDetails": {"id": f"{TOOL}/pull-request"}, "columnKind": "utf16CodeUnits"}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False).translate({ord(k): v for k, v in _HTML.items()})


def _by_category(r: dict[str, Any]) -> list[tuple[str, list[dict]]]:
    return [(c["category"], [f for f in r["findings"] if f["category"] == c["category"]]) for c in r["categories"]]


def markdown(r: dict[str, Any], mention: bool = True, marker: str = T.MARKER) -> str:
    """A review comment: summary, questions by category, reviewers, suppressions."""
    s, st, live = r["score"], r["stats"], r["findings"]
    badge = lambda level: f"`{level.upper()}`"
    out = [f"<!-- {TOOL}-report -->", f"## {TOOL}: risk **{s['total']:.0f} / 100** · {badge(s['band'])}", ""]
    out += [f"**{plural(len(live), 'finding')}** across {plural(len({f['file'] for f in live}), 'file')} · `+{st['additions']} / -{st['deletions']}` lines in {plural(st['files_changed'], 'changed file')} · {st['rules_evaluated']} rules evaluated", ""]
    if not live:
        out += ["Nothing in this change matched an active rule.", "", "> Rules see what somebody wrote down. This is no statement about the rest.", ""]
    else:
        out += ["| Category | Weight | Findings | Worst |", "| --- | ---: | ---: | --- |"]
        most = r["categories"][0]["score"] if r["categories"] else 0
        out += [f"| {CATEGORIES[c['category']]} | `{bar(c['score'], most)}` {c['score']:.1f} | {c['count']} | {badge(c['worst'])} |" for c in r["categories"]]
        out += ["", f"<sub>{s['signals']:.1f} from findings and {s['blast_radius']:.1f} from the size of the change; {s['raw']:.1f} before saturation.</sub>", "", "### Questions", ""]
        for category, group in _by_category(r):
            opened = " open" if SEVERITIES[group[0]["severity"]] >= SEVERITIES["high"] else ""
            out += [f"<details{opened}>", f"<summary><b>{CATEGORIES[category]}</b>: {plural(len(group), 'finding')}</summary>", ""]
            for f in group:
                out += [f"- [ ] **{escaped(f['title'])}** `{location(f)}` {badge(f['severity'])}", ""]
                if f["snippet"]:
                    sign = {"removed": "- ", "file": "  "}.get(f["trigger"], "+ ")
                    out += ["  ```diff", f"  {sign}{fenced(f['snippet'])}", "  ```", ""]
                out += [f"  **Ask:** {one_line(f['question'])}", ""]
                if f["guidance"]:
                    out += ["  <details><summary>How to answer</summary>", "", *(f"  {x}" for x in f["guidance"].split("\n")), "", "  </details>", ""]
                notes = [f"rule `{f['rule_id']}`", f"{f['confidence']} confidence", occurrences(f), f"removed from old line {f['old_line']}" if f["trigger"] == "removed" and f["old_line"] > 0 else ""]
                notes += [f"in `{escaped(f['section'])}`" if f["section"] else "", *(f["cwe"] or []), *(f["owasp"] or []), " ".join(f["reviewers"]) if mention and f["reviewers"] else ""]
                out += [f"  <sub>{' · '.join(n for n in notes if n)}</sub>", ""]
            out += ["</details>", ""]
        if r["reviewers"]:
            out += ["### Reviewers", "", "| Reviewer | Findings | Why |", "| --- | ---: | --- |"]
            out += [f"| {x['reviewer']} | {x['n']} | {', '.join(CATEGORIES[c] for c in x['categories'])} |" for x in r["reviewers"]] + [""]
    if r["suppressed"]:
        silent = sum(not f["suppression_reason"].strip() for f in r["suppressed"])
        out += ["<details>", f"<summary>Suppressed: {len(r['suppressed'])}, not in the score</summary>", "", "| Finding | Location | By | Reason |", "| --- | --- | --- | --- |"]
        out += [f"| `{f['rule_id']}` | `{location(f)}` | {f['suppressed_by']} | {escaped(f['suppression_reason'].strip()) or '_no reason given_'} |" for f in r["suppressed"]] + [""]
        out += [f"> {plural(silent, 'suppression gives', 'suppressions give')} no reason.", ""] if silent else []
        out += ["</details>", ""]
    if s["gate_failed"]:
        out += [f"> **Gate failed:** {s['gate_reason']}", ""]
    return "\n".join([*out, f"<sub>A finding is suppressed where it stands with `// {marker}[rule.id] reason`. {TOOL} {__version__}</sub>", ""])


_ANSI = {"critical": "1;31", "high": "31", "medium": "33", "low": "36", "info": "2", "minimal": "32"}


def wrapped(text: str, width: int, indent: str = "") -> list[str]:
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return [line if not k else indent + line for k, line in enumerate(lines)]


def pretty(r: dict[str, Any], color: bool = False, width: int = 96) -> str:
    """The report for a terminal."""
    s, st = r["score"], r["stats"]
    paint = lambda text, level: f"\x1b[{_ANSI.get(level, '0')}m{text}\x1b[0m" if color else text
    out = [f"{TOOL} {__version__}", "", f"  risk {paint(f'{s["total"]:.1f} / 100  {s["band"].upper()}', s['band'])}"]
    out += [f"  {plural(st['files_changed'], 'file')}, +{st['additions']} -{st['deletions']}, {st['rules_evaluated']} rules"]
    counts = [f"{sum(f['severity'] == k for f in r['findings'])} {k}" for k in SEVERITIES if any(f["severity"] == k for f in r["findings"])]
    out += [f"  {', '.join(counts) or 'no findings'}", ""]
    most = r["categories"][0]["score"] if r["categories"] else 0
    out += [f"  {CATEGORIES[c['category']]:<24} {bar(c['score'], most, 20)} {c['score']:>6.1f}  {c['count']}" for c in r["categories"]] + [""] * bool(r["categories"])
    files: dict[str, list[dict]] = {}
    for f in r["findings"]:
        files.setdefault(f["file"], []).append(f)
    for name, group in sorted(files.items(), key=lambda kv: (-max(SEVERITIES[f["severity"]] for f in kv[1]), kv[0])):
        out.append(name)
        for f in group:
            out.append(f"  {paint(f['severity'].upper(), f['severity']):<10} {f['line'] or '-'}  {f['title']}  [{f['rule_id']}]")
            out += [f"      {f['snippet']}"] * bool(f["snippet"]) + ["      " + x for x in wrapped(one_line(f["question"]), width)]
            out += [f"      {x}" for x in (occurrences(f), " ".join(f["reviewers"])) if x]
        out.append("")
    out += [f"  {x['reviewer']}: {plural(x['n'], 'finding')}" for x in r["reviewers"]] + [""] * bool(r["reviewers"])
    out += [f"  suppressed {f['rule_id']} {location(f)} ({f['suppressed_by']}): {f['suppression_reason'] or 'no reason given'}" for f in r["suppressed"]]
    out.append(paint(f"FAIL {s['gate_reason']}", "high") if s["gate_failed"] else paint("PASS", "minimal"))
    return "\n".join(out) + "\n"


def key_values(r: dict[str, Any]) -> str:
    """The lines that CI reads: score, band, counts and the verdict."""
    n = lambda level: sum(f["severity"] == level for f in r["findings"])
    pairs = {"score": f"{r['score']['total']:.1f}", "band": r["score"]["band"], "findings": len(r["findings"]), "suppressed": len(r["suppressed"]), "critical": n("critical"), "high": n("high"), "medium": n("medium"), "low": n("low"), "failed": str(r["score"]["gate_failed"]).lower()}
    return "".join(f"{k}={v}\n" for k, v in pairs.items())
