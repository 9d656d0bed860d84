"""Rules against lines: one projection per line of literal conditions, so patterns compile once and a line that
matches nothing leaves the plan at once. Patterns are tried only where a literal they cannot match without occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs, literals, patterns
from ..functions import text as T
from ..functions.languages import language
from ..sources.rules import Rule

HUNK = ["patch_id", "file_idx", "hunk_idx"]


def like_any(text: Column, found: tuple[str, ...]) -> Column:
    """Whether one of the patterns matches: a single pattern of alternatives, each with flags of its own."""
    if not found:
        return F.lit(False)
    return text.rlike("(?d)" + "|".join(f"(?:{patterns.to_java(p)})" for p in found))


def path_applies(rule: Rule, path: Column, lang: Column) -> Column:
    """Excluded paths first, then languages, then paths; no paths are all paths."""
    ok = ~globs.any_of(path, list(rule.exclude_paths)) if rule.exclude_paths else F.lit(True)
    if rule.languages:
        ok = ok & lang.isin(list(rule.languages))
    return ok & globs.any_of(path, list(rule.paths)) if rule.paths else ok


def triggered(rule: Rule, kind: Column) -> Column:
    kinds = {"added": ["added"], "removed": ["removed"], "any": ["added", "removed"]}
    return kind.isin(kinds.get(rule.trigger, []))


def first_match(text: Column, found: tuple[str, ...]) -> Column:
    """The first pattern's leftmost match; the whole line for an empty match; null for none."""

    def one(p: str) -> Column:
        java = patterns.to_java(p)
        match = F.nullif(F.regexp_extract(text, java, 0), F.lit(""))
        return match if patterns.never_empty(p) else F.coalesce(match, F.when(text.rlike(java), text))

    return F.coalesce(*map(one, found))


def _near(lines: DataFrame, rules: list[tuple[int, Rule]]) -> tuple[DataFrame, dict[int, Column]]:
    """``lines`` (with ``hits``) and a flag for each near constraint within a hunk, and the condition of each such rule.

    The constraint's patterns run in those hunks only in which the rule's own patterns hit a line.
    """
    checks: dict[int, Column] = {}
    wanted: dict[str, Column] = {}
    flags: dict[str, Column] = {}
    hunk = Window.partitionBy(*HUNK)
    for k, r in rules:
        if not r.near or r.near.scope == "file":
            continue
        wanted[f"near_{k}"] = F.max(F.array_contains(F.transform("hits", lambda x: x["rule_ord"]), k)).over(hunk)
        frame = hunk.orderBy("line_idx").rowsBetween(-r.near.window, r.near.window)
        ok = F.lit(True)
        for side, found in (("absent", r.near.absent), ("present", r.near.present)):
            if not found:
                continue
            section = F.coalesce((F.col("section") != "") & like_any(F.col("section"), found), F.lit(False))
            hit = F.coalesce(F.max(F.when(F.col(f"near_{k}"), like_any(F.col("text"), found))).over(frame), F.lit(False))
            flags[f"near_{k}_{side}"] = hit | (F.col(f"near_{k}") & section)
            ok = ok & (~F.col(f"near_{k}_{side}") if side == "absent" else F.col(f"near_{k}_{side}"))
        checks[k] = ok
    return (lines.withColumns(wanted).withColumns(flags) if flags else lines), checks


#: Near constraints of one set of bits.
_BITS = 62


def _met_in_files(lines: DataFrame, rules: list[tuple[int, Rule]]) -> tuple[DataFrame | None, dict[int, Column]]:
    """patch_id, file_idx and sets of bits: which near constraints of a whole file some line or section of it meets; and
    the condition of each rule that has one. Bits are or-ed before the shuffle, so no task holds a file's lines.
    """
    tests = [(k, side, found) for k, r in rules if r.near and r.near.scope == "file" for side, found in (("absent", r.near.absent), ("present", r.near.present)) if found]
    if not tests:
        return None, {}
    sets = {n: got for n, (_, _, found) in enumerate(tests) if (got := literals.of_any(found))}
    rows = lines.select("patch_id", "file_idx", "text", "section", F.explode(F.array(literals.searchable(F.col("text")))).alias("_folded"))
    rows = rows.withColumn("_may", literals.candidates(F.col("_folded"), sets))

    def meets(n: int) -> Column:
        here = like_any(F.col("text"), tests[n][2])
        here = F.array_contains("_may", n) & here if n in sets else here
        return F.coalesce(here, F.lit(False)) | F.coalesce((F.col("section") != "") & like_any(F.col("section"), tests[n][2]), F.lit(False))

    words = range(0, len(tests), _BITS)
    mask = lambda w: sum((F.when(meets(n), F.lit(1 << (n - w))).otherwise(F.lit(0)).cast("long") for n in range(w, min(w + _BITS, len(tests)))), F.lit(0).cast("long"))
    bits = rows.groupBy("patch_id", "file_idx").agg(*[F.bit_or(mask(w)).alias(f"near_bits_{w}") for w in words])
    checks: dict[int, Column] = {}
    for n, (k, side, _) in enumerate(tests):
        w = n - n % _BITS
        met = F.col(f"near_bits_{w}").bitwiseAND(F.lit(1 << (n - w)).cast("long")) != 0
        checks[k] = checks.get(k, F.lit(True)) & (~met if side == "absent" else met)
    return bits, checks


def line_hits(lines: DataFrame, rules: list[Rule], longest: int = 0) -> DataFrame:
    """A row for each rule and line that matches: the line's columns, prev_text, lang, rule_ord, match.

    ``rules`` in order give rule_ord; file rules are not lines' business. ``lines`` needs patch_id, file_idx,
    hunk_idx, line_idx, kind, text, section and path, and no lines of binary files. With ``longest``, patterns that a
    backtracking matcher may never finish are not tried on lines of more characters.
    """
    wanted = [(k, r) for k, r in enumerate(rules) if r.trigger != "file"]
    prev = F.lag("text").over(Window.partitionBy(*HUNK).orderBy("line_idx"))
    if not wanted:
        return lines.withColumns({"prev_text": prev, "lang": F.lit(""), "rule_ord": F.lit(0), "match": F.lit("")}).where("false")
    blank = ~F.col("text").rlike(r"[^\p{IsWhite_Space}]")
    source, sets = lines, {k: found for k, r in wanted if (found := literals.of_any(r.patterns))}
    # Behind a generator, so that the text is folded once and not in every condition.
    lines = lines.select("*", prev.alias("prev_text"), F.explode(F.array(literals.searchable(F.col("text")))).alias("_folded"))
    lines = lines.withColumn("_may", F.when(F.col("kind") != "context", literals.candidates(F.col("_folded"), sets))).drop("_folded")

    def match(k: int, r: Rule) -> Column:
        ok = triggered(r, F.col("kind"))
        if k in sets:
            ok = ok & F.array_contains("_may", k)
        if longest and any(map(patterns.nested_repetition, r.patterns)):
            ok = ok & (F.length("text") <= longest)
        return F.when(ok, first_match(F.col("text"), r.patterns))

    first = F.array(*[F.struct(F.lit(k).alias("rule_ord"), match(k, r).alias("match")) for k, r in wanted])
    lines = lines.withColumn("hits", F.when(~blank, F.filter(first, lambda x: x["match"].isNotNull()))).drop("_may")
    bits, of_file = _met_in_files(source, wanted)
    lines, near = _near(lines, wanted)
    near |= of_file
    flagged = [f for f in [*lines.columns, *(bits.columns if bits else [])] if f.startswith("near_")]
    lines = lines.where(F.size("hits") > 0)
    found = (lines.join(bits, ["patch_id", "file_idx"]) if bits else lines).withColumn("hit", F.explode("hits")).withColumn("lang", language(F.col("path")))
    # What is left are few rows: each is held against the rest of its own rule only.
    case = None
    for k, r in wanted:
        ok = path_applies(r, F.col("path"), F.col("lang"))
        if r.exclude_patterns:
            ok = ok & ~like_any(F.col("text"), r.exclude_patterns)
        if k in near:
            ok = ok & near[k]
        case = F.when(F.col("hit.rule_ord") == k, ok) if case is None else case.when(F.col("hit.rule_ord") == k, ok)
    return found.where(case).select("*", F.col("hit.rule_ord").alias("rule_ord"), F.col("hit.match").alias("match")).drop("hit", "hits", *flagged)


def file_hits(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each file rule and file that it applies to: the file's columns and rule_ord."""
    files = files.withColumn("lang", language(F.col("path")))
    tests = []
    for k, r in enumerate(rules):
        if r.trigger == "file":
            ok = path_applies(r, F.col("path"), F.col("lang"))
            ok = ok & F.col("status").isin(list(r.file_events)) if r.file_events else ok
            tests.append(F.when(ok, F.lit(k)))
    if not tests:
        return files.withColumn("rule_ord", F.lit(0)).where("false")
    return files.withColumn("rule_ord", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))


def noted(hits: DataFrame, rule_id: Column, marker: str = T.MARKER) -> DataFrame:
    """``hits`` with suppressed, suppressed_by, suppression_reason by notes on the line or the one above it."""
    rows = hits.withColumns({"_here": T.suppression(F.col("text"), marker), "_above": T.suppression(F.coalesce("prev_text", F.lit("")), marker)})
    here, above = T.suppresses(F.col("_here"), rule_id), T.suppresses(F.col("_above"), rule_id)
    return rows.withColumns({
        "suppressed": here | above, "suppressed_by": F.when(here | above, "inline").otherwise(""),
        "suppression_reason": F.when(here, F.col("_here.reason")).when(above, F.col("_above.reason")).otherwise(""),
    }).drop("_here", "_above")
