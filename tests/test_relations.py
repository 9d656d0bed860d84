"""Owners, settings and summaries as relations, and constraints of whole files without windows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patchloom.functions import globs
from patchloom.operators import matching, owners, routing, summaries
from patchloom.plans import settings
from patchloom.sources.rules import CONFIDENCES, Near, Rule, RuleSet, default

SEGMENTS = ["src", "docs", "a", "b.c", "de", "x"]


def random_patterns(rng, n):
    out = ["*", "/", "*.py", "docs/", "/src/a", "src/*/x.go", "**/de", "de", "b.c", "b.c/", "/**/x.py", "s?c", "*.", "a/**/x.py", "*c*.go"]
    for _ in range(n):
        parts = [rng.choice([*SEGMENTS, "*", "**", "s*", "?", "x.py", "x.*"]) for _ in range(rng.randint(1, 4))]
        out.append(rng.choice(["", "/"]) + "/".join(parts) + rng.choice(["", "/", ""]))
    return out


def test_keys_are_necessary():
    rng = random.Random(3)
    paths = ["/".join(rng.choices(SEGMENTS, k=rng.randint(0, 3)) + [rng.choice(["x.py", "x.go", "Makefile", "b.c", "de", ".env", "a."])]) for _ in range(300)]
    for p in random_patterns(rng, 400):
        key, regex = owners.key_of(p), re.compile(globs.owners_to_java(p))
        for path in paths:
            if regex.search(path):
                segments = path.split("/")
                keys = {"*", "x:" + path.rpartition(".")[2]} | {"s:" + s for s in segments} | {"p:" + "/".join(segments[: k + 1]) for k in range(len(segments))}
                assert key in keys, (p, path)


def test_owners_as_the_literal_form(spark):
    rng = random.Random(4)
    paths = ["/".join(rng.choices(SEGMENTS, k=rng.randint(0, 3)) + [rng.choice(["x.py", "x.go", "Makefile", "b.c"])]) for _ in range(60)] * 2
    texts = {r: "# who\n\n" + "\n".join(f"{p} {' '.join(rng.choices(['@a', '@b', '@c'], k=rng.randint(0, 2)))}" for p in random_patterns(rng, 25)) + "\n" for r in ("one", "two")}
    files = spark.createDataFrame([(r, k, p) for r in ("one", "two", "none") for k, p in enumerate(paths)] + [("one", 999, None)], "repo string, n int, path string")
    rules = owners.rules_of(spark.createDataFrame([*texts.items(), ("void", None)], "repo string, text string"))
    got = {(r["repo"], r["n"]): r["owners"] for r in owners.owners_of_files(files, rules).collect()}
    assert len(got) == 3 * len(paths) + 1 and got["one", 999] == [] and got["none", 0] == []
    for repo, text in texts.items():
        literal = files.where(F.col("repo") == repo).where("path is not null").select("n", routing.owners_of(F.col("path"), routing.parse_owners(text)).alias("o"))
        assert {r["n"]: r["o"] for r in literal.collect()} == {n: o for (r, n), o in got.items() if r == repo and n != 999}


def test_thousands_of_owner_rules(spark):
    rules = spark.range(5000).select(F.lit("r").alias("repo"), F.col("id").alias("rule_ord"), F.format_string("/dir%d/", F.col("id") % 2500).alias("pattern"), F.array(F.format_string("@t%d", "id")).alias("owners"))
    files = spark.range(2600).select(F.lit("r").alias("repo"), F.format_string("dir%d/sub/f.py", "id").alias("path"), "id")
    got = {r["id"]: r["owners"] for r in owners.owners_of_files(files, owners.keyed(rules)).collect()}
    assert got == {k: [f"@t{k + 2500}"] if k < 2500 else [] for k in range(2600)}


def test_settings_of_two_repositories(spark):
    rules = [Rule("a.one", severity="high", confidence="high"), Rule("a.two", severity="low", confidence="low"), Rule("a.three", severity="info", confidence="medium")]
    hits = spark.createDataFrame([(repo, r.id, r.severity, r.confidence, k) for k, r in enumerate(rules) for repo in ("x", "y", "z", None)], "repo string, rule_id string, severity string, confidence string, n int")
    rows = [("x", ["a.one", "a.two"], ["a.one"], ["a.one"], {"a.two": "critical"}, ""), ("y", [], ["a.three"], None, None, "medium")]
    own = spark.createDataFrame(rows, settings.SETTINGS)
    got = Counter((r["repo"], r["rule_id"], r["severity"]) for r in settings.settled(hits, own).collect())
    plain = Counter((repo, r.id, r.severity) for repo in ("z", None) for r in rules)
    assert got == plain + Counter([("x", "a.one", "high"), ("x", "a.two", "critical"), ("y", "a.one", "high")])
    table = RuleSet(rules, {r.id: r for r in rules})
    for repo, only, disable, enable, severity, least in rows:
        want = {(r.id, r.severity) for r in table.selected(only or (), disable or (), enable or (), severity or {}, least)}
        assert want == {(rule, s) for (r, rule, s) in got if r == repo}
    wrong = spark.createDataFrame([("w", None, None, None, {"no.such": "high", "a.one": "dire"}, "sure")], settings.SETTINGS)
    known = settings.compiled(settings.rule_rows(spark, [rules]))
    assert sorted(r["problem"] for r in settings.broken(wrong, known).collect()) == ["severity override of 'a.one': invalid severity 'dire'", "severity override: no such rule 'no.such'", "unknown confidence 'sure'"]
    assert "sure" not in CONFIDENCES and settings.broken(own, known).count() == 0


def test_packs_replace_rules_in_their_order(spark):
    base, more, last = [Rule("a.x", severity="low", pack="p0"), Rule("a.y", pack="p0")], [Rule("a.x", severity="high", pack="p1")], [Rule("a.x", severity="info", pack="p2")]
    got = {r["rule_id"]: (r["severity"], r["replaces"]) for r in settings.compiled(settings.rule_rows(spark, [base, more, last])).collect()}
    assert got["a.x"] == ("info", ["p0", "p1"]) and got["a.y"][1] == []
    whole = default()
    rows = settings.compiled(settings.rule_rows(spark, [[r] for r in whole.by_id.values()])).collect()
    assert {r["rule_id"]: r["severity"] for r in rows} == {r.id: r.severity for r in whole.by_id.values()}


def test_summaries_merge(spark):
    rows = spark.range(60000).select(
        F.format_string("r%d", F.col("id") % 2).alias("repo"), F.format_string("d%d", F.col("id") % 3).alias("day"), F.format_string("f%d", F.col("id") % 7000).alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"),
        F.when(F.col("id") % 10 == 0, "critical").otherwise("low").alias("severity"), (F.col("id") % 20 == 0).alias("suppressed"), F.col("id").cast("double").alias("score"),
    )
    batches = [summaries.summarised(rows.where(F.pmod(F.xxhash64("fingerprint"), F.lit(4)) == k)) for k in range(4)]
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b)
    exact = {r["repo"]: r for r in rows.groupBy("repo").agg(F.count_distinct("file").alias("files"), F.count_distinct("fingerprint").alias("fingerprints"), F.count("*").alias("n"), F.max("score").alias("worst")).collect()}
    for r in summaries.told(summaries.merged(every, ("repo",))).collect():
        e = exact[r["repo"]]
        assert (r["findings"], r["worst"]) == (e["n"], e["worst"]) and abs(r["files"] - e["files"]) < 0.05 * e["files"] and abs(r["fingerprints"] - e["fingerprints"]) < 0.05 * e["fingerprints"]
    assert {(r["critical"], r["suppressed"]) for r in summaries.merged(every, ("repo",)).where("repo = 'r0'").collect()} == {(3000, 3000)}


LINE = "patch_id string, file_idx int, hunk_idx int, line_idx int, kind string, text string, section string, path string, old_line int, new_line int, anchor_line int"


@pytest.mark.parametrize("side", ["absent", "present"])
def test_file_scope_has_no_window_by_file(spark, side):
    rng = random.Random(6)
    rows = [("p", f, h, k, "added", rng.choice(["hit", "other", "guard here", "x"]) if f else "hit", "guard of section" if f == 5 and h == 1 else "", "a.py", 0, 1, 1) for f in range(9) for h in range(2) for k in range(2)]
    rules = [Rule(f"x.r{k}", on="any", patterns=("hit",), near=Near(scope="file", **{side: (f"guard{' ' * (k % 2)}",)})) for k in range(70)]
    found = matching.line_hits(spark.createDataFrame(rows, LINE), rules)
    guarded = {r[1] for r in rows if "guard" in r[5] or "guard" in r[6]}
    spaced = {r[1] for r in rows if "guard " in r[5] or "guard " in r[6]}
    want = Counter((r[1], r[2], r[3], k) for r in rows if r[5] == "hit" for k in range(70) if (r[1] in (spaced if k % 2 else guarded)) == (side == "present"))
    assert Counter((r["file_idx"], r["hunk_idx"], r["line_idx"], r["rule_ord"]) for r in found.select("file_idx", "hunk_idx", "line_idx", "rule_ord").collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("hunk_idx" in w for w in re.findall(r"Window \[.*", plan))
