import dataclasses
import json

import pytest

from patchloom.operators import routing, scoring
from patchloom.plans import reports
from patchloom.plans.analysis import analyse
from patchloom.sources import baseline as B
from patchloom.sources import rules as R
from patchloom.sources.config import Config
from patchloom.sources.patches import from_texts

PACK = """
rules:
  - {id: t.guard-removed, title: guard removed, category: elevation-of-privilege, severity: critical, confidence: high, on: removed, patterns: ['@guard'], question: who?}
  - {id: t.route, title: route, category: spoofing, severity: high, confidence: low, on: added, patterns: ['route\\('], near: {window: 2, absent: ['@guard']}, question: who?}
  - {id: t.hash, title: hash, category: tampering, severity: high, confidence: high, on: added, patterns: ['md5'], exclude_patterns: ['etag'], question: why?}
  - {id: t.pass, title: pass, category: secrets, severity: high, confidence: medium, on: added, redact: true, patterns: ['hunter2secret'], question: live?}
  - {id: t.ci, title: ci, category: supply-chain, severity: medium, confidence: high, on: file, paths: ['ci/**'], file_events: [created], question: what?}
"""
PATCH = """diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -4,6 +4,9 @@ class A:
 x
-@guard
+route(1)
+@guard
+md5(a)
+md5(b)
+md5(c) # etag
+md5(d) # patchloom:ignore[t.hash] not security
+pw = "hunter2secret"
+API_TOKEN = "aB3dE5fG7hJ9kL1mN3pQ"
diff --git a/ci/x.yml b/ci/x.yml
new file mode 100644
--- /dev/null
+++ b/ci/x.yml
@@ -0,0 +1 @@
+a: 1
"""


@pytest.fixture(scope="module")
def ruleset():
    return R.compile_set([R.parse_pack(PACK, "t")])


@pytest.fixture(scope="module")
def found(spark, ruleset):
    router = routing.Router((routing.Route(("@sec", "@sec "), rules=("t.h*",)), routing.Route(("@all",), min_severity="critical")), routing.parse_owners("# c\n* @own\n/ci/ @ci\n"), ("@d",))
    return analyse(from_texts(spark, {"p": PATCH, "q": "diff --git a/z b/z\n@@ -1 +1 @@\n+plain\n"}), ruleset, Config(router=router, gate=scoring.Gate("high")))


def test_findings(found):
    rows = {(r["rule_id"], r["suppressed"]): r for r in found.findings.collect()}
    assert set(rows) == {("t.guard-removed", False), ("t.hash", False), ("t.hash", True), ("t.pass", False), ("t.ci", False), ("secret.high-entropy-string", False)}
    guard, hashed = rows["t.guard-removed", False], rows["t.hash", False]
    assert (guard["line"], guard["old_line"], guard["section"]) == (4, 5, "class A:")
    assert (hashed["line"], hashed["occurrences"], hashed["other_lines"]) == (7, 2, [8]) and len(hashed["related_fingerprints"]) == 1
    assert rows["t.hash", True]["suppression_reason"] == "not security" and "hunter2secret" not in rows["t.pass", False]["snippet"]
    assert rows["secret.high-entropy-string", False]["title"].endswith("`API_TOKEN`") and rows["t.ci", False]["snippet"] == "created ci/x.yml"


def test_routes(found):
    rows = {r["rule_id"]: r["reviewers"] for r in found.findings.where("not suppressed").collect()}
    assert rows["t.hash"] == ["@sec"] and rows["t.guard-removed"] == ["@all"] and rows["t.ci"] == ["@ci"] and rows["t.pass"] == ["@own"]


def test_scores(found):
    rows = {r["patch_id"]: r for r in found.scores.collect()}
    assert rows["q"]["raw"] == 0 and 0 < rows["q"]["total"] < 1 and rows["q"]["band"] == "minimal" and not rows["q"]["gate_failed"]
    assert rows["p"]["raw"] == pytest.approx(52 + 24 + 16.8 + 10 + 10.8) and rows["p"]["gate_reason"] == "1 critical finding (gate: --fail-on high)"


def test_formulas(spark):
    from pyspark.sql import functions as F

    value = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    total = lambda raw, lead: value(scoring.signals(F.lit(raw), F.lit(lead)))
    assert total(40.0, 40.0) == pytest.approx(55.3, abs=0.05) and total(56.0, 7.0) == pytest.approx(49.9, abs=0.05) and total(210.0, 7.0) == pytest.approx(81.1, abs=0.05)
    assert total(489.8, 52.0) == pytest.approx(84.96, abs=0.01) and value(scoring.blast_radius(F.lit(6), F.lit(84))) == pytest.approx(4.38, abs=0.01)
    for x, band in ((75, "critical"), (74.9, "high"), (45, "high"), (20, "medium"), (5, "low"), (4.9, "minimal"), (0, "minimal")):
        assert value(scoring.band(F.lit(float(x)))) == band


def test_reports(found):
    r = reports.collected(found, "p")
    log = json.loads(reports.sarif(r))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == 6 and log["runs"][0]["results"][-1]["suppressions"][0]["kind"] == "inSource"
    md, out = reports.markdown(r), reports.pretty(r)
    assert "guard removed" in md and "hunter2secret" not in md + out and "FAIL" in out and "2 occurrences (also at 8)" in md
    rows = {x["patch_id"]: json.loads(x["report"]) for x in reports.json_reports(found.findings, found.stats, found.category_scores, found.scores).collect()}
    assert rows["q"]["findings"] == [] and rows["p"]["summary"]["total"] == 5 and rows["p"]["summary"]["reviewers"]["@sec"] == 1
    empty = reports.collected(found, "q")
    assert "matched an active rule" in reports.markdown(empty) and "PASS" in reports.pretty(empty) and "failed=false" in reports.key_values(empty)


def test_report_helpers():
    assert reports.bar(5, 10) == "█████·····" and reports.bar(1, 0) == "·" * 10 and reports.escaped("a|<b>\n") == "a\\|&lt;b&gt; " and reports.wrapped("aa bb cc", 5, "  ") == ["aa bb", "  cc"]


def test_baseline_round_trip(spark, ruleset, found, tmp_path):
    path = str(tmp_path / "b.json")
    n = B.write(B.merged(B.empty(spark), found.findings, "", "2024-01-01"), path, "2024-01-01T00:00:00Z")
    assert n == 7
    again = analyse(from_texts(spark, {"p": PATCH}), ruleset, Config(), B.entries(spark, path))
    assert again.findings.where("not suppressed").count() == 0 and {r[0] for r in again.findings.select("suppressed_by").distinct().collect()} == {"baseline"}
    assert B.entries(spark, str(tmp_path / "none.json")).count() == 0


def test_same_rows_for_any_partitioning(spark, ruleset, found):
    want = sorted(map(str, found.findings.drop("reviewers").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = analyse(from_texts(spark, {"q": "diff --git a/z b/z\n@@ -1 +1 @@\n+plain\n", "p": PATCH}), ruleset, Config())
        assert sorted(map(str, got.findings.drop("reviewers").collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_redaction_across_rules(spark):
    pack = PACK + "  - {id: t.any, title: any, category: tampering, severity: low, on: added, patterns: ['pw ='], question: q}\n"
    rs = R.compile_set([R.parse_pack(pack, "t")])
    cfg = Config(entropy=dataclasses.replace(Config().entropy, enabled=False), redact_across_rules=True, only=("t.any", "t.pass"))
    rows = analyse(from_texts(spark, {"p": PATCH}), rs, cfg).findings.collect()
    assert len(rows) == 2 and not any("hunter2secret" in r["snippet"] for r in rows)


def test_two_secrets_of_a_line(spark):
    """Every secret that a redacting rule found on a line is masked in all findings of it, in every report."""
    pack = """
rules:
  - {id: t.a, title: a, category: secrets, severity: high, on: added, redact: true, patterns: ['AAAA1+22+'], question: q}
  - {id: t.b, title: b, category: secrets, severity: high, on: added, redact: true, patterns: ['BBBB3+44+'], question: q}
  - {id: t.c, title: c, category: tampering, severity: low, on: added, patterns: ['k AAAA\\w+'], question: q}
"""
    rs = R.compile_set([R.parse_pack(pack, "t")])
    found = analyse(from_texts(spark, {"p": "diff --git a/x b/x\n@@ -1 +1 @@\n+k AAAA11112222 BBBB33334444\n"}), rs, Config(entropy=dataclasses.replace(Config().entropy, enabled=False)))
    r = reports.collected(found, "p")
    texts = [reports.markdown(r), reports.pretty(r), reports.sarif(r), reports.json_reports(found.findings, found.stats, found.category_scores, found.scores).first()["report"], str(found.findings.collect())]
    assert len(r["findings"]) == 3 and not any("11112222" in t or "33334444" in t for t in texts)


def test_colors_formats_and_fences(found):
    r = reports.collected(found, "p")
    assert "\x1b[" not in reports.pretty(r, False) and "\x1b[" in reports.pretty(r, True)
    assert json.loads(reports.sarif(reports.collected(found, "q")))["runs"][0]["results"] == []


def test_weights(spark):
    w = scoring.Weights({"critical": 50.0}, 2.0, 0, -1, 20.0, {"critical": 90.0})
    row = spark.createDataFrame([("critical", "high", "removed")], "severity string, confidence string, trigger string")
    assert scoring.scored(row, w).first()["score"] == 100 and w.get("saturation") == 70 and w.get("lead_scale") == 38 and w.get("blast_radius_weight") == 20


def test_detectors(spark, ruleset):
    """A function from lines to hits is a rule like any other."""
    from pyspark.sql import functions as F

    from patchloom.operators import detectors

    rule = R.Rule(id="t.long-line", title="long", category="tampering", severity="medium", on="added", patterns=(".",), question="why?")
    longest = lambda lines, cfg: lines.where("kind = 'added' and length(text) > 40").withColumns({"match": F.substring("text", 1, 5), "line": F.col("new_line"), "title_of": F.lit(None).cast("string")})
    detectors.register(detectors.Detector(rule, longest))
    try:
        rows = analyse(from_texts(spark, {"p": PATCH}), ruleset, Config()).findings.where("rule_id = 't.long-line'").collect()
        assert [(r["line"], r["match"], r["title"], r["score"]) for r in rows] == [(10, "md5(d", "long", 7.0)]
        assert analyse(from_texts(spark, {"p": PATCH}), ruleset, Config(disable=("t.long-line",))).findings.where("rule_id = 't.long-line'").count() == 0
    finally:
        detectors.unregister("t.long-line")


def test_sample_patch(spark):
    """A change with a hole of every kind: what the shipped rules say of it, and its score."""
    patch = """diff --git a/api/orders.py b/api/orders.py
--- a/api/orders.py
+++ b/api/orders.py
@@ -1,4 +1,6 @@ class Orders:
 import flask
-@login_required
+DEFAULT_PASSWORD = "changeme9"
+subprocess.run(cmd, shell=True)
+x = pickle.loads(body)
 def get(): pass
diff --git a/infra/a.tf b/infra/a.tf
--- a/infra/a.tf
+++ b/infra/a.tf
@@ -1 +1 @@
-cidr_blocks = ["10.0.0.0/8"]
+cidr_blocks = ["0.0.0.0/0"]
"""
    a = analyse(from_texts(spark, {"p": patch}), R.default(), Config())
    got = {r["rule_id"]: r["line"] for r in a.findings.collect()}
    assert got == {
        "control.authz-annotation-removed": 1, "authn.default-or-hardcoded-credentials": 2, "injection.os-command": 3, "injection.unsafe-deserialization": 4, "iac.network-open-to-world": 1,
    }
    assert a.scores.first()["band"] == "critical" and a.scores.first()["total"] > 80


def test_every_rule_finds_its_lines(spark):
    """Each rule of the packs finds the lines written for it and passes over their neighbours."""
    from patchloom.operators import matching
    from patchloom.plans import catalogue

    rules = R.default().rules
    hits = {(r["file_idx"], rules[r["rule_ord"]].id) for r in matching.line_hits(catalogue.lines(spark, rules), rules).select("file_idx", "rule_ord").collect()}
    wrong = []
    order = {}
    for rid, (_, yes, no) in catalogue.CASES.items():
        for k in range(len(yes) + len(no)):
            order[len(order)] = (rid, k < len(yes), [*yes, *no][k])
    wrong = [x for n, x in order.items() if ((n, x[0]) in hits) != x[1]]
    assert not wrong
    line_rules = {r.id for r in rules if r.trigger != "file"}
    assert line_rules - set(catalogue.CASES) == {"secret.cloud-provider-credential", "secret.service-token"}
