"""Reports of all patches at once say what those of one patch say."""

import json

import pytest
from pyspark.sql import functions as F

from patchloom.plans import corpus, reports
from patchloom.plans.analysis import analyse
from patchloom.sources.config import Config
from patchloom.sources.patches import from_texts
from patchloom.operators.routing import Route, Router
from patchloom.operators.scoring import Gate

LINES = ["+Copyright 2024 Someone, all rights reserved", "+# patchloom:ignore[corpus.*] vetted | <b>", "+write to a.person@mail.example now", "+ALL OF THIS IS <b>SHOUTED</b> & AT EVERYBODY HERE", "+Copyright <b> of all rights reserved", "-an address 10.0.0.1 goes", "+api_token = \"q8Zr2LmX0pTe7Yw4Kd9B\"", "+a | b | c"]


@pytest.fixture(scope="module")
def analysis(spark):
    text = lambda k: "".join(f"diff --git a/d{j}/f.py b/d{j}/f.py\n--- a/d{j}/f.py\n+++ b/d{j}/f.py\n@@ -{j + 1},9 +{j + 1},9 @@ def f_{j}():\n" + "\n".join(LINES[j % 3 : j % 3 + 2 + k]) + "\n" for j in range(k))
    patches = from_texts(spark, {f"p{k}": text(k) for k in range(1, 5)} | {"clean": "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+z\n"})
    router = Router((Route(("@net",), "x", categories=("information-disclosure", "secrets")),), (), ("@all",))
    return analyse(patches, corpus.rules(), Config(router=router, gate=Gate("high", 20)))


def test_sarif_logs(analysis):
    logs = {r["patch_id"]: json.loads(r["log"]) for r in reports.sarif_logs(analysis.findings, analysis.stats).collect()}
    assert set(logs) == {"p1", "p2", "p3", "p4", "clean"} and logs["clean"]["runs"][0]["results"] == []
    for k in ("p2", "p4", "clean"):
        assert logs[k] == json.loads(reports.sarif(reports.collected(analysis, k)))
    assert any("suppressions" in x for x in logs["p4"]["runs"][0]["results"]) and len(logs["p4"]["runs"][0]["tool"]["driver"]["rules"]) > 3


def test_json_holds_no_markup(spark, analysis):
    found = analysis.findings
    said = reports.json_reports(found, analysis.stats, analysis.category_scores, analysis.scores).collect()
    logs = reports.sarif_logs(found, analysis.stats).collect()
    texts = [r["report"] for r in said] + [r["log"] for r in logs] + [reports.sarif(reports.collected(analysis, "p4"))]
    assert not any(c in t for t in texts for c in "<>&") and any("\\u003cb\\u003e" in t for t in texts)
    assert any("<b>" in f["snippet"] for r in said for f in json.loads(r["report"])["findings"] + json.loads(r["report"])["suppressed"])
    odd = spark.createDataFrame([('{"a":"<&>\u2028\u2029é\\\\"}',)], "j string").select(reports.html_safe(F.col("j")).alias("j")).collect()[0]["j"]
    assert odd.isascii() is False and json.loads(odd) == {"a": "<&>\u2028\u2029é\\"} and not set(odd) & set("<>&\u2028\u2029")


def test_texts(analysis):
    rows = {r["patch_id"]: r for r in reports.texts(analysis, ("markdown", "terminal", "ci")).collect()}
    assert len(rows) == 5
    for k in ("p1", "p4", "clean"):
        one = reports.collected(analysis, k)
        assert (rows[k]["markdown"], rows[k]["terminal"], rows[k]["ci"]) == (reports.markdown(one), reports.pretty(one), reports.key_values(one))
    assert "Suppressed:" in rows["p4"]["markdown"] and "Nothing in this change" in rows["clean"]["markdown"]


def test_buckets(spark, analysis, tmp_path):
    at = str(tmp_path / "logs")
    reports.write_by_bucket(reports.sarif_logs(analysis.findings, analysis.stats), at, 4)
    written = spark.read.parquet(at)
    found = reports.read_from_bucket(written, "p3", 4)
    assert [r["patch_id"] for r in found.collect()] == ["p3"] and written.count() == 5
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString()
    assert reports.read_from_bucket(written, "none", 4).count() == 0
