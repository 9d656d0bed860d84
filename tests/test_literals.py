"""Literals that patterns need: every match has one, and rules find the same with and without them."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchloom.functions import literals as L
from patchloom.operators import matching
from patchloom.plans import catalogue
from patchloom.sources.rules import Rule, default

RULES = default().rules


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"(?i)\bos\.(system|popen)\(", {"os.system(", "os.popen("}), (r"eval\s*\(", {"eval"}), (r"a|bc", set()), (r"(foo|bar)?baz", {"foobaz", "barbaz", "baz"}), (r"x*", set()), (r"[\w.]+@[\w]+", {"@"}),
        (r"colou?r: [ab]", {"color: a", "color: b", "colour: a", "colour: b"}), (r"\p{Lu}key[[:digit:]]", {"key"}), (r"(ab){2}c+", {"abab"}), (r"é+abc", {"abc"}), (r"\Qa.b\E", set()), (r"^\s*$", set()), (r"K[i-k]t\x{41}", {"kit", "kjt", "kkt"}),
    ],
)
def test_of_pattern(pattern, want):
    got = L.of_pattern(pattern)
    assert got == frozenset(w for w in want if not any(v != w and v in w for v in want))


NODE = st.recursive(
    st.sampled_from(["a", "b", "K", "s", "ab", "[ab]", r"\w", ".", "é", r"\d", "^", r"\b", "[^a]", "!"]),
    lambda n: st.one_of(
        st.lists(n, min_size=1, max_size=3).map("".join), st.lists(n, min_size=2, max_size=3).map(lambda x: "(" + "|".join(x) + ")"),
        st.tuples(n, st.sampled_from(["*", "+", "?", "{2}", "{0,2}"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
    ),
    max_leaves=8,
)


@settings(max_examples=600, deadline=None)
@given(NODE, st.text("abKks!é1 ſKı", max_size=12))
def test_every_match_holds_one(pattern, text):
    found = L.of_any((pattern,))
    if found and re.search(pattern, text, re.IGNORECASE):
        assert any(w in L.folded(text) for w in found)


def test_most_rules_have_literals():
    line_rules = [r for r in RULES if r.trigger != "file"]
    assert sum(bool(L.of_any(r.patterns)) for r in line_rules) >= len(line_rules) - 4
    for _, _, _, text, rid in catalogue.cases(RULES):
        r = next((r for r in RULES if r.id == rid), None)
        if r and (found := L.of_any(r.patterns)):
            assert any(w in L.folded(text) for w in found), (rid, text)


def test_candidates_by_either_way(spark, monkeypatch):
    texts = ["", "none", "has ABCD", "ſtart İd", "abcd xyz", None, "K1 und xyz"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    sets = {3: frozenset({"abcd", "start"}), 5: frozenset({"xyz"}), 9: frozenset({"k1", "id"})}
    want = {0: [], 1: [], 2: [3], 3: [3, 9], 4: [3, 5], 5: [], 6: [5, 9]}
    for few in (32, 0):
        monkeypatch.setattr(L, "FEW", few)
        got = rows.select("k", F.sort_array(L.candidates(L.searchable(F.col("text")), sets)).alias("c")).collect()
        assert {r["k"]: r["c"] or [] for r in got} == want
    assert all(r["c"] == [] for r in rows.select(L.candidates(F.col("text"), {}).alias("c")).collect())


def test_rules_find_the_same(spark, monkeypatch):
    lines = catalogue.lines(spark, RULES)
    found = lambda: sorted(map(tuple, matching.line_hits(lines, RULES).select("file_idx", "rule_ord", "match").collect()))
    with_literals = found()
    monkeypatch.setattr(matching.literals, "of_any", lambda p: frozenset())
    assert with_literals and found() == with_literals


def test_long_lines_of_slow_patterns(spark):
    lines = catalogue.lines(spark, RULES).limit(1).withColumn("text", F.concat(F.repeat(F.lit("a"), 26), F.lit("!")))
    slow, plain = Rule("x.slow", on="any", patterns=(r"(a+)+$",)), Rule("x.plain", on="any", patterns=("a!",))
    lines = lines.withColumn("kind", F.lit("added"))
    assert [r["rule_ord"] for r in matching.line_hits(lines, [slow, plain], longest=20).collect()] == [1]
    short = lines.withColumn("text", F.lit("aaa"))
    assert [r["rule_ord"] for r in matching.line_hits(short, [slow, plain], longest=20).collect()] == [0]
