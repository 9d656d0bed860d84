import re

import pytest
from pyspark.sql import functions as F

from patchloom.functions import globs, languages, patterns
from patchloom.functions import text as T


@pytest.mark.parametrize("bad", ["", "(?=x)", "(?!x)", "(?<=x)y", r"(a)\1", "a**", "a++", "(", ")", "[a", "*a", "(?>a)", "[[:nope:]]", "a\\"])
def test_patterns_that_the_dialect_lacks(bad):
    with pytest.raises(patterns.PatternError):
        patterns.to_java(bad)


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [
        (r"\bauth", "éauth", "auth"), (r"(?i)k", "\u212a", "\u212a"), (r"a\sb", "a\x0bb", ""), (r"x$", "x\u2028", ""), ("a.b", "a\rb", "a\rb"), (r"[[:digit:]]+", "ab12", "12"), ("{", "a{", "{"),
        (r"[a[]", "[", "["), (r"(?P<n>a+)b", "aab", "aab"), (r"[\s,]+", "a ,\tb", " ,\t"), (r"x*", "yyy", ""), (r"[a&&b]+", "&&", "&&"), (r"\Qa.b\E", "a.b", "a.b"),
    ],
)
def test_patterns_mean_the_same_to_the_engine(spark, duck, pattern, text, found):
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract("t", patterns.to_java(pattern), 0)).first()[0]
    assert got == found == duck.execute("SELECT regexp_extract(?, ?)", [text, pattern]).fetchone()[0]


def test_nested_repetition():
    assert patterns.nested_repetition("(a+)+b") and not patterns.nested_repetition(r"(ab)+c\+")


@pytest.mark.parametrize(
    ("glob", "path", "yes"),
    [
        ("*.go", "a/b/c.go", True), ("*.go", "a/b/c.gox", False), ("a/*.go", "a/b/c.go", False), ("a/**/c.go", "a/c.go", True), ("a/**/c.go", "a/x/y/c.go", True), ("**/test/**", "x/test/y", True),
        ("**/test/**", "test/y", True), ("*.{yml,yaml}", "x.YAML", True), ("./a/b", "a/b", True), ("a?c", "x/abc", True), ("a?c", "a/c", False), ("a.b", "axb", False), ("**", "any/thing", True), ("a,b", "a,b", True),
    ],
)
def test_globs(glob, path, yes):
    assert globs.matches(glob, path) is yes


def test_bad_globs():
    for g in ("{a", "a}", "", "!x"):
        with pytest.raises(globs.GlobError):
            globs.compiled([g])


@pytest.mark.parametrize(
    ("pattern", "path", "yes"),
    [("*", "a/b", True), ("/docs/", "docs/x/y", True), ("/docs/", "a/docs/x", False), ("*.py", "a/b.py", True), ("*.py", "a/b.PY", False), ("src/app", "src/app/x.go", True), ("build", "a/build/x", True)],
)
def test_owner_patterns(pattern, path, yes):
    assert bool(re.search(globs.owners_to_java(pattern), path)) is yes


def test_languages(spark):
    want = {
        "a/Dockerfile.prod": "dockerfile", "x/.env.local": "dotenv", ".github/workflows/ci.yml": "ci", "k8s/app.yml": "yaml", "go.sum": "lockfile", "A.PY": "python", "noext": "unknown", "a/b.unknown": "unknown",
        "package.json": "node-deps", "docker-compose.yml": "compose", "Main.tf": "terraform", "x.tar.gz": "unknown", ".npmrc": "config",
    }
    rows = spark.createDataFrame([(p,) for p in want], "path string").select("path", languages.language(F.col("path")).alias("k")).collect()
    assert {r["path"]: r["k"] for r in rows} == want


def _values(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_masks_and_cuts(spark):
    t = F.col("t")
    assert _values(spark, "abcdef", T.masked(t))[0] == "[redacted]"
    assert _values(spark, "abcdefgh", T.masked(t))[0] == "abc[redacted]"
    assert _values(spark, "abcdefghijklmnopqrst", T.masked(t))[0] == "abcd[redacted 16 chars]"
    assert _values(spark, "key = s3cr3tvalue;", T.redacted(t, F.lit("s3cr3tvalue")))[0] == "key = s3c[redacted];"
    assert "s3c" not in _values(spark, "some key", T.redacted(t, F.lit("s3c")))[0]
    long = "é" * 150
    assert _values(spark, long, T.truncated(t))[0] == "é" * 100 + "..."
    assert _values(spark, "\u00a0 a \t b\u2003", T.normalised(t))[0] == "a b"


def test_fingerprint_ignores_indentation(spark):
    a, b = (_values(spark, x, T.fingerprint(F.lit("r.x"), F.lit("p"), F.col("t")))[0] for x in ("  a  b", "a b\t"))
    assert a == b and re.fullmatch("[0-9a-f]{16}", a)


def test_entropy(spark):
    assert _values(spark, "aaaa", T.entropy(F.col("t")))[0] == 0 and abs(_values(spark, "abcd", T.entropy(F.col("t")))[0] - 2) < 1e-9
    assert abs(_values(spark, "éé", T.entropy(F.col("t")))[0] - 1) < 1e-9 and _values(spark, "", T.entropy(F.col("t")))[0] == 0


@pytest.mark.parametrize(
    ("text", "rule", "reason"),
    [
        ("x // patchloom:ignore", "a.b", ""), ("# patchloom:ignore -- sandbox key", "a.b", "sandbox key"), ("# patchloom:ignore[a.b] only an etag", "a.b", "only an etag"), ("/* patchloom:ignore a.b why */", "a.b", "why"),
        ("<!-- patchloom:ignore[a.*]: because -->", "a.b", "because"), ("patchloom:ignore a.b,c.d -- both", "c.d", "both"), ("patchloom:ignore just words", "a.b", "just words"), ("patchloom:ignore[c.d] no", "a.b", None),
        ("patchloom:ignore[a.b", "a.b", None), ("nothing", "a.b", None),
    ],
)
def test_suppression_notes(spark, text, rule, reason):
    note = T.suppression(F.col("t"))
    row = _values(spark, text, T.suppresses(note, F.lit(rule)).alias("yes"), note["reason"].alias("reason"))
    assert (row["reason"] if row["yes"] else None) == reason
