"""The stages of the corpus pipeline against plain versions of what they do, on small tables."""

import re

import pytest

import corpus_pipeline as C
from patchloom.llm import quality
from patchloom.llm._store import Scratch

from ..conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def _kept(frame):
    rows = frame.collect()
    assert frame.columns == C.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def _near_dedup(rows):
    """One row of each component of near-duplicates, by brute force."""
    rows = sorted(rows, key=str)
    known = [(k, _shingles(t)) for k, (i, t) in enumerate(rows) if i is not None and _shingles(t)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if 100 * len(s & t) >= 75 * len(s | t):
                parent[root(i)] = root(j)
    groups = {}
    for k, _ in known:
        groups.setdefault(root(k), []).append(rows[k])
    return [rows[k] for k in range(len(rows)) if rows[k][0] is None or not _shingles(rows[k][1])], list(groups.values())


def test_quality_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(C.COLUMNS)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()][:60]
    table = _table(spark, [*rows, (rows[0][0], "$$$ ### buy now !!! " * 40), (None, rows[1][1])])
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r["text"] for r in C.classify(spark, table, DATA).collect()}
    import numpy as np

    model = quality.model(table, labels)
    for i, t in [*rows, (None, rows[1][1])]:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        assert (t in good) == (quality.score(model, raw, np.array([0, len(raw)]))[0] >= 0.5), i
    assert C.classify(spark, table, DATA).columns == C.COLUMNS


def test_near_dedup_stage(spark):
    base = [f"w{k}" for k in range(60)]
    edit = lambda *at: " ".join("x" + w if k in at else w for k, w in enumerate(base))
    rows = [(5, edit()), (3, edit(7)), (9, edit(7, 30)), (9, edit(50)), (9, edit(50)), (2, edit(1, 20, 40)), (None, edit()), (4, None), (6, ""), (7, "a b"), (7, "a b"), (8, "A  B"), (1, "other words entirely here now")]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows += [(1000 + r["doc_id"], r["text"]) for r in docs]
    alone, groups = _near_dedup(rows)
    got = _kept(C.near_dedup(spark, _table(spark, rows), DATA))
    for row in alone:
        assert row in got
    assert len(got) == len(alone) + len(groups)
    for g in groups:
        inside = [r for r in got if r in g]
        assert len(inside) == 1 and inside[0][0] == min(r[0] for r in g)


def test_decontamination_stage(spark):
    """Rows of one doc_id are judged apart, and null doc_ids by their text."""
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r["text"]]
    rows = [(1, "clean words only"), (1, "see: " + items[0]), (None, items[1]), (None, "nothing of it"), (2, None), (3, "")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for t in items:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    rows += [(10 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    sizes = {len(x) for x in windows}
    want = [(i, t) for i, t in rows if not any(tuple(words(t)[k : k + n]) in windows for n in sizes for k in range(len(words(t)) - n + 1))]
    assert _kept(C.decontaminated(spark, _table(spark, rows), DATA)) == sorted(want, key=str)


def test_substring_stage(spark):
    passage = " ".join(f"passage{k} of" for k in range(40))
    own = lambda c: " ".join(f"{c}{k}" for k in range(80))
    rows = [(1, own("a") + " " + passage + " " + own("b")), (2, own("c") + "\n" + passage), (3, passage), (4, None), (5, ""), (None, passage), (6, "short")]
    got = dict(_kept(C.substring_dedup(spark, _table(spark, rows), DATA)))
    assert got[1] == rows[0][1] and own("c") in got[2] and len(got[2]) < len(rows[1][1]) - len(passage) // 2
    assert got[4] is None and got[5] == "" and got[None] == passage and got[6] == "short" and len(got.get(3, "")) < len(passage) // 2


def test_tokens_decode(spark):
    pytest.importorskip("public_tokenizers")
    rows = C.tokenised(spark, _table(spark, [(1, "Some  tokens, é 日本\n"), (2, ""), (None, "x" * 300), (1, "twice")]), DATA).collect()
    assert len(rows) == 4 and all(r["decoded"] == r["text"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)


def test_run(spark):
    """Every stage works on what its predecessor kept, in the order given."""
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe"]
    before = docs.count()
    for name, stage in C.STAGES:
        docs = scratch.keep(stage(spark, docs, DATA), name)
        after = docs.count()
        assert 0 < after <= before and docs.columns[:5] == C.COLUMNS, name
        before = after
    assert {(r["doc_id"], r["text"]) for r in C.run(spark, DATA).collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}
