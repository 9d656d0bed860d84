"""Scores recomputed feature by feature, empty tables through every stage, very long texts, and columns with the names that operators use inside."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from patchloom.llm import _text as X
from patchloom.llm import bpe, chunks, decontaminate, licenses, minhash, quality, toxicity
from patchloom.llm import features as Y
from patchloom.llm._store import Scratch
from patchloom.llm.queries import vocabulary

from ..conftest import DATA

TEXTS = ["good plain words of a text", "", "BUY NOW !!! $$$ buy now", "déjà vu\nword word", "a " * 300, "one"]


def _flat(texts):
    return X.buffers(pa.array(texts))


def test_quality_scores_pair_by_pair():
    """The linear-time identity against the sum over all pairs of features."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "$$$", "!!!"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    shape_rows = []
    for k, t in enumerate(texts):
        ids, values, first, shape = quality.words_of(*_flat([t]))
        shape_rows.append({"x": ids.astype(np.int32).tobytes(), "v": values.astype(np.float32).tobytes(), "s": shape[0].tolist(), "y": int("$$$" not in t), "doc_id": k})
    model = quality.fit(shape_rows)
    got = quality.score(model, *_flat(TEXTS))
    for text, s in zip(TEXTS, got, strict=True):
        ids, values, _, shape = quality.words_of(*_flat([text]))
        shape = (shape[0] - model["mean"]) / model["spread"]
        x = [*zip(values.tolist(), model["w"][ids].tolist(), model["v"][ids].astype(float), strict=True), *zip(shape.tolist(), model["c"].tolist(), model["u"], strict=True)]
        logit = model["b"] + sum(v * w for v, w, _ in x) + sum(float(a[2] @ b[2]) * a[0] * b[0] for k, a in enumerate(x) for b in x[:k])
        assert abs(s - 1 / (1 + math.exp(-logit))) < 1e-6, text


def test_toxicity_scores_feature_by_feature():
    examples = [("you are awful and vile", 1), ("a nice calm day", 0), ("awful vile words", 1), ("calm words of a day", 0)] * 30
    data, off = _flat([t for t, _ in examples])
    x = toxicity._features(data, off)["x"].to_pylist()
    some, weights, bias = model = toxicity.fit([(np.frombuffer(r, np.int32), y) for r, (_, y) in zip(x, examples, strict=True)])
    assert 0 < len(some) < 60
    known = dict(zip(some.tolist(), weights.tolist(), strict=True))
    texts = ["awful awful vile", "calm day", "", "unknown", "vile calm awful day"]
    for text, s in zip(texts, toxicity.score(model, *_flat(texts)), strict=True):
        h, _ = toxicity.grams(*_flat([text]))
        assert abs(s - 1 / (1 + math.exp(-bias - sum(known.get(k, 0.0) for k in set(h.tolist()))))) < 1e-9
    assert toxicity.score(model, *_flat(["awful vile"]))[0] > 0.5 > toxicity.score(model, *_flat(["calm day"]))[0]


def _plain_ftrl(examples):
    """The same updates with a dictionary of coordinates, for the order that the operator draws."""
    z, n, zb, nb, rng = Counter(), Counter(), 0.0, 0.0, np.random.default_rng(5)
    w = lambda z, n, l1: 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for k in rng.permutation(len(examples)).tolist():
            x, y = examples[k]
            own, b = {i: w(z[i], n[i], toxicity.L1) for i in x}, w(zb, nb, 0.0)
            g = 1 / (1 + math.exp(-(sum(own.values()) + b))) - y
            for i in x:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * own[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / toxicity.ALPHA * b
            nb += g * g
    return {i: v for i in z if (v := w(z[i], n[i], toxicity.L1))}, w(zb, nb, 0.0)


def test_toxicity_is_fitted_coordinate_by_coordinate():
    rng = random.Random(3)
    examples = [(sorted(rng.sample(range(40), 6)) + [100 + y] * 1, y) for y in (0, 1) for _ in range(60)]
    some, weights, bias = toxicity.fit([(np.array(x, np.int32), y) for x, y in examples])
    want, b = _plain_ftrl(examples)
    assert set(some.tolist()) == set(want) and all(abs(want[i] - v) < 1e-9 for i, v in zip(some.tolist(), weights.tolist(), strict=True)) and abs(b - bias) < 1e-9


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(C.COLUMNS)
    at = str(tmp_path)
    docs.limit(0).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0, name
    assert C.run(spark, at).count() == 0
    few = docs.limit(5)
    assert C.classify(spark, few, at).count() in (0, 5)  # without labels all scores are alike
    assert C.decontaminated(spark, few, at).count() == 5


NAMES = "doc_id long, text string, _of int, _was string, _left int, _d int, _t1 int, _t2 int, _text int, _n_words int, _spans int, _items int, _score int, row int, part int"


def test_names_of_helper_columns(spark):
    rows = [(k, t, *range(13)) for k, t in enumerate(["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta", None, ""])]
    rows = [tuple(str(v) if c == 3 else v for c, v in enumerate(r)) for r in rows]
    docs = spark.createDataFrame(rows, NAMES)
    plain = docs.select("doc_id", "text")
    own = lambda df: sorted(str((r["doc_id"], r["text"])) for r in df.collect())
    names = [f.name for f in docs.schema]
    kept = bpe.encode(docs, vocabulary())
    assert [c for c in kept.columns if c != "token_ids"] == names and own(kept) == own(plain)
    for op in (minhash.op1, licenses.op10, chunks.op7):
        assert sorted(map(str, op(docs).collect())) == sorted(map(str, op(plain).collect()))
    assert own(minhash.deduplicated(plain, Scratch(spark, "t"))) == own(plain.where("doc_id <> 1"))


@pytest.mark.parametrize("kind", ["one word", "many words", "no space at all"])
def test_very_long_texts(spark, kind):
    """Texts of two million bytes go through the operators on words whole."""
    text = {"one word": "word " * 400_000, "many words": " ".join(f"w{k * 7919 % 99991}" for k in range(300_000)), "no space at all": "x" * 2_000_000}[kind]
    docs = spark.createDataFrame([(1, text), (2, "short text of few words")], "doc_id long, text string")
    w = text.split()
    words = len(w)
    shingles = minhash.op1(docs).collect()
    want = {tuple(w[k : k + 5]) for k in range(words - 4)} if words >= 5 else {text}
    assert {r["doc_id"]: r["n_shingles"] for r in shingles} == {1: len(want), 2: 1}
    item = "short text of few words"
    bench = spark.createDataFrame([(7, item), (8, " ".join(w[words // 2 : words // 2 + 10])[:200])], "item_id long, text string")
    hit = {r["doc_id"]: (r["n_words"], r["n_items"]) for r in decontaminate.op5(docs, bench).collect()}
    assert hit[2] == (5, 1) and hit[1] == (words, 0 if kind == "no space at all" else 1)
    assert zlib.crc32(text.encode()) and Y.SAMPLE_BYTES > len(text)
