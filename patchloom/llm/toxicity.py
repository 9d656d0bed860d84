"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Every coordinate has its own learning rate, and the L1 term keeps at zero all but the weights that the examples
argue for, so the model that is broadcast is a short sorted list of hashes and weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import features as Y

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12000
BITS = 22
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 12.0, 1.0, 6
THRESHOLD = 0.3
#: Words between the two of a skip-gram, at most.
SKIPS = 2


def _held_out():
    return Y.remainder(F.col("doc_id"), 4) == 2


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, text) of every word, word pair and skip-gram; words are of letters and digits."""
    w = X.words(data, off, X.ALNUM)
    of, mask = w.text_of, np.uint64((1 << BITS) - 1)
    parts, texts = [w.hash & mask], [of]
    for gap in range(1, SKIPS + 2):
        if len(of) > gap:
            same = of[gap:] == of[:-gap]
            parts.append((X.mix(w.hash[:-gap] * np.uint64(3 + 2 * min(gap, 2)) + w.hash[gap:]) & mask)[same])
            texts.append(of[:-gap][same])
    return np.concatenate(parts), np.concatenate(texts)


def _features(data: np.ndarray, off: np.ndarray) -> dict:
    h, of = grams(data, off)
    ids, _, first = Y.sets_of(h, of, len(off) - 1)
    return {"x": Y.packed(ids.astype(np.int32), first)}


def fit(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, their weights, bias). Without examples of both labels the bias alone is fitted."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rng = np.random.default_rng(5)
    zb = nb = 0.0

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)).tolist():
            x, y = examples[k]
            w, b = weight(z[x], n[x], L1), float(weight(np.float64(zb), np.float64(nb), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA * w
            n[x] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * b
            nb += g * g
    w = weight(z, n, L1)
    some = np.flatnonzero(w)
    return some.astype(np.uint64), w[some], float(weight(np.float64(zb), np.float64(nb), 0.0))


def score(model: tuple[np.ndarray, np.ndarray, float], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The probability of each text; a feature counts once however often it stands in a text."""
    some, weights, bias = model
    total = np.full(len(off) - 1, bias)
    if len(some):
        h, of = grams(data, off)
        table = np.zeros(1 << 16, bool)
        table[some & np.uint64(0xFFFF)] = True
        keep = table[h & np.uint64(0xFFFF)]
        h, of = h[keep], of[keep]
        at = np.minimum(np.searchsorted(some, h), len(some) - 1)
        hit = some[at] == h
        ids, _, first = Y.sets_of(at[hit], of[hit], len(off) - 1)
        total += np.bincount(np.repeat(np.arange(len(off) - 1), np.diff(first)), weights[ids.astype(np.int64)], len(off) - 1)
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from at most :data:`SAMPLE` labelled rows, of :data:`features.SAMPLE_BYTES` in all, that are not held
    out. Rows that repeat a doc_id are scored each by its own text. A null or empty text is scored like a text
    without any known feature; with no usable labels every score is 0.5. Other columns are not read.
    """
    rows = Y.sample(docs, labels, "toxic", _held_out(), SAMPLE)
    examples = [(np.frombuffer(r["x"], np.int32), r["y"]) for r in Y.collected(rows, _features, "x binary")]
    return Y.scored(docs, score, _held_out(), THRESHOLD, fit(examples))
