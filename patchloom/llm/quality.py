"""Quality by a factorisation machine over hashed words, text structure and length.

score = sigmoid(bias + sum of w x + sum over pairs of <v_i, v_j> x_i x_j). The pairwise sum is half the square of
the summed v x less the sum of the squares, so a text costs as much as it has features and not their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import features as Y

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6000
BITS, RANK, EPOCHS, BATCH = 15, 6, 6, 64
RATE, DECAY = 0.05, 1e-4
THRESHOLD = 0.5
_CLASSES = {
    "upper": list(range(65, 91)), "lower": list(range(97, 123)), "digit": list(range(48, 58)), "space": [32, 9, 11, 12], "line": [10, 13],
    "stop": [33, 46, 63], "comma": [44, 58, 59], "mark": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 96, 123, 124, 125, 126], "wide": list(range(128, 256)),
}
_STRUCTURE = len(_CLASSES) + 7


def structure(data: np.ndarray, off: np.ndarray, w: X.Words) -> np.ndarray:
    """Shape of each text: shares of byte classes, length, words and their length, repeated words, line length."""
    size = np.maximum(np.diff(off), 1).astype(float)
    columns = []
    for members in _CLASSES.values():
        table = np.zeros(256, np.int64)
        table[members] = 1
        total = np.concatenate([[0], np.cumsum(table[data])])
        columns.append(np.sqrt((total[off[1:]] - total[off[:-1]]) / size))
    count = np.diff(w.first)
    some = np.maximum(count, 1)
    marks = np.zeros(256, np.int64)
    marks[_CLASSES["mark"] + [33]] = 1
    ended = marks[data[w.end - 1]] if len(w.end) else np.empty(0, np.int64)
    ended = np.concatenate([[0], np.cumsum(ended)])
    own, _, first = Y.sets_of(w.hash & np.uint64((1 << 40) - 1), w.text_of, len(off) - 1)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    lines = lines[off[1:]] - lines[off[:-1]] + 1
    columns += [
        np.log1p(np.diff(off)) / 10, np.log1p(count) / 8, np.minimum(np.diff(off) / some, 40) / 20, np.diff(first) / some,
        (ended[w.first[1:]] - ended[w.first[:-1]]) / some, np.log1p(size / lines) / 8, (count == 0).astype(float),
    ]
    return np.stack(columns, 1)


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words, their values, n + 1 offsets, structure). A word's value is its share of the text, damped."""
    w = X.words(data, off, X.SPACED, lower=False)
    ids, counts, first = Y.sets_of(w.hash & np.uint64((1 << BITS) - 1), w.text_of, len(off) - 1)
    n = np.sqrt(np.maximum(np.diff(w.first), 1))
    return ids.astype(np.int64), np.log1p(counts) / np.repeat(n, np.diff(first)), first, structure(data, off, w)


def _features(data: np.ndarray, off: np.ndarray) -> dict:
    ids, values, first, shape = words_of(data, off)
    return {"x": Y.packed(ids.astype(np.int32), first), "v": Y.packed(values.astype(np.float32), first), "s": pa.array(shape.tolist(), pa.list_(pa.float64()))}


def _logit(model: dict, ids: np.ndarray, values: np.ndarray, first: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits, and the summed v x that the pairwise part and its gradient need."""
    shape = (shape - model["mean"]) / model["spread"]
    n, of = len(first) - 1, np.repeat(np.arange(len(first) - 1), np.diff(first))
    v = model["v"][ids] * values[:, None]
    summed, squares = np.zeros((n, RANK)), np.zeros(n)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        summed[full] = np.add.reduceat(v, first[:-1][full], axis=0)
        squares[full] = np.add.reduceat((v * v).sum(1), first[:-1][full])
    summed += shape @ model["u"]
    squares += (shape * shape) @ (model["u"] ** 2).sum(1)
    linear = np.bincount(of, model["w"][ids] * values, n) + shape @ model["c"] + model["b"]
    return linear + 0.5 * ((summed**2).sum(1) - squares), summed


def fit(rows: list) -> dict:
    """A model by AdaGrad over mini-batches. Without examples every score is 0.5."""
    rng = np.random.default_rng(11)
    shape = np.array([r["s"] for r in rows]).reshape(len(rows), _STRUCTURE)
    y = np.array([r["y"] for r in rows], float)
    model = {"mean": shape.mean(0) if len(rows) else np.zeros(_STRUCTURE), "spread": shape.std(0) + 0.05 if len(rows) else np.ones(_STRUCTURE)}
    model |= {"v": rng.normal(0, 0.01, (1 << BITS, RANK)), "u": rng.normal(0, 0.01, (_STRUCTURE, RANK)), "w": np.zeros(1 << BITS), "c": np.zeros(_STRUCTURE), "b": 0.0}
    seen = {k: np.full_like(model[k], 1e-6) for k in ("v", "u", "w", "c")} | {"b": 1e-6}
    x, val = [np.frombuffer(r["x"], np.int32) for r in rows], [np.frombuffer(r["v"], np.float32).astype(float) for r in rows]
    for _ in range(EPOCHS if len(rows) else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            ids, values = np.concatenate([x[k] for k in at]), np.concatenate([val[k] for k in at])
            first = np.concatenate([[0], np.cumsum([len(x[k]) for k in at])])
            logit, summed = _logit(model, ids, values, first, shape[at])
            g = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - y[at]) / len(at)
            of, s = np.repeat(np.arange(len(at)), np.diff(first)), (shape[at] - model["mean"]) / model["spread"]
            own, back = np.unique(ids, return_inverse=True)
            gv = np.stack([np.bincount(back, g[of] * values * (summed[of, k] - model["v"][ids, k] * values), len(own)) for k in range(RANK)], 1)
            steps = {"w": (own, np.bincount(back, g[of] * values, len(own))), "v": (own, gv)}
            steps |= {"c": (slice(None), s.T @ g), "u": (slice(None), s.T @ (g[:, None] * summed) - (s * s).T @ g.reshape(-1, 1) * model["u"])}
            for k, (where, grad) in steps.items():
                grad = grad + DECAY * model[k][where]
                seen[k][where] += grad**2
                model[k][where] -= RATE * grad / np.sqrt(seen[k][where])
            seen["b"] += g.sum() ** 2
            model["b"] -= RATE * g.sum() / np.sqrt(seen["b"])
    return model | {k: model[k].astype(np.float32) for k in ("v", "w")}


def score(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    logit, _ = _logit(model, *words_of(data, off))
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _held_out():
    return Y.remainder(F.col("doc_id"), 3) == 1


def model(docs: DataFrame, labels: DataFrame) -> dict:
    """The machine fitted on the sample of ``labels`` and their texts."""
    rows = Y.sample(docs, labels, "quality", _held_out(), SAMPLE)
    return fit(Y.collected(rows, _features, "x binary, v binary, s array<double>"))


def chosen(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, each judged by its own text whatever its doc_id."""
    return Y.scores(docs, score, model(docs, labels), docs.columns).where(F.col("_score") >= THRESHOLD).drop("_score")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from at most :data:`SAMPLE` labelled rows, of :data:`features.SAMPLE_BYTES` in all, that are not held
    out. Rows that repeat a doc_id are scored each by its own text. A null text is scored as an empty one; with no
    usable labels every score is near 0.5. Ties of scores are no matter; other columns are not read.
    """
    return Y.scored(docs, score, _held_out(), THRESHOLD, model(docs, labels))
