"""Benchmark decontamination by a prefix-filtered join of ten-word windows.

A window of a benchmark item occurs in a text only if all its words do, so the one word of it that is rarest
in the corpus is the whole prefix that a join needs. Texts are probed for those words alone; each match is
bounded by its place in the window and the text's length, then every word of the window is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._store import lean

WINDOW = 10
#: Words of benchmark text that are sent to the executors at once; a larger benchmark takes several passes.
BLOCK_WORDS = 1 << 18
#: Words of an item that are dealt to one block together.
PIECE = 4096
_SLOTS = 1 << 20


@dataclass
class Index:
    """Windows in order of their rarest word: its hash, its place in the window, and the window's own words."""

    anchor: np.ndarray
    place: np.ndarray
    size: np.ndarray
    words: np.ndarray
    items: np.ndarray
    first: np.ndarray
    slots: np.ndarray


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words): each item's word hashes in runs of PIECE, which overlap so that every window lies in one."""
    for batch in batches:
        for a, b, data, off in X.slices(batch.column(1)):
            w = X.words(data, off, X.ALNUM)
            for d in range(a, b):
                h = w.hash[w.first[d - a] : w.first[d - a + 1]]
                step = PIECE - WINDOW + 1
                runs = [h[k : k + PIECE] for k in range(0, max(1, len(h) - WINDOW + 1), step)] if len(h) else []
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[d].as_py()] * len(runs), pa.int64()), pa.array([r.tobytes() for r in runs], pa.binary())], ["item_id", "words"])


def _windows(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, sizes, items) of the pieces: one row for each distinct window and item."""
    rows, sizes, items = [np.empty((0, WINDOW), np.uint64)], [], []
    for item, raw in pieces:
        h = np.frombuffer(raw, np.uint64)
        size = min(WINDOW, len(h))
        own = np.zeros((len(h) - size + 1, WINDOW), np.uint64)
        own[:, :size] = np.lib.stride_tricks.sliding_window_view(h, size)
        rows.append(own)
        sizes += [size] * len(own)
        items += [item] * len(own)
    rows, sizes, items = np.concatenate(rows), np.array(sizes, np.int64), np.array(items, np.int64)
    order = np.lexsort((items, sizes, *rows.T))
    rows, sizes, items = rows[order], sizes[order], items[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1) | (sizes[1:] != sizes[:-1]) | (items[1:] != items[:-1])
    return rows[new], sizes[new], items[new]


def _slots(hashes: np.ndarray) -> np.ndarray:
    slots = np.zeros(_SLOTS, bool)
    slots[hashes & np.uint64(_SLOTS - 1)] = True
    return slots


def _index(rows: np.ndarray, sizes: np.ndarray, items: np.ndarray, vocabulary: np.ndarray, frequency: np.ndarray) -> Index:
    """The windows of :func:`_windows` with their items, by their rarest word."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1) | (sizes[1:] != sizes[:-1])
    at = np.flatnonzero(new)
    words, size = rows[at], sizes[at]
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, frequency))] = np.arange(len(vocabulary))
    ranks = rank[np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))] if len(words) else np.empty((0, WINDOW), np.int64)
    ranks[np.arange(WINDOW)[None] >= size[:, None]] = len(vocabulary)
    place = ranks.argmin(1)
    anchor = words[np.arange(len(words)), place]
    order = np.argsort(anchor, kind="stable")
    count = np.diff(np.append(at, len(rows)))[order]
    flat = np.repeat(at[order], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return Index(anchor[order], place[order], size[order], words[order], items[flat], np.concatenate([[0], np.cumsum(count)]), _slots(anchor))


def _expand(index: Index, w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every occurrence in a run of texts."""
    at = np.flatnonzero(index.slots[w.hash & np.uint64(_SLOTS - 1)])
    lo, hi = (np.searchsorted(index.anchor, w.hash[at], side) for side in ("left", "right"))
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    window = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(at, n)
    start, of = at - index.place[window], np.searchsorted(w.first, at, "right") - 1
    inside = (start >= w.first[of]) & (start + index.size[window] <= w.first[of + 1])
    window, start = window[inside], start[inside]
    for k in range(WINDOW):
        there = np.minimum(start + k, len(w.hash) - 1)
        same = (index.size[window] <= k) | (w.hash[there] == index.words[window, k])
        window, start = window[same], start[same]
    return window, start


def _scan(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text (or _text), _n_words, _spans, _items and any others: what this block's windows add."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        names = batch.schema.names
        for a, b, data, off in X.slices(batch.column("_text" if "_text" in names else "text")):
            w = X.words(data, off, X.ALNUM)
            window, start = _expand(index, w) if len(w.hash) else (np.empty(0, np.int64), np.empty(0, np.int64))
            spans, items = (batch.column(c).slice(a, b - a).to_pylist() for c in ("_spans", "_items"))
            of = np.searchsorted(w.first, start, "right") - 1
            for d in np.unique(of).tolist():
                mine = of == d
                seen = set(items[d]).union(*(index.items[index.first[k] : index.first[k + 1]].tolist() for k in np.unique(window[mine]).tolist()))
                begin = start[mine] - w.first[d]
                runs = [(s["start"], s["end"]) for s in spans[d]] + list(zip(begin.tolist(), (begin + index.size[window[mine]]).tolist(), strict=True))
                spans[d], items[d] = [{"start": s, "end": e} for s, e in _joined(runs)], sorted(seen)
            new = {"_n_words": pa.array(np.diff(w.first), pa.int64()), "_spans": pa.array(spans, kind), "_items": pa.array(items, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k).slice(a, b - a)) for k, c in enumerate(names)], names)


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each of these sorted words stands in the corpus."""
    total = np.zeros(len(vocabulary), np.int64)
    if not len(vocabulary):
        return total
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        vocab = shared.value
        total, slots = np.zeros(len(vocab), np.int64), _slots(vocab)
        for batch in batches:
            for _, _, data, off in X.slices(batch.column(0)):
                h = X.words(data, off, X.ALNUM).hash
                h = h[slots[h & np.uint64(_SLOTS - 1)]]
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                total += np.bincount(at[vocab[at] == h], minlength=len(vocab))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    # As many rows as the block has words.
    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    for r in rows:
        total[r["word"]] = r["n"]
    return total


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with _n_words, _spans and _items, each row judged by its own text whatever its doc_id.

    ``_spans``: the runs of words, counted from 0, that lie in occurrences of benchmark windows. ``_items``: the
    item_ids of those windows, sorted. Items without words, with a null text or with a null item_id have no
    windows; repeated items count once. A null text has no words. A long item is dealt to blocks in pieces.
    """
    kind = "array<struct<start: int, end: int>>"
    lean(docs.sparkSession)
    # The text is sent once, unless it is no text.
    other = [] if isinstance(docs.schema["text"].dataType, T.StringType) else [F.col("text").cast("string").alias("_text")]
    out = docs.select(*other, *docs.columns, F.lit(0).cast("long").alias("_n_words"), F.array().cast(kind).alias("_spans"), F.array().cast("array<long>").alias("_items"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    pieces = items.mapInArrow(_pieces, "item_id long, words binary")
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (8 * BLOCK_WORDS)))
    for k in range(blocks):
        rows = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).collect()
        windows = _windows([(r["item_id"], bytes(r["words"])) for r in rows])
        vocabulary = np.unique(windows[0][np.arange(WINDOW)[None] < windows[1][:, None]])
        index = _index(*windows, vocabulary, counts(docs.select(F.col("text").cast("string").alias("text")), vocabulary))
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = out.mapInArrow(lambda batches, shared=shared: _scan(shared.value, batches), out.schema)
    return out.drop("_text")


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, spans, items for every row of ``docs``; see :func:`scan`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scan(docs, items).select("doc_id", F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any window of a benchmark item."""
    return scan(docs, items).where(F.size("_spans") == 0).select(*docs.columns)


def op5(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``; see :func:`scan`.

    Rows that repeat a doc_id are judged each by its own text; other columns are not read.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    named = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    found = find(docs, items).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)
