"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes and depends on the last 32 of them only. A chunk ends at each place whose
hash is the least of some run of ``SPREAD`` places, so equal passages are cut alike wherever they stand, an
insertion moves the cuts near it only, and cuts are never further apart than ``SPREAD``. Chunks are compared by
digest over the corpus; runs of repeated chunks are what a document shares with others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import Scratch, lean

#: Bytes between cuts at most; half of it on average.
SPREAD = 64
#: Bytes by which a cut may move on to the start of a word.
SHIFT = 16
#: Words that a run of repeated chunks must have. Of a repeated passage its cuts lose at most SPREAD and the
#: hash's 32 bytes at either end, so 50 words of usual length keep more than these; 50 words of one or two letters
#: may not. Text without spaces counts as a word for each of so many bytes.
LEAST_WORDS, WORD_BYTES = 26, 24

_GEAR = np.random.default_rng(71).integers(0, 2**32, 256, dtype=np.uint32)
SPAN = "array<struct<start: int, end: int>>"


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[b[i - k]] << k for k < 32, by doubling the window five times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            older = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += older
    return h


def cuts(data: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Chunk bounds of one text, 0 and its length included."""
    n = len(data)
    if n <= spread:
        return np.array([0, n]) if n else np.array([0])
    least = gear(data).astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < spread:
        step = min(width, spread - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    inner = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1
    return np.unique(np.concatenate([[0], _to_words(data, inner), [n]]))


def _to_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Move each cut on to the next word's start, if that is near, or else to the next character's."""
    n = len(data)
    moved = at.copy()
    for _ in range(SHIFT):
        moved += (moved < n) & X.SPACED[data[moved - 1]]
    there = (moved == n) | ~X.SPACED[data[moved - 1]]
    for _ in range(3):
        at = at + ((at < n) & (data[np.minimum(at, n - 1)] & 0xC0 == 0x80))
    return np.where(there, moved, at)


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, starts and ends among the bytes, n + 1 offsets) of the chunks of a run of texts."""
    bounds = [cuts(data[a:b]) + a for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    sizes = np.array([len(b) - 1 for b in bounds])
    start = np.concatenate([b[:-1] for b in bounds]) if bounds else np.empty(0, np.int64)
    end = np.concatenate([b[1:] for b in bounds]) if bounds else np.empty(0, np.int64)
    return X.span_hash(data, start, end), np.stack([start, end]), np.concatenate([[0], np.cumsum(sizes)])


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, doc_id) once for each text and chunk of it."""
    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(-(2**63)))
        for a, b, data, off in X.slices(batch.column(1)):
            h, _, first = chunks(data, off)
            of = np.repeat(np.arange(b - a), np.diff(first))
            order = X._sort_within(h, of, b - a)
            h, of = h[order], of[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(X.signed(h[keep])), pa.array(ids[a + of[keep]])], ["digest", "doc_id"])


def _runs(flags: np.ndarray, at: np.ndarray, begun: np.ndarray, least: int) -> list[dict]:
    """Byte spans of maximal runs of flagged chunks with ``least`` words at least; ``begun``: words begun before each byte."""
    size = lambda a, b: max(begun[b] - begun[a], (b - a) // WORD_BYTES)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(at[0, a]), "end": int(at[1, b - 1])} for a, b in edges.reshape(-1, 2) if size(at[0, a], at[1, b - 1]) >= least]


def spans(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn the lists ``shared`` and ``later`` of digests into byte spans of the runs of those chunks."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for a, b, data, off in X.slices(batch.column("text")):
            h, at, first = chunks(data, off)
            inside = X.SPACED[data]
            begun = np.concatenate([[0], np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))]) if len(data) else np.zeros(1, np.int64)
            found: dict[str, list] = {"shared": [], "later": []}
            for k in range(a, b):
                own = slice(first[k - a], first[k - a + 1])
                for name, out in found.items():
                    known = batch.column(name)[k]
                    known = np.asarray(known.values, np.int64) if known.is_valid else np.empty(0, np.int64)
                    runs = _runs(np.isin(X.signed(h[own]), known), at[:, own], begun, least) if len(known) else []
                    out.append([{"start": r["start"] - int(off[k - a]), "end": r["end"] - int(off[k - a])} for r in runs])
            rest = {c: batch.column(c).slice(a, b - a) for c in batch.schema.names if c not in found}
            yield pa.RecordBatch.from_pydict(rest | {c: pa.array(v, kind) for c, v in found.items()})


def find(docs: DataFrame, scratch: Scratch, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text, shared, later for the rows of ``docs`` that share a chunk with a row of another doc_id.

    ``shared``: byte spans of runs, of ``least`` words at least, of chunks that other documents have too.
    ``later``: the same for chunks that a document of a smaller doc_id has; without these spans every chunk of
    the corpus is left where it stands first. Either may be empty. A null or empty text, and a null doc_id,
    share nothing; rows that repeat a doc_id are one document, so what only they share is not found. Chunks are
    compared by a 64-bit digest and a passage needs several in a row. Other columns are not read.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''")
    cut = docs.mapInArrow(digest, "digest long, doc_id long")
    many = cut.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    many = scratch.keep(many.where("first < last").select("digest", "first"), "repeated")
    mine = cut.join(many, "digest").select("doc_id", "digest", (F.col("doc_id") > F.col("first")).alias("after"))
    by_doc = mine.groupBy("doc_id").agg(F.collect_set("digest").alias("shared"), F.collect_set(F.when(F.col("after"), F.col("digest"))).alias("later"))
    by_doc = scratch.keep(by_doc, "shared")
    rows = docs.join(by_doc, "doc_id")
    return rows.mapInArrow(lambda batches: spans(least, batches), f"doc_id long, text string, shared {SPAN}, later {SPAN}")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text"), batch.column("later"), strict=True):
            raw, at, kept = text.as_py().encode(), 0, []
            for s in gone.as_py():
                kept.append(raw[at : s["start"]])
                at = s["end"]
            texts.append((b"".join(kept) + raw[at:]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(texts, pa.string())], ["doc_id", "text", "kept_text"])


def dedupe(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with the repeated passages of :func:`find` taken out of ``text``, but for their first document.

    A column n_chars follows the changed texts. Rows are matched by doc_id and text, so rows of one doc_id with
    several texts keep each its own.
    """
    changed = find(docs, scratch).where(F.size("later") > 0).mapInArrow(_without, "doc_id long, text string, kept_text string")
    changed = changed.select(F.col("doc_id").alias("_of"), F.sha2("text", 256).alias("_was"), F.col("kept_text").alias("_left")).dropDuplicates(["_of", "_was"])
    changed = scratch.keep(changed, "changed")
    whole = docs.join(changed, (docs["doc_id"] == changed["_of"]) & (F.sha2(docs["text"], 256) == changed["_was"]), "left")
    new = {"text": F.coalesce(changed["_left"], docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed["_left"].isNotNull(), F.length(changed["_left"]).cast("long")).otherwise(docs["n_chars"])
    return whole.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    """A row for each document that shares a passage with another: doc_id, n_bytes, n_spans, shared_bytes (in
    passages that others have too), later_bytes (in those that a smaller doc_id has, which dedup takes out),
    first_start, last_end (bytes of the first and last such passage)."""
    found = find(docs, Scratch(docs.sparkSession, "chunks")).where(F.size("shared") > 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("shared").cast("long").alias("n_spans"), total("shared").alias("shared_bytes"),
        total("later").alias("later_bytes"), F.col("shared")[0]["start"].cast("long").alias("first_start"), F.element_at("shared", -1)["end"].cast("long").alias("last_end"),
    )
