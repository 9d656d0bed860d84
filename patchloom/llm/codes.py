"""Codes of vectors by product quantisation in whole numbers.

A vector is cut into eight parts, and each part position has a codebook of sixteen entries, moved by rounds of
assignment and integer means. An assignment first computes all distances by a float32 matrix product. Each has an
interval that provably holds the true value, from the bounds of rounding errors; only entries whose intervals reach
that of the best are computed again in 64-bit integers, and ties go to the lower index. So codes are exact, and the
same on every machine, whatever order a product is summed in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: What a component or a sum of squares beyond 64 bits counts as.
LEAST, MOST = -(2**63), 2**63 - 1
_UNIT32, _UNIT64 = 2.0**-24, 2.0**-53


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) in 64 bits; what lies beyond them is the least or the largest number of 64 bits."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x.astype(np.float64))
    out = np.clip(y, -(2.0**62), 2.0**62).astype(np.int64)
    odd = np.abs(y) > 2.0**62
    if odd.any():
        out[odd] = [min(MOST, max(LEAST, int(v))) if np.isfinite(v) else MOST if v > 0 else LEAST for v in y[odd].tolist()]
    return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows: int64 where these cannot overflow, else whole numbers of any size."""
    limit = int((2**62 // max(1, x.shape[1])) ** 0.5) // 2
    small = ((x > -limit) & (x < limit)).all(1) & ((c > -limit) & (c < limit)).all(1)
    if small.all():
        return ((x - c) ** 2).sum(1)
    out = np.empty(len(x), object)
    out[small] = ((x[small] - c[small]) ** 2).sum(1).tolist()
    out[~small] = [sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for u, v in zip(x[~small].tolist(), c[~small].tolist(), strict=True)]
    return out


def candidates(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which entries may be nearest to each row: those whose intervals of distance reach that of the best.

    The distance less the row's own square is s = |c|^2 - 2 x.c. With u = 2^-24 and n products, of numbers that are
    rounded first, the float32 product is wrong by at most g |x||c| with g = (n + 3) u / (1 - (n + 3) u), in any order
    of sums; what is added in double precision is bounded alike. Where float32 overflows, nothing is excluded.
    """
    n = x.shape[1]
    xd, cd = x.astype(np.float64), c.astype(np.float64)
    square = (cd * cd).sum(1)
    lengths = np.sqrt((xd * xd).sum(1))[:, None] * np.sqrt(square)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
        near = square - 2 * product
    g = (n + 3) * _UNIT32 / (1 - (n + 3) * _UNIT32)
    wrong = (2 * g * lengths + 4 * (n + 8) * _UNIT64 * (square + 2 * lengths)) * (1 + 1e-6)
    low, high = near - wrong, near + wrong
    unknown = ~np.isfinite(near)
    low[unknown], high[unknown] = -np.inf, np.inf
    return low <= high.min(1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The index of the entry of ``c`` nearest to each row of ``x``, both of int64; the lowest of several."""
    may = candidates(x, c)
    best = may.argmax(1)
    open_ = np.flatnonzero(may.sum(1) > 1)
    if len(open_):
        row, entry = np.nonzero(may[open_])
        exact = _squares(x[open_[row]], c[entry])
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, first)
        hits = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(first, len(row)))))
        best[open_] = entry[hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]]
    return best


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The packed vectors of a batch, with zeros behind the shorter ones."""
    raw, wide = batch.column("vector").to_pylist(), batch.column("wide").to_pylist()
    narrow = not any(wide)
    if narrow and all(len(r) == 4 * dim for r in raw):
        return np.frombuffer(b"".join(raw), np.int32).reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(raw), dim), np.int64)
    for k, (r, w) in enumerate(zip(raw, wide, strict=True)):
        v = np.frombuffer(r, np.int64 if w else np.int32)
        out[k, : len(v)] = v
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, (1 << 20) // max(1, dim))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            yield (part := batch.slice(k, step)), _vectors(part, dim)


class Sums:
    """Exact sums of vectors by part and entry: halves of 32 bits apart, so that no sum of a task leaves 64 bits."""

    def __init__(self, dim: int, entries: int):
        self.high, self.low = (np.zeros((PARTS, entries, dim // PARTS), np.int64) for _ in range(2))
        self.count = np.zeros((PARTS, entries), np.int64)

    def add(self, part: int, x: np.ndarray, entry: np.ndarray) -> None:
        order = np.argsort(entry, kind="stable")
        own, first, n = np.unique(entry[order], return_index=True, return_counts=True)
        rows = x[order]
        self.high[part, own] += np.add.reduceat(rows >> 32, first)
        self.low[part, own] += np.add.reduceat(rows & 0xFFFFFFFF, first)
        self.count[part, own] += n

    def table(self) -> pa.RecordBatch:
        part, entry, at = (i.ravel() for i in np.indices(self.high.shape))
        n = self.count[part, entry]
        some = n > 0
        columns = (part, entry, at, self.high.ravel(), self.low.ravel(), n)
        return pa.RecordBatch.from_arrays([pa.array(c[some].astype(np.int64)) for c in columns], ["part", "entry", "at", "high", "low", "n"])


def packed(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """``rows`` that have a vector of finite components, with it as whole numbers in ``vector`` and ``wide``."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.withColumn(vector, F.col(vector).cast("array<double>"))
    rows = rows.where(F.col(vector).isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)))
    rest = [c for c in rows.columns if c != vector]

    def run(batches):
        for batch in batches:
            raw, wide = [], []
            for v in batch.column(vector):
                x = whole(np.asarray(v.values, np.float64), scale)
                wide.append(bool(len(x)) and (x.min() < -(2**31) or x.max() >= 2**31))
                raw.append(x.astype(np.int64 if wide[-1] else np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(raw, pa.binary()), pa.array(wide, pa.bool_())], [*rest, "vector", "wide"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != vector)
    return rows.mapInArrow(run, f"{fields}vector binary, wide boolean")


class Codebooks:
    """The entries of each part position, [part][entry], for vectors of ``dim`` components."""

    def __init__(self, entries: np.ndarray, dim: int):
        self.entries, self.dim, self.size = entries, dim, dim // PARTS

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(x[:, p * self.size : (p + 1) * self.size], self.entries[p]) for p in range(PARTS)], 1)

    def errors(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, summed over parts; at most what 64 bits hold."""
        each = np.stack([_squares(x[:, p * self.size : (p + 1) * self.size], self.entries[p][own[:, p]]).astype(object) for p in range(PARTS)], 1)
        return np.array([min(MOST, sum(e)) for e in each.tolist()], np.int64)

    def decode(self, codes: list[str]) -> np.ndarray:
        own = np.array([[int(c[2 * p : 2 * p + 2], 16) for p in range(PARTS)] for c in codes], np.int64).reshape(-1, PARTS)
        return np.concatenate([self.entries[p][own[:, p]] for p in range(PARTS)], 1)

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def fit(kept: DataFrame, order: str, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of a table of :func:`packed`; the first entries are the rows of the smallest ``order``.

    None for an empty table. All rows take part in every round; what comes to the driver are one row for each
    component of the codebooks.
    """
    width = kept.agg(F.max(F.octet_length("vector") / F.when(F.col("wide"), 8).otherwise(4))).collect()[0][0]
    if width is None:
        return None
    dim = -(-int(width) // PARTS) * PARTS
    first = kept.orderBy(F.col(order).asc_nulls_last(), "vector").limit(ENTRIES).select("vector", "wide").toArrow().to_batches()
    start = np.concatenate([_vectors(b, dim) for b in first])
    books = Codebooks(np.stack(np.split(start, PARTS, 1)), dim)
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast(books)

        def sums(batches, shared=shared):
            books = shared.value
            total = Sums(books.dim, books.entries.shape[1])
            for _, x in _blocks(batches, books.dim):
                own = books.assign(x)
                for p in range(PARTS):
                    total.add(p, x[:, p * books.size : (p + 1) * books.size], own[:, p])
            yield total.table()

        each = kept.select("vector", "wide").mapInArrow(sums, "part long, entry long, at long, high long, low long, n long")
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        moved = books.entries.copy()
        for r in each.groupBy("part", "entry", "at").agg(wide("high"), wide("low"), F.sum("n").alias("n")).collect():
            moved[r["part"], r["entry"], r["at"]] = ((int(r["high"]) << 32) + int(r["low"])) // r["n"]
        shared.unpersist()
        same, books = bool((moved == books.entries).all()), Codebooks(moved, dim)
        if same:  # later rounds would change nothing either
            break
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """The rows of :func:`packed` with ``code``, two hex digits a part, and ``error`` in place of the vector."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    rest = [c for c in kept.columns if c not in ("vector", "wide")]

    def run(batches):
        books = shared.value
        for batch, x in _blocks(batches, books.dim):
            own = books.assign(x)
            codes = [bytes(r).hex() for r in own.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(codes, pa.string()), pa.array(books.errors(x, own))], [*rest, "code", "error"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema if f.name in rest)
    return kept.mapInArrow(run, f"{fields}code string, error long")


def op11(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of ``rows`` that has a sound vector.

    Left out are rows whose vector is null or has a null or non-finite component. Vectors that are shorter than the
    longest one, or of a length that eight does not divide, count as if zeros followed; an empty vector is sound.
    Components and errors beyond 64 bits count as the least or largest of 64 bits. Rows that repeat a vec_id stay,
    each with its own code; of ties for the first sixteen the smaller packed vector comes first, and null vec_ids come
    last. With fewer than sixteen rows there are as many entries. An empty table has no rows; other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "codes")
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("_vector"))
    kept = scratch.keep(packed(vectors, "_vector"), "packed")
    books = fit(kept, "vec_id")
    if books is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = scratch.keep(encode(kept, books), "coded")
    scratch.drop(kept)
    capped = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    of_label = coded.groupBy(F.col("label").alias("_label")).agg(capped.alias("label_error"))
    out = coded.join(of_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books.text().encode()).hexdigest()).alias("codebooks_sha256"))
