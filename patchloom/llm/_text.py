"""Vectorised text primitives over Arrow string arrays.

Texts are handled as flat UTF-8 buffers in slices of about a quarter of a megabyte (one longer text makes a slice
of its own), so the memory that a task needs follows the longest text and not the batch or the partition. Inside a
long text bytes are judged and hashed in blocks: beside the text itself, its words' bounds and hashes are held, 24
bytes a word. Hashes are 64 bits wide and seeded; equal byte strings always get equal hashes on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 18
#: Bytes that are judged or hashed at once.
BLOCK = 1 << 18
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 3
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_UP = np.cumprod(np.concatenate([np.ones(1, U64), np.full(BLOCK - 1, _BASE, U64)]), dtype=U64)
_DOWN = np.cumprod(np.concatenate([np.ones(1, U64), np.full(BLOCK - 1, _BASE_INV, U64)]), dtype=U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split at ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words of ASCII letters, ASCII digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near inputs get far outputs."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _offsets(texts: pa.Array) -> np.ndarray:
    """The n + 1 places in the body where texts begin and end."""
    if not len(texts):
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    off, body = _offsets(texts).astype(np.int64), texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of at most ``limit`` bytes, or of one longer text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = _offsets(texts)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, int(off[a]) + limit, "right")) - 1)
        yield a, b, *buffers(texts.slice(a, b - a))
        a = b


@dataclass
class Words:
    """Words of a run of texts: ``start``/``end`` byte positions, ``first[d]:first[d + 1]`` the words of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _raw(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of each span inside one block, by differences of one prefix sum."""
    prefix = np.empty(len(data) + 1, U64)
    prefix[0] = 0
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=prefix[1:])
    return (prefix[end] - prefix[start]) * _DOWN[np.minimum(start, len(data) - 1)]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span. Spans are in order and do not overlap; powers start anew in every block."""
    raw, k = np.empty(len(start), U64), 0
    while k < len(start):
        a = int(start[k])
        stop = max(k + 1, int(np.searchsorted(end, a + BLOCK, "right")))
        b = int(end[stop - 1])
        if b - a <= BLOCK:
            raw[k:stop] = _raw(data[a:b], start[k:stop] - a, end[k:stop] - a)
        else:  # one span longer than a block: its pieces, moved to their places
            total = 0
            for c in range(a, b, BLOCK):
                piece = data[c : min(b, c + BLOCK)]
                total += int((_BYTE[piece] * _UP[: len(piece)]).sum(dtype=U64)) * pow(_BASE, c - a, 1 << 64)
            raw[k] = total & (1 << 64) - 1
        k = stop
    return mix(raw + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Split every text into maximal runs of ``kind`` bytes; A-Z become a-z first unless told otherwise."""
    if lower:
        data = LOWER[data]
    starts, ends, n, last = [], [], len(data), False
    for x in range(0, n, BLOCK):
        inside = kind[data[x : x + BLOCK]]
        before = np.concatenate([[last], inside[:-1]])
        apart = ~inside
        edges = off[np.searchsorted(off, x) : np.searchsorted(off, x + len(inside))] - x
        ends.append(np.flatnonzero(before & (apart | _at(edges, len(inside)))) + x)
        starts.append(np.flatnonzero(inside & (~before | _at(edges, len(inside)))) + x)
        last = bool(inside[-1])
    if last:
        ends.append(np.array([n]))
    start, end = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (starts, ends))
    return Words(data, start, end, np.searchsorted(start, off), span_hash(data, start, end))


def _at(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def _size(n: int) -> np.uint64:
    return U64(n * 0xD6E8FEB86659FD93 & 2**64 - 1)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of n words inside a text, in text order."""
    count = len(w.hash) - n + 1
    if count <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    raw = np.full(count, _size(n), U64)
    for k in range(n):
        raw += w.hash[k : k + count] * _GRAM[k]
    of = w.text_of
    whole = of[:count] == of[n - 1 :]
    return mix(raw[whole]), of[:count][whole]


def gram_hash(word_hashes: np.ndarray) -> np.uint64:
    """The hash that :func:`grams` gives a run of these words."""
    n = len(word_hashes)
    raw = np.full(1, _size(n), U64)
    for k in range(n):
        raw += word_hashes[k : k + 1] * _GRAM[k % 64]
    return mix(raw)[0]


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of distinct n-word shingles as sorted hashes: (all sets one after another, n + 1 offsets).

    A text of fewer words has its whole word sequence as its only shingle; one without words has an empty set.
    """
    w = words(data, off)
    h, of = grams(w, n)
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([gram_hash(w.hash[w.first[d] : w.first[d + 1]]) for d in short], U64)
        h, of = np.concatenate([h, extra]), np.concatenate([of, short])
        by_text = np.argsort(of, kind="stable")
        h, of = h[by_text], of[by_text]
    order = _sort_within(h, of, len(off) - 1)
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, np.searchsorted(of, np.arange(len(off)))


def _sort_within(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    bounds = np.searchsorted(of, np.arange(n + 1))
    order = np.empty(len(h), np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        order[a:b] = np.argsort(h[a:b]) + a
    return order


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def crc32(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())
