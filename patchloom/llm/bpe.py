"""Byte-pair encoding by speculation and verification, and decoding.

A greedy longest match proposes tokens for each new word. The proposal is the true encoding exactly if every
adjacent pair of its tokens encodes to itself, so all adjacent pairs of a slice are looked up at once in a
sorted table of judged pairs, new pairs are judged by merging the two tokens' bytes, and only words with a
failing pair go through exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import lean

#: Words kept encoded per worker before the table starts anew.
CACHE = 400_000
_SHIFT = 20
_ALONE = (1 << _SHIFT) - 1
_NEVER = 1 << 60
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
#: White space beyond the separator categories; the endings split from a word after an apostrophe.
_BLANKS = [9, 10, 11, 12, 13, 0x85]
_ENDINGS = {"one": "stmd", "two": ["re", "ve", "ll"]}


def _byte_letters() -> dict[str, int]:
    """The printable stand-in for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_BLANKS] = _SPACE
    return table


def split(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions (start, end) of the words of a byte-level vocabulary, text after text.

    A word is a run of letters, of numbers or of other characters with the one space before it, an apostrophe
    ending, or white space; of white space before another word the last character stands apart.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
    kind, n = classes[points], len(points)
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, off)] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # The last white space before a word of the same text stands apart, and a plain space joins that word.
    last = space.copy()
    last[-1] = False
    last[:-1] &= ~space[1:] & ~edge[1:n]
    begins |= last
    joins = np.flatnonzero(last & (points == 32)) + 1
    begins[joins] = False
    # An apostrophe that starts a word and is followed by one of the endings.
    quote = np.flatnonzero((points == 39) & begins)
    quote = quote[(quote + 1 < n)]
    quote = quote[~edge[quote + 1]]
    one = np.isin(points[quote + 1], [ord(c) for c in _ENDINGS["one"]])
    second = np.minimum(quote + 2, n - 1)
    two = np.zeros(len(quote), bool)
    for x, y in _ENDINGS["two"]:
        two |= (points[quote + 1] == ord(x)) & (points[second] == ord(y))
    two &= (quote + 2 < n) & ~edge[second]
    short, long = quote[one], quote[two]
    begins[np.concatenate([short, long]) + 1] = False
    after = np.concatenate([short + 2, long + 3])
    after = after[after < n]
    begins[after] = True
    start = np.flatnonzero(begins)
    return at[start], at[np.append(start[1:], n)]


class Bpe:
    """An encoder for the JSON ``source`` of a byte-level vocabulary."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, letters = spec["model"], _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.ids = {raw[t]: i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.rank: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            x, y = (raw[t] for t in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank.setdefault(self.ids[x] << _SHIFT | self.ids[y], k << _SHIFT | self.ids[x + y])
        self.classes = _classes()
        size = max(self.bytes) + 1
        self.byte_len = np.array([len(self.bytes.get(i, b"")) for i in range(size)], np.int64)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self.byte_flat = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)
        self.pair_keys, self.pair_holds = np.empty(0, np.int64), np.empty(0, bool)
        self.merged = 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.tokens, self.token_at, self.token_n = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def exact(self, word: bytes) -> list[int]:
        """Merge the best-ranked adjacent pair, leftmost first, until none is left."""
        at = [self.ids[word[k : k + 1]] for k in range(len(word))]
        if len(at) > 256:
            return self._exact_long(at)
        get = self.rank.get
        ranks = [get(x << _SHIFT | y, _NEVER) for x, y in zip(at, at[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            k = ranks.index(best)
            at[k] = best & _ALONE
            del at[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(at[k - 1] << _SHIFT | at[k], _NEVER)
            if k < len(ranks):
                ranks[k] = get(at[k] << _SHIFT | at[k + 1], _NEVER)
        return at

    def _exact_long(self, at: list[int]) -> list[int]:
        """The same in n log n: a heap of pairs over a linked list."""
        n, get = len(at), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, at[k], at[k + 1]) for k in range(n - 1) if (r := get(at[k] << _SHIFT | at[k + 1], _NEVER)) != _NEVER]
        heapq.heapify(heap)
        while heap:
            r, k, x, y = heapq.heappop(heap)
            j = after[k] if at[k] >= 0 else n
            if j >= n or at[k] != x or at[j] != y:
                continue
            at[k], at[j], after[k] = r & _ALONE, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (r := get(at[left] << _SHIFT | at[after[left]], _NEVER)) != _NEVER:
                    heapq.heappush(heap, (r, left, at[left], at[after[left]]))
        return [x for x in at if x >= 0]

    def propose(self, word: bytes) -> list[int]:
        found, k, n, get = [], 0, len(word), self.ids.get
        while k < n:
            end = min(n, k + self.longest)
            while (got := get(word[k:end])) is None:
                end -= 1
            found.append(got)
            k = end
        return found

    def _holds(self, keys: np.ndarray) -> np.ndarray:
        need = np.unique(keys)
        at = np.searchsorted(self.pair_keys, need)
        known = np.zeros(len(need), bool)
        inside = at < len(self.pair_keys)
        known[inside] = self.pair_keys[at[inside]] == need[inside]
        fresh = need[~known]
        if len(fresh):
            judged = np.array([self._judge(k >> _SHIFT, k & _ALONE) for k in fresh.tolist()], bool)
            if len(self.pair_keys) > 4 * CACHE:
                self.pair_keys, self.pair_holds = need[known], self.pair_holds[at[known]]
            every, holds = np.concatenate([self.pair_keys, fresh]), np.concatenate([self.pair_holds, judged])
            order = np.argsort(every, kind="stable")
            self.pair_keys, self.pair_holds = every[order], holds[order]
        return self.pair_holds[np.searchsorted(self.pair_keys, keys)]

    def _judge(self, a: int, b: int) -> bool:
        if b == _ALONE:
            return self.exact(self.bytes[a]) == [a]
        return self.exact(self.bytes[a] + self.bytes[b]) == [a, b]

    def learn(self, keys: list[int], words: list[bytes]) -> None:
        """Encode new words, known from now on by their keys."""
        found = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for p in found for t in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        after = np.empty(len(flat), np.int64)
        after[:-1] = flat[1:]
        after[ends - 1] = _ALONE
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = sizes == 1
        fits = np.ones(len(flat), bool)
        fits[inner] = self._holds((flat << _SHIFT | after)[inner])
        for k in np.flatnonzero(~np.logical_and.reduceat(fits, ends - sizes)).tolist():
            self.merged += 1
            found[k] = self.exact(words[k])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for p in found for t in p), np.int32, int(sizes.sum()))
        self.known.update(zip(keys, range(len(self.token_n), len(self.token_n) + len(keys)), strict=True))
        self.token_at = np.concatenate([self.token_at, len(self.tokens) + np.cumsum(sizes) - sizes])
        self.token_n, self.tokens = np.concatenate([self.token_n, sizes]), np.concatenate([self.tokens, flat])

    def _specials(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of special tokens inside texts, the leftmost and longest first."""
        raw, found, free = data.tobytes(), [], 0
        at = sorted((p, -len(t), t) for t in self.special for p in _places(raw, t.encode()))
        for p, _, t in at:
            end = p + len(t.encode())
            if p >= free and np.searchsorted(off, p, "right") == np.searchsorted(off, end, "left"):
                found.append((p, end, self.special[t]))
                free = end
        return found

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets) for a run of UTF-8 texts."""
        special = self._specials(data, off)
        cuts = np.unique(np.concatenate([off, *([s, e] for s, e, _ in special)])) if special else off
        start, end = split(data, cuts, self.classes)
        if special:
            first = np.array([s for s, _, _ in special])
            inside = np.searchsorted(first, start, "right") - 1
            within = (inside >= 0) & (start < np.array([e for _, e, _ in special])[inside])
            keep = ~within | np.isin(start, first)
            start, end = start[keep], end[keep]
        keys = X.span_hash(data, start, end)
        if special:
            at = np.searchsorted(start, first)
            keys[at] = 0
        own, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._forget()
        own = own.tolist()
        new = [k for k, key in enumerate(own) if key not in self.known]
        if new:
            self.learn([own[k] for k in new], [data[start[where[k]] : end[where[k]]].tobytes() for k in new])
        slot = np.fromiter((self.known[k] for k in own), np.int64, len(own))[which] if own else np.empty(0, np.int64)
        n = self.token_n[slot]
        ends = np.cumsum(n)
        ids = self.tokens[np.repeat(self.token_at[slot] - (ends - n), n) + np.arange(n.sum())]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, off)]
        if special:
            ids, bounds = self._place(ids, bounds, np.concatenate([[0], ends])[at], n[at], [i for _, _, i in special])
        return ids, bounds

    @staticmethod
    def _place(ids, bounds, at, n, special):
        """Put each special id where its stand-in word's tokens are."""
        keep = np.ones(len(ids), bool)
        for p, size, i in zip(at.tolist(), n.tolist(), special, strict=True):
            ids[p] = i
            keep[p + 1 : p + size] = False
        return ids[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The texts of runs of ids in UTF-8. Special tokens are kept; what is no UTF-8 becomes replacement characters."""
        n = self.byte_len[ids]
        ends = np.cumsum(n)
        flat = self.byte_flat[np.repeat(self.byte_at[ids] - (ends - n), n) + np.arange(n.sum())].tobytes()
        at = np.concatenate([[0], ends])[off].tolist()
        return [flat[a:b].decode("utf-8", "replace").encode() for a, b in zip(at, at[1:], strict=False)]


def _places(raw: bytes, what: bytes) -> list[int]:
    found, at = [], raw.find(what)
    while at >= 0:
        found.append(at)
        at = raw.find(what, at + 1)
    return found


_loaded: dict[str, Bpe] = {}


def _load(shared) -> Bpe:
    source = shared.value
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(source)
    return _loaded[key]


def _share(df: DataFrame, path: str):
    """The vocabulary (a fixed file of a few megabytes) for all executors, read on the driver."""
    lean(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _codec(shared, batches: Iterator[pa.RecordBatch], text_at: int, make) -> Iterator[pa.RecordBatch]:
    bpe = _load(shared)
    for batch in batches:
        for a, b, data, off in X.slices(batch.column(text_at)):
            yield make(bpe, batch.slice(a, b - a), *bpe.encode(data, off))


def _fields(df: DataFrame, into: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != into)


def encode(df: DataFrame, path: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``df`` with the token ids of its text column; a null text is an empty one and has an empty list."""
    shared, at = _share(df, path), df.columns.index(text)
    rest = [k for k, c in enumerate(df.columns) if c != into]
    names = [*(df.columns[k] for k in rest), into]

    def make(_, part, ids, off):
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), lists], names)

    return df.mapInArrow(lambda batches: _codec(shared, batches, at, make), f"{_fields(df, into)}`{into}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids; a null list is an empty one."""
    shared, at = _share(df, path), df.columns.index(ids)
    rest = [k for k, c in enumerate(df.columns) if c != into]
    names = [*(df.columns[k] for k in rest), into]

    def run(batches):
        bpe = _load(shared)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = [np.asarray(x.values, np.int64) if x.is_valid else np.empty(0, np.int64) for x in part.column(at)]
                off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                texts = [t.decode() for t in bpe.decode(np.concatenate(lists), off)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(texts, pa.string())], names)

    return df.mapInArrow(run, f"{_fields(df, into)}`{into}` string")


def op3(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``, which are encoded and decoded again.

    A null text is an empty one. Rows of any doc_id, null or repeated, stay; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = _share(docs, path)

    def make(bpe, part, ids, off):
        raw, at = ids.astype("<u4").tobytes(), (4 * off).tolist()
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        back = [hashlib.sha256(t).hexdigest() for t in bpe.decode(ids, off)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off), pa.int64()), pa.array(digests), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(lambda batches: _codec(shared, batches, 1, make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
