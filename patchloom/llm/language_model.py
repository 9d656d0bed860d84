"""A hierarchical Pitman-Yor language model of word pairs, its seating sampled by Gibbs.

Every word has a restaurant for the words that follow it, the start of a text has one too, and all of these have
the unigram restaurant as parent; every word is a dish. No word or pair is left out.

A cell is a pair (word before, word) with its customers and tables. Cells are dealt to parts: those of a rare word by
that word, other cells of a rare word before by that, and cells of two common words by the pair, so that a part has
all of a rare word and no part has a hot key. A part is one row of packed columns, and what is exchanged between
tasks are packed blocks of many pairs. A sweep draws the tables of every cell anew given all others (exactly for up
to EXACT customers, by weighted seatings in blocks beyond; a cell of one customer has one table whatever happens), then those
of the parent restaurant. Probabilities are averages over the later sweeps.

What is broadcast has a fixed size: counts, tables and probabilities of the COMMON words of the highest counts, and
the pairs of the highest counts, which only saves exchanging them. Discounts are estimated, of each common context
and of all rare ones together; the strength is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import Scratch
from .features import remainder

#: Words, and pairs, that are broadcast, at most.
COMMON, PAIRS = 1 << 18, 1 << 21
SWEEPS, BURN_IN = 4, 2
KEPT = SWEEPS - BURN_IN
#: Customers up to which a cell's number of tables is drawn from its exact distribution.
EXACT = 64
#: Seatings drawn for a cell of more, of which one is taken by its weight.
DRAWS = 4
STRENGTH = 1.0
#: Tokens of a part, about, and parts that one task deals blocks to; more parts are dealt in several steps.
PART, FAN = 1 << 20, 1024
#: Parts that a further step makes of one, at least.
LEAST = 4
#: Words are known by their place among the common ones, or else by their hash as a signed number.
END, START = COMMON, COMMON + 1
_IDS = COMMON + 2
#: The hash that stands for the end of a text among word hashes.
END_HASH = np.uint64(0x0E4D0E4D0E4D0E4D)
_FLUSH = 1 << 20


def _held_out():
    return remainder(F.col("doc_id"), 7) == 2


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    flat = flat.reshape(len(kinds), 8, len(flat) // (8 * len(kinds)))
    return [np.ascontiguousarray(flat[k].T).reshape(-1).view(kind) for k, kind in enumerate(kinds)]


_I, _F = np.int64, np.float64


class _Tally:
    """Sums by key that never hold much more than ``_FLUSH`` keys."""

    def __init__(self):
        self.keys, self.sums, self.parts, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)

    def fold(self) -> None:
        keys = np.concatenate([self.keys, *(p[0] for p in self.parts)])
        n = np.concatenate([self.sums, *(p[1] for p in self.parts)])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.sums = np.bincount(at, n, len(self.keys)).astype(np.int64)
        self.parts, self.size = [], 0

    def full(self) -> bool:
        if self.size > _FLUSH:
            self.fold()
        return len(self.keys) > _FLUSH

    def taken(self) -> pa.RecordBatch:
        self.fold()
        out = pa.RecordBatch.from_arrays([pa.array(X.signed(self.keys)), pa.array(self.sums)], ["k", "n"])
        self.keys, self.sums = np.empty(0, np.uint64), np.empty(0, np.int64)
        return out


def _tallied(batches: Iterator[pa.RecordBatch], keys) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        for _, _, data, off in X.slices(batch.column(0)):
            tally.add(*np.unique(keys(data, off), return_counts=True))
            if tally.full():
                yield tally.taken()
    yield tally.taken()


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets) of each text's words and one end after them."""
    w = X.words(data, off)
    n = len(off) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(first[-1], END_HASH, np.uint64)
    mask = np.ones(len(out), bool)
    mask[first[1:] - 1] = False
    out[mask] = w.hash
    return out, first


class Slots:
    """A sorted table of evenly spread 64-bit keys, searched by their leading bits: one look, and seldom a second."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    @cached_property
    def _first(self) -> tuple[np.uint64, np.ndarray]:
        """Shift, and where the keys of each slot begin; made in each worker, not sent."""
        bits = len(self.keys).bit_length() + 1
        shift = np.uint64(64 - bits)
        return shift, np.searchsorted(self.keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each hash."""
        if not len(self.keys):
            return np.zeros(len(h), _I), np.zeros(len(h), bool)
        shift, first = self._first
        slot = (h >> shift).astype(_I)
        at, end = first[slot].astype(_I), first[slot + 1]
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == h
        rest = np.flatnonzero(~found & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            hit = self.keys[at[rest]] == h[rest]
            found[rest[hit]] = True
            rest = rest[~hit]
            rest = rest[at[rest] + 1 < end[rest]]
        return np.minimum(at, len(self.keys) - 1), found

    def __getstate__(self):
        return {"keys": self.keys}


class Common:
    """The words that every task knows, sorted by hash, with their counts."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        order = np.argsort(words)
        self.words, self.n = words[order], n[order]
        self.slots = Slots(self.words)

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word before, word) of each token, and the n + 1 offsets of the texts' tokens."""
        h, first = tokens(data, off)
        w = X.signed(h).copy()
        at, found = self.slots.find(h)
        w = np.where(found, at, w)
        w[h == END_HASH] = END
        u = np.empty_like(w)
        u[1:] = w[:-1]
        u[first[:-1]] = START
        return u, w, first


def _log_gamma(x: np.ndarray) -> np.ndarray:
    low = sum(np.log(x + k) for k in range(6))
    x = x + 6
    return (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, k: int) -> np.ndarray:
    """A number in (0, 1) for each key; rows keep theirs in whatever order and task they come."""
    return ((_mixed(key + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def seat(n: np.ndarray, d: np.ndarray, a: np.ndarray, step: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(tables, log weight) of ``n`` customers of a dish, more than EXACT, that sit down one after another.

    Beside t tables and i customers of the dish a new table weighs a + step * t and the old ones i - d * t. The
    first EXACT customers are seated one by one, the others in blocks of an eighth of those seated: a block opens as
    many tables as a Poisson draw says, at the rate that holds when it begins. The weight is that of the dish itself
    along the way.
    """
    order = np.argsort(-n, kind="stable")
    n, d, a, step = n[order].astype(float), d[order], a[order], step[order]
    t, log = np.ones(len(n)), np.zeros(len(n))
    for i in range(1, EXACT):
        new = a + step * t
        total = new + i - d * t
        log += np.log(total)
        t += rng.random(len(n)) * total < new
    i, live = float(EXACT), len(n)
    while live:
        to = np.minimum(n[:live], np.ceil(i * 1.125))
        new, c = a[:live] + step[:live] * t[:live], a[:live] - (d[:live] - step[:live]) * t[:live]
        opened = np.minimum(rng.poisson(new * np.log((to + c) / (i + c))), to - i)
        c -= (d[:live] - step[:live]) * opened / 2
        log[:live] += _log_gamma(to + c) - _log_gamma(i + c)
        t[:live] += opened
        i = float(np.ceil(i * 1.125))
        live = int(np.searchsorted(-n, -i, "left"))
    out, weight = np.empty(len(n)), np.empty(len(n))
    out[order], weight[order] = t, log
    return out, weight


def _exact_tables(n: int, d: np.ndarray, a: np.ndarray, step: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers of tables of cells of ``n`` customers each, from their distribution given all other cells.

    The weight of t tables sums over all ways to sit: beside t tables and i customers of the dish a new table weighs
    a + step * t and the old ones i - d * t.
    """
    f = np.zeros((n + 1, len(d)))
    f[1] = 1
    for i in range(1, n):
        t = np.arange(1, i + 1)[:, None]
        opened = f[1 : i + 1] * (a + step * t)
        f[1 : i + 1] *= i - d * t
        f[2 : i + 2] += opened
        if i % 8 == 0:
            f /= f.max(0)
    upto = np.cumsum(f[1:], axis=0)
    return 1 + (upto < u * upto[-1]).sum(0)


def tables(n: np.ndarray, d: np.ndarray, a: np.ndarray, step: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Numbers of tables of cells of any numbers of customers; none for none."""
    out = np.minimum(n, 1).astype(np.int64)
    order = np.argsort(n, kind="stable")
    bounds = np.searchsorted(n[order], np.arange(2, EXACT + 2))
    for m, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), 2):
        for k in range(x, y, 1 << 14):
            at = order[k : min(y, k + (1 << 14))]
            out[at] = _exact_tables(m, d[at], a[at], step[at], _uniform(key[at], 0))
    many = order[bounds[-1] :]
    if len(many):
        each = np.repeat(many, DRAWS)
        # Cells of a part always come in the same order: a task that runs again draws the same.
        rng = np.random.default_rng(int(np.bitwise_xor.reduce(key[many])))
        t, log = seat(n[each], d[each], a[each], step[each], rng)
        best = np.argmax((log + rng.gumbel(size=len(log))).reshape(-1, DRAWS), 1)
        out[many] = t.reshape(-1, DRAWS)[np.arange(len(many)), best]
    return out


class Seating:
    """Tables of one restaurant: ``dish`` (index into the dishes served) and ``size``, sorted by dish.

    The process customer by customer, by which the tests judge :func:`tables`.
    """

    def __init__(self, counts: np.ndarray, discount: float, prior: np.ndarray, rng: np.random.Generator):
        self.counts, self.d, self.rng = counts.astype(np.int64), discount, rng
        self.dish, self.size = np.arange(len(counts)), np.minimum(self.counts, 1)
        for k in range(1, int(self.counts.max(initial=0))):
            self._seat(np.flatnonzero(self.counts > k), prior)
        kept = self.size > 0
        self.dish, self.size = self.dish[kept], self.size[kept]

    def tables(self) -> np.ndarray:
        return np.bincount(self.dish, minlength=len(self.counts))

    def _pick(self, weights: np.ndarray, who: np.ndarray) -> np.ndarray:
        """A table of each dish in ``who``, drawn in proportion to the weights."""
        total = np.concatenate([[0.0], np.cumsum(weights)])
        first, last = np.searchsorted(self.dish, who), np.searchsorted(self.dish, who, "right")
        at = total[first] + self.rng.random(len(who)) * (total[last] - total[first])
        return np.clip(np.searchsorted(total, at, "right") - 1, first, last - 1)

    def _seat(self, who: np.ndarray, prior: np.ndarray) -> None:
        """One more customer for each dish in ``who``."""
        t = self.tables()
        held = np.bincount(self.dish, self.size, len(self.counts))
        old = np.maximum(held[who] - self.d * t[who], 0)
        new = (STRENGTH + self.d * len(self.dish)) * prior[who]
        joins = (self.rng.random(len(who)) * (old + new) < old) & (t[who] > 0)
        if joins.any():
            self.size[self._pick(np.maximum(self.size - self.d, 0), who[joins])] += 1
        fresh = who[~joins]
        at = np.searchsorted(self.dish, fresh, "right")
        self.dish, self.size = np.insert(self.dish, at, fresh), np.insert(self.size, at, 1)

    def sweep(self, prior: np.ndarray) -> None:
        """Take as many random customers of every dish as it has from their tables and seat them anew."""
        for k in range(int(self.counts.max(initial=0))):
            who = np.flatnonzero(self.counts > k)
            self.size[self._pick(self.size.astype(float), who)] -= 1
            kept = self.size > 0
            self.dish, self.size = self.dish[kept], self.size[kept]
            self._seat(who, prior)


def _common(ids: np.ndarray) -> np.ndarray:
    return (ids >= 0) & (ids < _IDS)


def distinct(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, in order, with their summed counts."""
    both = _common(u) & _common(w)
    code = u[both] * _IDS + w[both]
    order = np.argsort(code)
    code, m = code[order], n[both][order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
    out = [(code[at] // _IDS, code[at] % _IDS, np.add.reduceat(m, at) if len(at) else m)]
    a, b, m = u[~both], w[~both], n[~both]
    order = np.lexsort((b, a))
    a, b, m = a[order], b[order], m[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    out.append((a[at], b[at], np.add.reduceat(m, at) if len(at) else m))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _code(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit number for each pair."""
    return X.mix(X.mix(u.astype(_I).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + w.astype(_I).view(np.uint64))


def part_of(u: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair: by the rare word, else by the rare word before, else by both."""
    alone = X.mix(np.where(_common(w), u, w).astype(_I).view(np.uint64))
    return (np.where(_common(u) & _common(w), _code(u, w), alone) % np.uint64(parts)).astype(_I)


def _dealt(part: np.ndarray, fan: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A block for each of the parts modulo ``fan``, in which rows keep their order."""
    to = part % fan
    order = np.argsort(to.astype(np.int16) if fan < 1 << 15 else to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(fan + 1))
    some = np.flatnonzero(np.diff(bounds))
    blocks = [pack(*(c[order[bounds[k] : bounds[k + 1]]] for c in columns)) for k in some]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(_I)), pa.array(blocks, pa.binary())], ["part", "block"])


def _regrouped(kinds: tuple, parts: int, fan: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a coarser dealing, dealt anew to more parts."""
    held, size = [], 0

    def dealt():
        columns = [np.concatenate([h[k] for h in held]) for k in range(len(kinds))]
        part = part_of(columns[0], columns[1], parts)
        for own in np.unique(part % (fan // FAN)):
            mine = part % (fan // FAN) == own
            batch = _dealt(part[mine], fan, *(c[mine] for c in columns))
            yield batch

    for batch in batches:
        for raw in batch.column("block"):
            held.append(unpack(raw.as_buffer(), *kinds))
            size += len(held[-1][0])
            if size > _FLUSH:
                yield from dealt()
                held, size = [], 0
    if size:
        yield from dealt()


def exchanged(blocks: DataFrame, kinds: tuple, parts: int) -> DataFrame:
    """(part, block) dealt to ``parts`` parts, of blocks dealt to at most FAN; each step multiplies the parts by FAN at most."""
    fan = min(parts, FAN)
    while fan < parts:
        fan = step = min(parts, fan * FAN)
        blocks = blocks.repartition("part").mapInArrow(lambda b, step=step: _regrouped(kinds, step, step, b), "part long, block binary")
    return blocks


def parts_for(tokens: int) -> int:
    """Parts of about PART tokens: any number up to FAN; beyond, a multiple of what one step less deals to, so that a
    part of a step is dealt on whole. Another step makes LEAST parts of one at least."""
    wanted, parts = max(1, -(-tokens // PART)), FAN
    if wanted <= FAN:
        return wanted
    while parts * FAN < wanted:
        parts *= FAN
    return parts * max(LEAST, -(-wanted // parts))


def _paired(common: Common, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def blocks() -> pa.RecordBatch:
        u, w = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        u, w, n = distinct(u, w, np.ones(len(u), _I))
        return _dealt(part_of(u, w, parts), min(parts, FAN), u, w, n)

    for batch in batches:
        for _, _, data, off in X.slices(batch.column(0)):
            held.append(common.ids(data, off)[:2])
            size += len(held[-1][0])
            if size > _FLUSH:
                yield blocks()
                held, size = [], 0
    if size:
        yield blocks()


CELLS = "part long, ones binary, many binary, rare binary"
#: many: u, w, n, t, s (tables summed over the samples), more (cells of one customer that a rare u has in the part).
_MANY = (_I, _I, _I, _I, _I, _I)
#: rare: w, once, root tables, and for each sample customers and tables of the root.
_RARE = (_I,) * (3 + 2 * KEPT)


def gather(table: pa.Table) -> pa.Table:
    """The cells of one part, of all its blocks: those of one customer apart from the others."""
    blocks = [unpack(raw.as_buffer(), _I, _I, _I) for chunk in table["block"].chunks for raw in chunk]
    u, w, n = distinct(*(np.concatenate([b[k] for b in blocks]) for k in range(3)))
    one = n == 1
    keys, more = np.unique(u[one & ~_common(u) & _common(w)], return_counts=True)
    um, wm = u[~one], w[~one]
    at = np.minimum(np.searchsorted(keys, um), max(len(keys) - 1, 0))
    extra = np.where(~_common(um) & (keys[at] == um), more[at], 0) if len(keys) else np.zeros(len(um), _I)
    rare = np.unique(w[~_common(w)])
    once = np.bincount(np.searchsorted(rare, w[one & ~_common(w)]), minlength=len(rare)).astype(_I)
    zero = np.zeros(len(rare), _I)
    many = pack(um, wm, n[~one], np.ones(len(um), _I), np.zeros(len(um), _I), extra)
    return pa.table({"part": table["part"].slice(0, 1), "ones": pa.array([pack(u[one], w[one])], pa.binary()), "many": pa.array([many], pa.binary()), "rare": pa.array([pack(rare, once, np.ones(len(rare), _I), *[zero] * (2 * KEPT))], pa.binary())})


def _totals(columns: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for the common words over all parts of a task: (id, kind, n); kinds count from 0, contexts before words.

    ``columns`` of cells: "begin" customers, cells of one and of two customers of each context, and cells of one of
    each word; "t" tables of each context and word. Rare contexts together are id -1; rare words together id -2: customers and
    tables of the root, words of one customer and of two.
    """
    kinds = 4 if columns == ("begin",) else 2
    sums = np.zeros((kinds, _IDS))
    other = np.zeros(4)
    root = np.zeros(4)
    for batch in batches:
        for k in range(batch.num_rows):
            u, w, n, t, _, _ = unpack(batch.column("many")[k].as_buffer(), *_MANY)
            hot, dish = _common(u), _common(w)
            if kinds == 4:
                a, b = unpack(batch.column("ones")[k].as_buffer(), _I, _I)
                one = np.bincount(a[_common(a)], minlength=_IDS)
                sums[0] += one + np.bincount(u[hot], n[hot], _IDS)
                sums[1] += one
                sums[2] += np.bincount(u[hot], n[hot] == 2, _IDS)
                sums[3] += np.bincount(b[_common(b)], minlength=_IDS)
                other += [0, len(a) - _common(a).sum(), (n[~hot] == 2).sum(), 0]
            else:
                sums[0] += np.bincount(u[hot], t[hot], _IDS)
                sums[1] += np.bincount(w[dish], t[dish], _IDS)
                rw, once, rt = unpack(batch.column("rare")[k].as_buffer(), *_RARE)[:3]
                each = once + np.bincount(np.searchsorted(rw, w[~dish]), t[~dish], len(rw)).astype(_I)
                root += [each.sum(), rt.sum(), (each == 1).sum(), (each == 2).sum()]
    kind, at = np.nonzero(sums)
    rows = [at, kind, sums[kind, at].astype(_I)]
    if kinds == 4:
        rows = [np.concatenate([r, x]) for r, x in zip(rows, ([-1] * 4, range(4), other), strict=True)]
    else:
        rows = [np.concatenate([r, x]) for r, x in zip(rows, ([-2] * 4, range(4), root), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(r.astype(_I)) for r in rows], ["id", "kind", "n"])


def _summed(cells: DataFrame, columns: tuple, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, _IDS) sums of the common words, and those of the rare ones together; of a fixed size."""
    used = cells.select("ones", "many") if columns == ("begin",) else cells.select("many", "rare")
    rows = used.mapInArrow(lambda b: _totals(columns, b), "id long, kind long, n long").groupBy("id", "kind").agg(F.sum("n").alias("n")).toArrow()
    at, kind, n = (np.asarray(rows[c], _I) for c in ("id", "kind", "n"))
    out, rest = np.zeros((kinds, _IDS)), np.zeros(4)
    out[kind[at >= 0], at[at >= 0]] = n[at >= 0]
    rest[kind[at < 0]] = n[at < 0]
    return out, rest


def _discount(once, twice):
    return np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.9)


def reseat(sweep: int, shared: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables of all cells of each part drawn anew, then the root's tables of the part's rare words."""
    rest = STRENGTH + shared["customers"]
    for batch in batches:
        for k in range(batch.num_rows):
            u, w, n, t, s, more = unpack(batch.column("many")[k].as_buffer(), *_MANY)
            rare = unpack(batch.column("rare")[k].as_buffer(), *_RARE)
            rw, once, rt = rare[:3]
            hot, dish = _common(u), _common(w)
            new = (STRENGTH + shared["d0"] * shared["root"]) * shared["base"]
            p = np.empty(len(w))
            p[dish] = shared["p"][w[dish]]
            at = np.searchsorted(rw, w[~dish])
            served = once + np.bincount(at, t[~dish], len(rw)).astype(_I)
            p[~dish] = ((served - shared["d0"] * rt + new) / rest)[at]
            d, tables_of = np.full(len(u), shared["d_rare"]), np.empty(len(u))
            d[hot], tables_of[hot] = shared["d"][u[hot]], shared["t"][u[hot]]
            keys, back = np.unique(u[~hot], return_inverse=True)
            tables_of[~hot] = more[~hot] + np.bincount(back, t[~hot], len(keys))[back]
            key = X.mix(_code(u, w) + np.uint64(sweep))
            t = tables(n, d, (STRENGTH + d * np.maximum(tables_of - t, 0)) * p, d * p, key)
            served = once + np.bincount(at, t[~dish], len(rw)).astype(_I)
            d0 = np.full(len(rw), shared["d0"])
            rt = tables(served, d0, (STRENGTH + d0 * (shared["root"] - rt)) * shared["base"], d0 * shared["base"], X.mix(rw.view(np.uint64) ^ np.uint64(sweep + 77)))
            rare[2] = rt
            if sweep >= BURN_IN:
                s = s + t
                rare[3 + 2 * (sweep - BURN_IN)], rare[4 + 2 * (sweep - BURN_IN)] = served, rt
            yield pa.RecordBatch.from_arrays(
                [batch.column("part").slice(k, 1), batch.column("ones").slice(k, 1), pa.array([pack(u, w, n, t, s, more)], pa.binary()), pa.array([pack(*rare)], pa.binary())], ["part", "ones", "many", "rare"]
            )


def _at_most(levels: list[tuple[int, int]], most: int) -> int | None:
    """The least level from which on no more than ``most`` rows remain; ``levels`` are (level, rows)."""
    cut, held = None, 0
    for at, rows in sorted(levels, reverse=True):
        held += rows
        if held > most:
            break
        cut = at
    return cut


def _level(n):
    """The sixteenth of a doubling that a count lies in."""
    return np.floor(np.log2(n) * 16 + 1e-9).astype(_I)


class Model:
    """The cells of all parts after the last sweep, and the arrays of the common words that are broadcast."""

    def __init__(self, scratch: Scratch, cells: DataFrame, n_words: int):
        context = cells.sparkSession.sparkContext
        base = 1 / (n_words + 1)
        (c, once, twice, alone), rest = _summed(cells, ("begin",), 4)
        d, d_rare = _discount(once, twice), float(_discount(rest[1], rest[2]))
        (more, served), rare = _summed(cells, ("t",), 2)
        root = np.where(alone + served > 0, 1, 0)
        self.t, self.p, self.unknown = [], [], []
        for sweep in range(SWEEPS):
            n = alone + served
            some = np.flatnonzero(n)
            d0 = float(_discount((n == 1).sum() + rare[2], (n == 2).sum() + rare[3]))
            customers, in_root = float(n.sum() + rare[0]), float(root.sum() + rare[1])
            p = (n - d0 * root + (STRENGTH + d0 * in_root) * base) / (STRENGTH + customers)
            shared = context.broadcast({"p": p, "d": d, "t": once + more, "d_rare": d_rare, "d0": d0, "root": in_root, "customers": customers, "base": base})
            cells, old = scratch.keep(cells.mapInArrow(lambda b, sweep=sweep, shared=shared: reseat(sweep, shared.value, b), CELLS), "cells"), cells
            scratch.drop(old)
            (more, served), rare = _summed(cells, ("t",), 2)
            n, each = alone + served, np.full(len(some), d0)
            a = (STRENGTH + d0 * (in_root - root[some])) * base
            root[some] = tables(n[some].astype(_I), each, a, each * base, X.mix(some.astype(np.uint64) ^ np.uint64(sweep + 77)))
            if sweep >= BURN_IN:
                new = (STRENGTH + d0 * (root.sum() + rare[1])) * base / (STRENGTH + n.sum() + rare[0])
                self.p.append((n - d0 * root) / (STRENGTH + n.sum() + rare[0]) + new)
                self.unknown.append((new, d0, float(STRENGTH + n.sum() + rare[0])))
                self.t.append(once + more)
        self.cells, self.c, self.d, self.d_rare = cells, c, d, d_rare


def _log(c, d, n, s, t: list, p: list) -> np.ndarray:
    back = sum((STRENGTH + d * tk) * pk for tk, pk in zip(t, p, strict=True)) / KEPT
    return np.log10((n - d * s / KEPT + back) / (STRENGTH + c))


def _served(n: np.ndarray, t: np.ndarray, d: float, prior: np.ndarray) -> np.ndarray:
    """Predictive probabilities of all dishes, given customers and tables."""
    if not n.sum():
        return prior
    return (n - d * t + (STRENGTH + d * t.sum()) * prior) / (STRENGTH + n.sum())


def _frequent(model: Model, arrays) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, log10 probabilities) of the pairs of common words of the highest counts, PAIRS at most.

    ``arrays`` is a broadcast of :meth:`Learnt.arrays`: tasks compute what the driver only sorts, 16 bytes a pair.
    """

    def levels(batches):
        count = np.zeros(1200, _I)
        for batch in batches:
            for raw in batch.column(0):
                u, w, n = unpack(raw.as_buffer(), *_MANY)[:3]
                both = _common(u) & _common(w)
                count += np.bincount(_level(n[both]), minlength=1200)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["at", "rows"])

    found = model.cells.select("many").mapInArrow(levels, "at long, rows long").groupBy("at").agg(F.sum("rows").alias("rows")).collect()
    cut = _at_most([(r["at"], r["rows"]) for r in found], PAIRS)
    if cut is None:
        return np.empty(0, np.uint64), np.empty(0)

    def chosen(batches):
        m = arrays.value
        for batch in batches:
            for raw in batch.column(0):
                u, w, n, _, s, _ = unpack(raw.as_buffer(), *_MANY)
                keep = _common(u) & _common(w) & (_level(n) >= cut)
                u, w, n, s = (x[keep] for x in (u, w, n, s))
                log = _log(m["c"][u], m["d"][u], n, s, [t[u] for t in m["t"]], [p[w] for p in m["p"]])
                code = X.mix((u * _IDS + w).view(np.uint64))  # a bijection: pairs stay apart
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(code)), pa.array(log)], ["code", "log"])

    rows = model.cells.select("many").mapInArrow(chosen, "code long, log double").toArrow()
    code = np.asarray(rows["code"], _I).view(np.uint64)
    order = np.argsort(code)
    return code[order], np.asarray(rows["log"], _F)[order]


LOOKED_UP = "row long, log float, base float, known long, u long, x float, p float"


def look_up(shared: dict, cells: pa.Table, tokens_: pa.Table) -> pa.Table:
    """The tokens of one part held against its cells: sums by row, and tokens after a rare word with what is known
    of them here (x: customers less discounts, p: the parent's probability)."""
    blocks = [unpack(raw.as_buffer(), _I, _I, _I) for chunk in tokens_["block"].chunks for raw in chunk]
    u, w, row = (np.concatenate([b[k] for b in blocks]) if blocks else np.empty(0, _I) for k in range(3))
    if not len(u):
        return pa.table({f.name: pa.array([], f.type) for f in _LOOKED_UP})
    n, s, count = np.zeros(len(u)), np.zeros(len(u)), np.zeros(len(u))
    dish = _common(w)
    p = [np.where(dish, pk[np.where(dish, w, 0)], shared["unknown"][k][0]) for k, pk in enumerate(shared["p"])]
    if cells.num_rows:
        a1, b1 = unpack(cells["ones"][0].as_buffer(), _I, _I)
        a2, b2, n2, _, s2, _ = unpack(cells["many"][0].as_buffer(), *_MANY)
        rare = unpack(cells["rare"][0].as_buffer(), *_RARE)
        keys = np.concatenate([_code(a1, b1), _code(a2, b2)])
        order = np.argsort(keys)
        keys, customers, seated = keys[order], np.concatenate([np.ones(len(a1)), n2])[order], np.concatenate([np.full(len(a1), KEPT), s2])[order]
        code = _code(u, w)
        at = np.minimum(np.searchsorted(keys, code), max(len(keys) - 1, 0))
        if len(keys):
            found = keys[at] == code
            n, s = np.where(found, customers[at], 0), np.where(found, seated[at], 0)
        rw = rare[0]
        if len(rw):
            each = rare[1] + np.bincount(np.searchsorted(rw, b2[~_common(b2)]), n2[~_common(b2)], len(rw))
            at = np.minimum(np.searchsorted(rw, w), len(rw) - 1)
            known = ~dish & (rw[at] == w)
            count = np.where(known, each[at], 0)
            for k, (new, d0, total) in enumerate(shared["unknown"]):
                p[k] = np.where(known, (rare[3 + 2 * k] - d0 * rare[4 + 2 * k])[at] / total + new, p[k])
    hot = _common(u)
    at = np.where(hot, u, 0)
    log = np.where(hot, _log(shared["c"][at], shared["d"][at], n, s, [t[at] for t in shared["t"]], p), 0)
    rows, back = np.unique(row, return_inverse=True)
    add = lambda x: np.bincount(back, x, len(rows))
    cold = np.flatnonzero(~hot)
    none, real = pa.nulls, lambda x: pa.array(x.astype(np.float32))
    sums = [pa.array(rows), real(add(log)), real(add(np.where(dish, 0, np.log10(count + 1)))), pa.array(add(~dish & (count > 0)).astype(_I)), none(len(rows), pa.int64()), none(len(rows), pa.float32()), none(len(rows), pa.float32())]
    mean = sum(p) / KEPT
    cold_rows = [pa.array(row[cold]), none(len(cold), pa.float32()), none(len(cold), pa.float32()), none(len(cold), pa.int64()), pa.array(u[cold]), real((n - shared["d_rare"] * s / KEPT)[cold]), real(mean[cold])]
    return pa.table([pa.concat_arrays([x, y]) for x, y in zip(sums, cold_rows, strict=True)], schema=_LOOKED_UP)


#: Sums of a part in single precision: they are many and each is added up in double precision afterwards.
_LOOKED_UP = pa.schema([("row", pa.int64()), ("log", pa.float32()), ("base", pa.float32()), ("known", pa.int64()), ("u", pa.int64()), ("x", pa.float32()), ("p", pa.float32())])


def _rare_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, c, s): customers and summed tables that each rare context has in a part."""
    for batch in batches:
        for k in range(batch.num_rows):
            a, _ = unpack(batch.column("ones")[k].as_buffer(), _I, _I)
            u, _, n, _, s, _ = unpack(batch.column("many")[k].as_buffer(), *_MANY)
            a, rare = a[~_common(a)], ~_common(u)
            keys, back = np.unique(np.concatenate([a, u[rare]]), return_inverse=True)
            sums = [np.bincount(back, np.concatenate([np.full(len(a), one), x[rare]]), len(keys)).astype(_I) for one, x in ((1, n), (KEPT, s))]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], ["u", "c", "s"])


SCORED = "doc_id long, row long, n_tokens long, n_known long, base double, model double, part long, block binary"


def _score(shared: dict, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with the sums of what is broadcast, and blocks (u, w, row) of the other tokens."""
    common, codes, logs, log_n, n_end = (shared[k] for k in ("common", "codes", "logs", "log_n", "n_end"))
    seen, held, size = TaskContext.get().partitionId() << 40, [], 0

    def blocks() -> pa.RecordBatch:
        u, w, row = (np.concatenate([h[k] for h in held]) for k in range(3))
        out = _dealt(part_of(u, w, parts), min(parts, FAN), u, w, row)
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([*(pa.nulls(out.num_rows, k) for k in kinds), *out.columns], _SCORED)

    for batch in batches:
        for a, b, data, off in X.slices(batch.column(1)):
            u, w, first = common.ids(data, off)
            of = np.repeat(np.arange(b - a), np.diff(first))
            near, hot = _common(w), _common(u)
            both = np.flatnonzero(near & hot)
            at, hit = codes.find(X.mix((u[both] * _IDS + w[both]).view(np.uint64)))
            value, found = np.zeros(len(w)), np.zeros(len(w), bool)
            value[both[hit]], found[both[hit]] = logs[at[hit]], True
            base, known = np.where(near, log_n[np.where(near, w, 0)], 0), near & ((w != END) | (n_end > 0))
            add = lambda x: pa.array(np.bincount(of, x, b - a))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), pa.array(seen + np.arange(b - a)), pa.array(np.diff(first), pa.int64()), pa.array(np.bincount(of, known, b - a).astype(_I)),
                    add(base), add(value), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.binary()),
                ],
                _SCORED,
            )
            held.append((u[~found], w[~found], seen + of[~found]))
            size += len(held[-1][0])
            seen += b - a
            if size > _FLUSH:
                yield blocks()
                held, size = [], 0
    if size:
        yield blocks()


_SCORED = ["doc_id", "row", "n_tokens", "n_known", "base", "model", "part", "block"]


class Learnt:
    """What is learnt of the texts of ``train``: word counts, common words and the model's cells."""

    def __init__(self, train: DataFrame, scratch: Scratch, most: int = COMMON):
        counts = train.mapInArrow(lambda b: _tallied(b, lambda data, off: tokens(data, off)[0]), "k long, n long")
        counts = scratch.keep(counts.groupBy("k").agg(F.sum("n").alias("n")), "counts")
        end = X.signed(np.array([END_HASH], np.uint64))[0].item()
        level = F.floor(F.log2(F.col("n").cast("double")) * 16 + 1e-9).cast("int")
        # At most 1,100 rows.
        levels = counts.groupBy(level.alias("at")).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
        self.tokens, self.words = sum(r["n"] for r in levels), sum(r["rows"] for r in levels)
        cut = _at_most([(r["at"], r["rows"]) for r in levels], most)
        top = counts.where(F.lit(False) if cut is None else (level >= cut) & (F.col("k") != end)).toArrow()
        self.common = Common(np.asarray(top["k"], _I).view(np.uint64), np.asarray(top["n"], _I))
        ends = counts.where(F.col("k") == end).select("n").collect()
        self.ends = ends[0]["n"] if ends else 0
        scratch.drop(counts)
        self.parts = parts = parts_for(self.tokens)
        words = train.sparkSession.sparkContext.broadcast(self.common)
        blocks = exchanged(train.mapInArrow(lambda b: _paired(words.value, parts, b), "part long, block binary"), (_I, _I, _I), parts)
        self.model = Model(scratch, scratch.keep(blocks.groupBy("part").applyInArrow(gather, CELLS), "cells"), self.words)

    def arrays(self) -> dict:
        m = self.model
        return {"c": m.c, "d": m.d, "t": m.t, "p": m.p, "unknown": m.unknown, "d_rare": m.d_rare}


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Learns from all rows that are not held out. ``base_score`` is the add-one unigram's log10 probability and
    ``score`` the model's. A null text is an empty one: its only token is the end. Without training rows every
    word is unknown. Rows that repeat a doc_id are texts of their own; other columns are not read; among words of
    equal counts the broadcast takes all of a level or none.
    """
    scratch = Scratch(docs.sparkSession, "language-model")
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learnt = Learnt(docs.where(~_held_out()).select("text"), scratch)
    model, parts, n_all = learnt.model, learnt.parts, learnt.tokens
    arrays = context.broadcast(learnt.arrays())
    codes, logs = _frequent(model, arrays)
    log_n = np.zeros(_IDS)
    log_n[: len(learnt.common.n)], log_n[END] = np.log10(learnt.common.n + 1), np.log10(learnt.ends + 1)
    shared = context.broadcast({"common": learnt.common, "codes": Slots(codes), "logs": logs, "log_n": log_n, "n_end": learnt.ends})
    scored = scratch.keep(docs.mapInArrow(lambda b: _score(shared.value, parts, b), SCORED), "scored")
    far = exchanged(scored.where("block is not null").select("part", "block"), (_I, _I, _I), parts)
    found = model.cells.groupBy("part").cogroup(far.groupBy("part")).applyInArrow(lambda a, b: look_up(arrays.value, a, b), LOOKED_UP)
    found = scratch.keep(found, "found")
    stats = model.cells.select("ones", "many").mapInArrow(_rare_contexts, "u long, c long, s long").groupBy("u").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    cold = found.where("u is not null").select("row", "u", "x", "p").join(stats, "u", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    log = F.log10((F.col("x").cast("double") + (STRENGTH + model.d_rare * zero("s") / KEPT) * F.col("p")) / (STRENGTH + zero("c")))
    every = found.where("u is null").select("row", F.col("log").cast("double").alias("log"), "base", "known").unionByName(cold.select("row", log.alias("log"), F.lit(0.0).cast("float").alias("base"), F.lit(0).cast("long").alias("known")))
    sums = every.groupBy("row").agg(F.sum("log").alias("log"), F.sum("base").alias("more"), F.sum("known").alias("known"))
    rows = scored.where("block is null").select("doc_id", "row", "n_tokens", "n_known", "base", "model").join(sums, "row", "left")
    return rows.select(
        "doc_id", _held_out().alias("held_out"), "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more") - F.col("n_tokens") * float(np.log10(n_all + learnt.words + 1))).alias("base_score"), (F.col("model") + zero("log")).alias("score"),
    )
