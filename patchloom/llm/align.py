"""Alignment of two tokenizers over the same texts.

Both encodings of a text spell the same bytes, so the sums of their tokens' lengths are places in one text. Places
where tokens of both end cut it into groups; tokens whose byte ranges overlap are linked. Links of a slice of texts
are expanded at once by repeated indexes, and a text keeps each linked pair of ids once with how often it holds it.
How often pairs occur in the corpus is summed inside tasks first, then by pair and salt, then by pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._store import Scratch, lean
from ._tokenizers import ByteLevel, PieceModel, Pieces, loaded

SALTS = 8
#: Pairs whose counts every task knows, at most (16 bytes each); how often others occur is joined to the texts that hold them.
COMMON = 1 << 20
#: Distinct pairs of several batches that a task gathers before it sums them.
GATHER = 1 << 22
_COMMA, _BAR, _SEMICOLON = b",|;"
_DIGITS: list[Pieces] = []


def _digits(size: int) -> Pieces:
    """Every id in decimals with one byte behind it."""
    if not _DIGITS or len(_DIGITS[0].n) < size:
        _DIGITS[:] = [Pieces({i: b"%d," % i for i in range(size)})]
    return _DIGITS[0]


def _last(groups: np.ndarray) -> np.ndarray:
    """Which tokens are the last ones of their groups."""
    return np.diff(groups, append=-1) != 0


class Aligned:
    """Texts of which both encodings spell the same bytes, one after another.

    ``a`` and ``b`` are ids, ``of_a`` and ``of_b`` their groups; ``na``, ``nb``, ``groups`` and ``links`` count by text.
    """

    def __init__(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, len_a: np.ndarray, len_b: np.ndarray):
        self.a, self.b, self.na, self.nb = a, b, na, nb
        ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.of_a, self.of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        text_ends = ends_a[np.cumsum(na) - 1]
        self.groups = np.diff(np.searchsorted(cuts, text_ends, "right"), prepend=0)
        # A token of A meets the tokens of B from the first that ends behind its start to the first that ends no sooner.
        low = np.searchsorted(ends_b, ends_a - len_a, "right")
        n = np.searchsorted(ends_b, ends_a) - low + 1
        up = np.cumsum(n)
        self.link_a = np.repeat(np.arange(len(a)), n)
        self.link_b = np.arange(up[-1]) - np.repeat(up - n - low, n)
        self.links = np.diff(up[np.cumsum(na) - 1], prepend=0)

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a * width + b, how often, text) of the distinct linked pairs of each text, sorted by text and pair."""
        key = self.a[self.link_a] * width + self.b[self.link_b]
        text = np.repeat(np.arange(len(self.na)), self.links)
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(text[order], kind="stable")]
        key, text = key[order], text[order]
        first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        return key[first], np.diff(np.append(first, len(key))), text[first]

    def lines(self, size: int) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        at_a = np.arange(len(self.a)) + np.searchsorted(self.of_b, self.of_a)
        at_b = np.arange(len(self.b)) + np.searchsorted(self.of_a, self.of_b, "right")
        ids, after = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[at_a], after[at_a] = self.a, np.where(_last(self.of_a), _BAR, _COMMA)
        ids[at_b], after[at_b] = self.b, np.where(_last(self.of_b), _SEMICOLON, _COMMA)
        flat, ends = _digits(size).bytes_of(ids)
        flat[ends - 1] = after
        bounds = ends[np.cumsum(self.na + self.nb) - 1].tolist()
        raw = flat.tobytes()
        return [raw[i : j - 1] for i, j in zip([0, *bounds[:-1]], bounds, strict=True)]


def aligned(texts: list[str], a: ByteLevel, b: PieceModel) -> tuple[np.ndarray, Aligned | None]:
    """(which of the texts have tokens that spell a space and the text in both encodings, their alignment)."""
    sound = np.array([bool(t) for t in texts], bool)
    some = [t for t in texts if t]
    if not some:
        return sound, None
    want = [b" " + t.encode() for t in some]
    size = np.array([len(w) for w in want])
    ids_a, off_a = a.encode([" " + t for t in some])
    ids_b, off_b = b.encode(some)
    keep = np.ones(len(some), bool)
    for ids, off, pieces in ((ids_a, off_a, a.pieces), (ids_b, off_b, b.pieces)):
        ends = np.concatenate([[0], np.cumsum(pieces.n[ids])])[off]
        keep &= np.diff(ends) == size
    for ids, off, pieces in ((ids_a, off_a, a.pieces), (ids_b, off_b, b.pieces)):
        got, _ = pieces.bytes_of(ids[np.repeat(keep, np.diff(off))])
        wrong = got != np.frombuffer(b"".join(w for w, k in zip(want, keep, strict=True) if k), np.uint8)
        if wrong.any():
            ends = np.cumsum(size[keep])
            bad = np.unique(np.searchsorted(ends, np.flatnonzero(wrong), "right"))
            keep[np.flatnonzero(keep)[bad]] = False
    sound[sound] = keep
    if not keep.any():
        return sound, None
    na, nb = np.diff(off_a), np.diff(off_b)
    ids_a, ids_b = ids_a[np.repeat(keep, na)], ids_b[np.repeat(keep, nb)]
    return sound, Aligned(ids_a, na[keep], ids_b, nb[keep], a.pieces.n[ids_a], b.pieces.n[ids_b])


class Alignment:
    """Two tokenizers: a byte-level vocabulary (A) and a model of pieces (B), each from a file."""

    def __init__(self, spark: SparkSession, byte_level: str, piece_model: str):
        lean(spark)
        self.spark = spark
        with open(byte_level, encoding="utf-8") as f, open(piece_model, "rb") as g:
            sources = f.read(), g.read()
        a, b = ByteLevel(sources[0], False), PieceModel(sources[1])
        self.shared = spark.sparkContext.broadcast(sources)
        self.width, self.size = len(b.pieces.n), max(len(a.pieces.n), len(b.pieces.n))
        self.kind = "<u4" if len(a.pieces.n) * self.width < 1 << 32 else "<i8"

    def texts(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs`` (doc_id, text) with a number of their own: row, doc_id, n_a, n_b, n_groups, n_links,
        groups_sha256, and packed the distinct linked pairs and how often the text holds each."""
        shared, width, size, kind = self.shared, self.width, self.size, self.kind

        def run(batches):
            a, b = (loaded(k, s, *r) for k, s, r in zip((ByteLevel, PieceModel), shared.value, ((False,), ()), strict=True))
            for batch in batches:
                for i, j, _, _ in X.slices(batch.column(2)):
                    yield _rows(batch.slice(i, j - i), *aligned(batch.column(2).slice(i, j - i).to_pylist(), a, b), width, size, kind)

        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        return rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary")

    def pairs(self, texts: DataFrame) -> DataFrame:
        """pair, n: how many links of the corpus hold each pair of ids, a * width + b."""
        kind = self.kind

        def run(batches):
            gathered, size = [], 0
            for batch in batches:
                pair, n = _packed(batch.column(0), kind), _packed(batch.column(1), "<u4")
                gathered.append(_summed([(pair, n)]))
                size += len(gathered[-1][0])
                if size > GATHER:
                    gathered = [_summed(gathered)]
                    if (size := len(gathered[0][0])) > GATHER // 2:
                        yield from _pair_rows(*gathered[0])
                        gathered, size = [], 0
            if gathered:
                yield from _pair_rows(*_summed(gathered))

        parts = texts.select("pairs", "counts").mapInArrow(run, "pair long, n long").withColumn("salt", F.spark_partition_id() % SALTS)
        return parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))

    def mapping(self, pairs: DataFrame) -> DataFrame:
        """b, a, n: the id of A that each id of B is linked with most often; the smallest of several."""
        a, b = F.floor(F.col("pair") / self.width).cast("long"), F.col("pair") % self.width
        best = pairs.select(b.alias("b"), a.alias("a"), "n").groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("least"))).alias("best"))
        return best.select("b", (-F.col("best.least")).alias("a"), F.col("best.n").alias("n"))

    def scored(self, texts: DataFrame, pairs: DataFrame, common: int = COMMON) -> DataFrame:
        """row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

        Tables of the highest count of each id of B, and of the counts of the commonest pairs, ``common`` at most, are
        sent to all tasks. Pairs are common from a power of two on, the least that leaves no more of them.
        """
        width, kind, spark = self.width, self.kind, self.spark
        best = np.zeros(width, np.int64)
        for r in pairs.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("n")).collect():  # a row an id of B
            best[r["b"]] = r["n"]
        level = F.length(F.bin("n")) - 1
        left, least = common, 64
        for r in sorted(pairs.groupBy(level.alias("level")).count().collect(), reverse=True):  # 64 rows at most
            if r["count"] > left:
                break
            left, least = left - r["count"], r["level"]
        known = pairs.where(level >= least).select("pair", "n").toArrow().sort_by("pair")
        table = np.asarray(known["pair"], np.int64), np.asarray(known["n"], np.int64)
        shared = spark.sparkContext.broadcast((best, *table))
        rest = [c for c in texts.columns if c not in ("pairs", "counts")]

        def known_ones(batches):
            best, keys, counts = shared.value
            for batch in batches:
                pair, n, off = _ragged(batch, kind)
                at, found = _found(keys, pair)
                count = np.where(found, counts[at] if len(counts) else 0, 0)
                sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[off]) for v in (n * (found & (count == best[pair % width])), n * count)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, sums)], [*rest, "n_best", "count_sum"])

        def others(batches):
            keys = shared.value[1]
            for batch in batches:
                pair, n, off = _ragged(batch, kind)
                row = np.repeat(np.asarray(batch.column("row")), np.diff(off))
                missing = ~_found(keys, pair)[1]
                row, pair, n = row[missing], pair[missing], n[missing]
                for k in range(0, len(row), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 16)]) for v in (row, pair, n)], ["row", "pair", "held"])

        fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in texts.schema if f.name in rest)
        out = texts.mapInArrow(known_ones, f"{fields}n_best long, count_sum long")
        rare = pairs.where(level < least)
        if not rare.isEmpty():
            tops = spark.createDataFrame([(k, int(n)) for k, n in enumerate(best.tolist())], "b long, top long")
            rare = rare.withColumn("b", F.col("pair") % width).join(F.broadcast(tops), "b")
            more = texts.select("row", "pairs", "counts").mapInArrow(others, "row long, pair long, held long").join(rare, "pair")
            more = more.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("held")).otherwise(0)).alias("_best"), F.sum(F.col("held") * F.col("n")).alias("_sum"))
            added = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
            out = out.join(more, "row", "left").select(*rest, added("n_best", "_best"), added("count_sum", "_sum"))
        return out


def _rows(batch: pa.RecordBatch, sound: np.ndarray, of: Aligned | None, width: int, size: int, kind: str) -> pa.RecordBatch:
    columns, at = np.zeros((4, len(sound)), np.int64), np.flatnonzero(sound)
    digests, pairs, counts = [""] * len(sound), [b""] * len(sound), [b""] * len(sound)
    if of:
        columns[:, at] = of.na, of.nb, of.groups, of.links
        pair, n, text = of.pairs(width)
        off = np.searchsorted(text, np.arange(len(at) + 1)).tolist()
        pair, n = pair.astype(kind), n.astype("<u4")
        for k, line, i, j in zip(at.tolist(), of.lines(size), off[:-1], off[1:], strict=True):
            digests[k], pairs[k], counts[k] = hashlib.sha256(line).hexdigest(), pair[i:j].tobytes(), n[i:j].tobytes()
    arrays = [batch.column(0), batch.column(1), *map(pa.array, columns), pa.array(digests), pa.array(pairs, pa.binary()), pa.array(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"])


def _packed(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


def _ragged(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, counts, n + 1 offsets) of a batch of texts."""
    n = _packed(batch.column("counts"), "<u4")
    sizes = [len(c) // 4 for c in batch.column("counts").to_pylist()]
    return _packed(batch.column("pairs"), kind), n, np.cumsum([0, *sizes])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first], np.add.reduceat(n, first) if len(first) else n[:0]


def _pair_rows(pair: np.ndarray, n: np.ndarray):
    for k in range(0, len(pair), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(pair[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], ["pair", "n"])


def _found(keys: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``keys``, whether it is there) of each pair."""
    at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
    return at, keys[at] == pair if len(keys) else np.zeros(len(pair), bool)


def op13(docs: DataFrame, byte_level: str, piece_model: str, common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    Texts that are null or empty, or that an encoding does not spell byte by byte, have zeros and an empty digest. Rows of any
    doc_id, null or repeated, stay, each with its own text; pairs with the same count as the highest are all best. A text of any
    length is encoded whole, with about 60 bytes a token held beside it. An empty table has no rows; other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "align")
    both = Alignment(docs.sparkSession, byte_level, piece_model)
    texts = scratch.keep(both.texts(docs), "texts")
    pairs = scratch.keep(both.pairs(texts), "pairs")
    out = both.scored(texts, pairs, common)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
