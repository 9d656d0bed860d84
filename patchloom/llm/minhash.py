"""MinHash near-duplicates on SetSketch registers.

Each text's set of five-word shingles is summarised in registers holding truncated logarithms of minima,
spaced as powers of ``BASE``. A register of a union is the larger of two registers, so long texts are
sketched in parts. The more two sets overlap the likelier their registers agree: bands of register values
propose pairs, a joint likelihood over the registers drops the pairs that cannot reach the threshold, and
the rest are confirmed on their full sets. Chance enters only in the first two steps; see :data:`BANDS`
and :data:`DOUBT` for how little.

Pairs of a bucket are never rows of a table. Two rounds compare each member with one pivot of its bucket, which
settles most of a large group; what is left meets in blocks, as arrays, and a block returns one link a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._store import Scratch
from .components import components

#: A pair at the threshold of 0.75 shares none of 32 bands of 4 registers with a probability of 5e-6.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Log-likelihood by which the best estimate below the threshold must beat the threshold for a pair to be
#: dropped unread: 18 is six standard deviations, 1e-9 of the pairs at the threshold.
DOUBT = 18.0
THRESHOLD = (75, 100)
#: Classes of shingles that are counted per set, for an exact bound on what two sets have in common.
CLASSES = 256
#: Pairs are confirmed in groups around one text; a group of more is split and the text sent to each part.
GROUP = 64
#: Rounds of pivots before members meet in blocks.
ROUNDS = 2
#: Members of a part of a bucket, and bytes of their sets, on average; two parts meet in a block.
PART, PART_BYTES = 512, 16 << 20
#: Pairs that a block judges at once.
AT_ONCE = 1 << 12

_SEEDS = np.random.default_rng(17).integers(1, 2**31, (2, REGISTERS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SKETCHED = "doc_id long, t1 long, t2 long, n_shingles long, d1 long, d2 long, sketch binary"
SET = "doc long, d1 long, d2 long, shingles binary"


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers, (n, REGISTERS) uint16, of n sets of hashes; an empty set has zeros."""
    least = np.full((len(first) - 1, REGISTERS), 2**32 - 1, np.uint32)
    folded = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        for c in range(a, b, 4096):
            part = folded[c : min(b, c + 4096)] * _SEEDS[0]
            part += _SEEDS[1]
            np.minimum(least[k], part.min(1), out=least[k])
    waiting = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    values = np.clip(np.floor(1 - np.log(waiting) / np.log(BASE)), 0, TOP + 1)
    values[np.diff(first) == 0] = 0
    return values.astype(np.uint16)


def class_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many shingles of each set fall in each class, (n, CLASSES) uint8; the summed lesser counts of two sets
    bound what they have in common. A set with more in a class than fit has the greatest number there."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    flat = np.bincount(of * CLASSES + (hashes & np.uint64(CLASSES - 1)).astype(np.int64), minlength=(len(first) - 1) * CLASSES)
    return np.minimum(flat, 255).astype(np.uint8).reshape(-1, CLASSES)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Registers and class counts of a column of sketches."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * REGISTERS + CLASSES)
    return np.ascontiguousarray(flat[:, : 2 * REGISTERS]).view(np.uint16), flat[:, 2 * REGISTERS :]


def _exceeds(x: np.ndarray) -> np.ndarray:
    step = np.log(BASE)
    return np.clip(-np.log1p(x * np.expm1(-step)) / step, 1e-12, 1)


def _odds(n1: np.ndarray, n2: np.ndarray, jaccard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities that a register of the first set exceeds, and is exceeded by, the second's."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    return _exceeds(np.maximum(u - v * jaccard, 0)), _exceeds(np.maximum(v - u * jaccard, 0))


def may_reach(r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray, floor: float) -> np.ndarray:
    """Whether the joint likelihood of two register rows and set sizes leaves a Jaccard of ``floor`` possible."""
    if len(n1) > 512:
        return np.concatenate([may_reach(r1[k : k + 512], r2[k : k + 512], n1[k : k + 512], n2[k : k + 512], floor) for k in range(0, len(n1), 512)])
    n1, n2 = n1.astype(float), n2.astype(float)
    more, less = (r1 > r2).sum(1), (r1 < r2).sum(1)
    same = r1.shape[1] - more - less
    most = np.minimum(n1, n2) / np.maximum(n1, n2)
    grid = np.linspace(0, 1, 51)[:, None] * most
    grid = np.vstack([grid, np.minimum(np.full_like(most, floor), most)[None]])
    p, q = _odds(n1, n2, grid)
    like = more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))
    below = np.where(grid[:-1] <= floor, like[:-1], -np.inf).max(0)
    above = np.where(grid >= np.minimum(floor, most) - 1e-12, like, -np.inf).max(0)
    return (most >= floor - 1e-12) & (above >= below - DOUBT)


def _digests(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit digests of each set, which do not depend on the order of its members."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(X.mix(h ^ np.uint64(k)), dtype=np.uint64)]) for k in (0, 0xA5A5A5A5F0F0F0F0)]
    return [X.signed(s[first[1:]] - s[first[:-1]]) for s in sums]


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in X.slices(batch.column(3)):
            h, first = X.shingle_sets(data, off)
            regs, counts = registers(h, first), class_counts(h, first)
            packed = [r.tobytes() + c.tobytes() for r, c in zip(regs, counts, strict=True)]
            kept = [batch.column(k).slice(a, b - a) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.diff(first), pa.int64()), *(pa.array(d) for d in _digests(h, first)), pa.array(packed, pa.binary())],
                ["doc_id", "t1", "t2", "n_shingles", "d1", "d2", "sketch"],
            )


def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = unpacked(batch.column(1))[0].reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(ROWS):
            key = X.mix(key ^ (regs[:, :, k] + np.uint64(1)) * X._GRAM[k])
        ids = np.repeat(np.asarray(batch.column(0)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(X.signed(key.ravel())), pa.array(ids, pa.int64())], ["band", "id"])


def _possible(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which pairs of (registers, class counts, sizes) can reach the threshold: exact bounds, then the likelihood."""
    (ra, ca, na), (rb, cb, nb) = a, b
    keep = np.flatnonzero(THRESHOLD[1] * np.minimum(na, nb) >= THRESHOLD[0] * np.maximum(na, nb))
    ca, cb = ca[keep], cb[keep]
    both = np.minimum(ca, cb).sum(1, dtype=np.int64)
    full = (np.maximum(ca, cb) == 255).any(1)
    keep = keep[full | (THRESHOLD[1] * both >= THRESHOLD[0] * (na[keep] + nb[keep] - both))]
    out = np.zeros(len(na), bool)
    if len(keep):
        out[keep] = may_reach(ra[keep], rb[keep], na[keep], nb[keep], THRESHOLD[0] / THRESHOLD[1])
    return out


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            sides = [(*unpacked(part.column(f"s{c}")), np.asarray(part.column(f"n{c}"))) for c in "ab"]
            yield part.filter(pa.array(_possible(*sides))).select(["a", "b"])


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return THRESHOLD[1] * both >= THRESHOLD[0] * (len(x) + len(y) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to the shingle set of each text, with its digests."""
    for batch in batches:
        for a, b, data, off in X.slices(batch.column(1)):
            h, first = X.shingle_sets(data, off)
            sets = [h[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(d) for d in _digests(h, first)), pa.array(sets, pa.binary())], ["doc", "d1", "d2", "shingles"])


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, id, shingles), the row of ``a`` itself first in its group: the pairs (a, id) that hold."""
    group, centre = None, np.empty(0, np.uint64)
    for batch in batches:
        ids, keys, parts = (np.asarray(batch.column(c)).tolist() for c in ("id", "a", "part"))
        sets, found = batch.column("shingles"), []
        for k, id_ in enumerate(ids):
            own = np.frombuffer(sets[k].as_buffer(), np.uint64)
            if id_ == keys[k]:
                group, centre = (keys[k], parts[k]), own.copy()
            elif group == (keys[k], parts[k]) and _alike(own, centre):
                found.append((keys[k], id_))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def confirmed(scratch: Scratch, pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold."""
    parts = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts")), "parts")
    partners = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("id"))
    centres = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    rows = partners.union(centres).join(pool.select("id", "shingles"), "id").withColumn("partner", F.col("id") != F.col("a"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "partner", "id").drop("partner")
    return rows.mapInArrow(confirm, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks with the bounds of each; rows come sorted by (band, i, j)."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(c)) for c in ("band", "i", "j")])
        at = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        if last is not None and (key[:, 0] != last).any():
            at = np.concatenate([[0], at])
        if len(at):
            held.append(batch.slice(0, int(at[-1])))
            yield _bounded(held)
            held = []
        held.append(batch.slice(int(at[-1]) if len(at) else 0))
        last = key[:, -1]
    if held:
        yield _bounded(held)


def _bounded(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    key = np.stack([np.asarray(table[c]) for c in ("band", "i", "j")])
    return table, np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [table.num_rows]])


def _pairs_of(bounds: np.ndarray, first: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each block, about AT_ONCE at a time: of all rows, or of the first part's with the second's."""
    left, right, size = [], [], 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.arange(a, b)
        rows, others = (own[first[a:b]], own[~first[a:b]]) if cross[a] else (own, own)
        for k in range(len(rows)):
            to = others if cross[a] else own[k + 1 :]
            left.append(np.full(len(to), rows[k]))
            right.append(to)
            size += len(to)
            if size >= AT_ONCE:
                yield np.concatenate(left), np.concatenate(right)
                left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b) between labels: each component has its least."""
    while len(a):
        least = label.copy()
        np.minimum.at(least, label[a], label[b])
        np.minimum.at(least, label[b], label[a])
        least = least[least]
        while (least[least] != least).any():
            least = least[least]
        if (least == label).all():
            break
        label = least
    return label


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of members (band, i, j, first, id, at, n, sketch, shingles) to links (a, b) that join what reaches
    the threshold: as many rows at most as there are members. Pairs of one component are passed over, those found
    on the way too."""
    for table, bounds in _whole_groups(batches):
        at, n = np.asarray(table["at"]), np.asarray(table["n"])
        regs, counts = unpacked(table["sketch"].combine_chunks())
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        nodes, own = np.unique(at, return_inverse=True)
        label = np.arange(len(nodes))
        for u, v in _pairs_of(bounds, np.asarray(table["first"]), np.asarray(table["i"]) != np.asarray(table["j"])):
            apart = label[own[u]] != label[own[v]]
            u, v = u[apart], v[apart]
            can = _possible((regs[u], counts[u], n[u]), (regs[v], counts[v], n[v]))
            u, v = u[can], v[can]
            for x, y in zip(u.tolist(), v.tolist(), strict=True):
                if label[own[x]] != label[own[y]] and _alike(sets[x], sets[y]):
                    label = merged(label, own[[x]], own[[y]])
        new = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[new]], pa.int64()), pa.array(nodes[new], pa.int64())], ["a", "b"])


def _open(scratch: Scratch, live: DataFrame) -> DataFrame:
    """The rows of the buckets that lie in several components."""
    still = live.groupBy("band").agg(F.min("at").alias("x"), F.max("at").alias("y")).where("x <> y").select("band")
    return scratch.keep(live.join(still, "band"), "live")


def _labelled(scratch: Scratch, live: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components of ``links``, the rows of ``live`` that are still open, with their component ``at``)."""
    comps = components(scratch, links)
    at = comps.select(F.col("node").alias("id"), F.col("component").alias("now"))
    now = live.select("band", "id").join(at, "id", "left").select("band", "id", F.coalesce("now", "id").alias("at"))
    return comps, _open(scratch, scratch.keep(now, "labelled"))


def _blocks(live: DataFrame, pool: DataFrame, scratch: Scratch) -> DataFrame:
    """Links found by all members of a bucket meeting part by part."""
    size = live.join(pool.select("id", "n"), "id").groupBy("band").agg(F.count("*").alias("rows"), F.sum(F.col("n") * 8).alias("bytes"))
    parts = scratch.keep(size.select("band", F.ceil(F.greatest(F.col("rows") / PART, F.col("bytes") / PART_BYTES)).cast("int").alias("parts")), "parts")
    dealt = live.join(parts, "band").withColumn("s", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), (F.col("s") <= F.col("t")).alias("first"), "id", "at")
    rows = dealt.join(pool.select("id", "n", "sketch", "shingles"), "id").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "id")
    return rows.mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sketches, classes) of ``docs`` (doc_id, text; other columns are not read).

    ``sketches``: doc_id, t1, t2 (digests of the text), n_shingles, d1, d2 (digests of the shingle set) for every
    row. ``classes``: d1, d2, doc (smallest doc_id of the set), component (a number), component_id for every set
    that some text has: the smallest doc_id reachable over pairs with 100 * intersection >= 75 * union.

    Sets are told apart by both digests, shingles by a 64-bit hash. Each of ROUNDS rounds compares the members of a
    bucket with one of them; buckets go on while they lie in several components. Members of those that are left
    meet in blocks of two parts; such a block's pairs are judged as arrays and not sent anywhere. A group of texts
    of which many are near one another but do not link costs its square in these judgements. Equal sets are one
    node throughout. Null texts and texts without words link with nothing; a null doc_id keeps its row and links
    with nothing; a repeated doc_id keeps its rows, each compared by its own text; ties go to the smaller doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    sketches = scratch.keep(hashed.mapInArrow(sketch, SKETCHED), "sketches")
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    sets = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc"), F.min_by(F.struct("n_shingles", "sketch"), "doc_id").alias("s"))
    sets = scratch.keep(sets.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "doc", F.col("s.n_shingles").alias("n"), F.col("s.sketch").alias("sketch")), "sets")
    banded = scratch.keep(sets.select("id", "sketch").mapInArrow(band, "band long, id long"), "bands")
    buckets = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    live = scratch.keep(banded.join(buckets, "band").select("band", "id", F.col("id").alias("at")), "members")
    scratch.drop(banded)
    # Only texts in a bucket with others are ever compared: their sets are set apart once.
    wanted = live.select("id").distinct().join(sets.select("id", "d1", "d2", "doc", "n", "sketch"), "id")
    texts = docs.join(wanted.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct()
    pool = wanted.join(texts.mapInArrow(_sets, SET).dropDuplicates(["doc", "d1", "d2"]), ["doc", "d1", "d2"])
    pool = scratch.keep(pool.select("id", "n", "sketch", "shingles"), "pool")
    side = lambda x: pool.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    links, comps = None, None
    for turn in range(ROUNDS):
        least = live.groupBy("band").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "band", "id"), "id", "at")).alias("p")).select("band", F.col("p.id").alias("a"), F.col("p.at").alias("pat"))
        pairs = live.join(least, "band").where("at <> pat").select("a", F.col("id").alias("b")).distinct()
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        near = scratch.keep(near.mapInArrow(likely, "a long, b long"), "likely")
        new = scratch.keep(confirmed(scratch, near, pool), "links")
        links = new if links is None else links.union(new)
        comps, live = _labelled(scratch, live, links)
        if live.isEmpty():
            break
    else:
        new = scratch.keep(_blocks(live, pool, scratch), "links")
        comps = components(scratch, links.union(new))
    named = sets.select("id", "d1", "d2", "doc").join(comps.withColumnRenamed("node", "id"), "id", "left")
    named = scratch.keep(named.select("d1", "d2", "doc", F.coalesce("component", "id").alias("component")), "named")
    scratch.drop(pool, sets, live)
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    classes = scratch.keep(named.join(least, "component").select("d1", "d2", "doc", "component", "component_id"), "classes")
    return sketches.drop("sketch"), classes


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; see :func:`near_duplicates`."""
    sketches, classes = near_duplicates(docs, Scratch(docs.sparkSession, "minhash"))
    alone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = sketches.where("n_shingles > 0 and doc_id is not null").join(classes, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    return alone.union(grouped).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: of the smallest doc_id, and among the rows that
    share it, of the smallest text digest. Texts without words and null doc_ids stay; repeated rows are one."""
    sketches, classes = near_duplicates(docs, scratch)
    rows = sketches.where("n_shingles > 0 and doc_id is not null").join(classes.select("d1", "d2", "component"), ["d1", "d2"])
    key = F.struct("doc_id", "t1", "t2")
    best = scratch.keep(rows.groupBy("component").agg(F.min(key).alias("best")), "best")
    gone = rows.join(best, "component").where(key != F.col("best")).select("doc_id", "t1", "t2").distinct()
    twice = rows.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t1", "t2")
    gone, twice = scratch.keep(gone, "gone"), scratch.keep(twice, "twice")
    hashed = docs.withColumns({"_d": F.col("doc_id").cast("long"), "_t1": F.xxhash64(F.col("text").cast("string")), "_t2": F.xxhash64(F.lit(1), F.col("text").cast("string"))})
    is_in = lambda t: (F.col("_d") == t["doc_id"]) & (F.col("_t1") == t["t1"]) & (F.col("_t2") == t["t2"])
    kept = hashed.join(gone, is_in(gone), "left_anti")
    if not twice.isEmpty():
        one = kept.join(twice, is_in(twice), "left_semi").dropDuplicates(["_d", "_t1", "_t2"])
        kept = kept.join(twice, is_in(twice), "left_anti").union(one)
    return kept.select(*docs.columns)
