"""Embedding near-duplicates through an inverted multi-index.

Either half of a unit vector has a codebook of its own; the two make a grid of cells. Every vector lies in one
cell and visits the cells nearest to it in the order of a multi-sequence traversal, as many as the target
recall took on a sample. Vectors that meet in a cell are compared in double precision. Pairs are counted where
they meet and never written out: a meeting returns each vector's number of links and one link to its group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Scratch
from .components import components
from .minhash import merged

COSINE = 0.9
#: Rows that the codebooks and the number of visited cells are fitted on, at least and at most; all rows are indexed.
SAMPLE, MOST_SAMPLE = 4096, 1 << 15
#: Share of links, between sampled rows and at the very threshold, whose cell the traversal must reach.
RECALL = 0.995
#: Members of a group of cells, on average, and bytes of them in double precision at most. A group of four times as many
#: members, or visitors, is split into parts by hash.
MEET, MEET_BYTES = 1 << 14, 8 << 20


def meeting(dim: int) -> int:
    return max(64, min(MEET, MEET_BYTES // (8 * dim)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. A power of two first brings the largest component near one, so no square over- or underflows."""
    _, power = np.frexp(np.abs(x).max(1, keepdims=True))
    x = np.ldexp(x, -power)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[k : k + 1024], codes).argmin(1) for k in range(0, len(x), 1024)])


def _codebook(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(3)
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(12):
        own = _nearest(x, codes)
        n = np.bincount(own, minlength=len(codes))
        sums = np.stack([np.bincount(own, x[:, c], len(codes)) for c in range(x.shape[1])], 1)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


def traverse(d1: np.ndarray, d2: np.ndarray, visits: int) -> np.ndarray:
    """The ``visits`` cells of the smallest d1[i] + d2[j] for each row, nearest first.

    The a-th of one half with the b-th of the other has (a + 1)(b + 1) - 1 cells no farther before it, so only
    places with a product of at most ``visits`` need a sum.
    """
    o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
    places = [(a, b) for a in range(min(d1.shape[1], visits)) for b in range(min(d2.shape[1], visits // (a + 1)))]
    a, b = np.array(places).T
    sums = np.take_along_axis(d1, o1, 1)[:, a] + np.take_along_axis(d2, o2, 1)[:, b]
    first = np.argsort(sums, 1, kind="stable")[:, :visits]
    return np.take_along_axis(o1[:, a] * d2.shape[1] + o2[:, b], first, 1)


class Index:
    """Codebooks of both halves, the number of cells that each vector visits, and groups of near cells."""

    def __init__(self, sample: np.ndarray, n: int):
        x = unit(sample)
        k = int(min(max(2, math.ceil(n ** (1 / 3))), len(x)))
        self.cut = x.shape[1] // 2
        self.codes = [_codebook(x[:, : self.cut], k), _codebook(x[:, self.cut :], k)]
        self.visits = self._visits(x)
        # Groups take whole first codes while these are more than the groups, and parts of them beyond.
        groups = max(1, -(-n // meeting(x.shape[1])))
        first, second = min(groups, len(self.codes[0])), min(-(-groups // len(self.codes[0])), len(self.codes[1]))
        near = [_nearest(c, _codebook(c, g)) for c, g in zip(self.codes, (first, second), strict=True)]
        self.group = (near[0][:, None] * second + near[1][None]).ravel().astype(np.int32)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.cut], self.codes[0]), _distances(x[:, self.cut :], self.codes[1])

    def _visits(self, x: np.ndarray) -> int:
        cells = len(self.codes[0]) * len(self.codes[1])
        rng, some = np.random.default_rng(9), x[:1024]
        side = unit(rng.normal(size=some.shape))
        side = unit(side - (side * some).sum(1, keepdims=True) * some)
        near = [(some, COSINE * some + math.sqrt(1 - COSINE**2) * side)]
        a, b = np.nonzero(np.triu(some @ x.T >= COSINE, 1)) if len(x) > 1 else ([], [])
        if len(a):
            # As many of the links as there are sampled rows, each row's at random: no group fills the choice.
            order = rng.permutation(len(a))
            turn = np.empty(len(a), np.int64)
            by = order[np.argsort(a[order], kind="stable")]
            first = np.searchsorted(a[by], a[by])
            turn[by] = np.arange(len(a)) - first
            kept = np.lexsort((rng.random(len(a)), turn))[:4096]
            near.append((some[a[kept]], x[b[kept]]))
        need = 1
        for u, v in near:
            least = np.minimum(self._places(u, v), self._places(v, u))
            need = max(need, int(np.quantile(least, RECALL, method="higher")) + 1)
        return min(cells, need)

    def _places(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Cells that come before v's cell in u's traversal."""
        own, out = self.cell(v), []
        step = max(1, (1 << 21) // (len(self.codes[0]) * len(self.codes[1])))
        for k in range(0, len(u), step):
            d1, d2 = self._halves(u[k : k + step])
            sums = (d1[:, :, None] + d2[:, None, :]).reshape(len(d1), -1)
            out.append((sums < sums[np.arange(len(d1)), own[k : k + step]][:, None]).sum(1))
        return np.concatenate(out)

    def cell(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self._halves(x)
        return d1.argmin(1) * len(self.codes[1]) + d2.argmin(1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        return traverse(*self._halves(x), self.visits)


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of lists packed as 32-bit numbers."""
    raw = column.to_pylist()
    return np.repeat(np.arange(len(raw)), [len(r) // 4 for r in raw]), np.frombuffer(b"".join(raw), np.int32).astype(np.int64)


def meet(table: pa.Table, kind: str) -> pa.Table:
    """Members and visitors of one group of cells: (id, links, near) of those that found links.

    A role of 1 is a member, 2 a visitor, 3 both. Members know all cells they visit, visitors those of the group. A
    pair that meets in both vectors' cells is counted where the visitor has the smaller id.
    """
    role, ids, cell, copies = (np.asarray(table[c]) for c in ("role", "id", "cell", "copies"))
    x = unit(np.frombuffer(b"".join(table["vector"].to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
    row, visited = _ragged(table["visits"])
    span = int(max(visited.max(initial=0), cell.max(initial=0))) + 1
    known = np.sort(row[role[row] != 2] * span + visited[role[row] != 2])
    calls = role[row] != 1
    by_cell = np.argsort(visited[calls], kind="stable")
    caller, called = row[calls][by_cell], visited[calls][by_cell]
    m = np.flatnonzero(role != 2)
    order = m[np.argsort(cell[m], kind="stable")]
    bounds = np.flatnonzero(np.diff(np.concatenate([[-1], cell[order]])))
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    ends = np.append(bounds[1:], len(order))[: len(bounds)]  # a part that only has visitors has no cell
    for a, b in zip(bounds.tolist(), ends.tolist(), strict=True):
        at = cell[order[a]]
        here = caller[np.searchsorted(called, at) : np.searchsorted(called, at, "right")]
        for c in range(a, b, 2048):
            own = order[c : min(b, c + 2048)]
            for k in range(0, len(here), 512):
                part = here[k : k + 512]
                u, v = np.nonzero(x[part] @ x[own].T >= COSINE)
                u, v = part[u], own[v]
                code = v * span + cell[u]
                twice = known[np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))] == code if len(known) else np.zeros(len(u), bool)
                keep = (ids[u] != ids[v]) & (~twice | (ids[u] < ids[v]))
                u, v = u[keep], v[keep]
                links += np.bincount(u, copies[v], len(ids)).astype(np.int64) + np.bincount(v, copies[u], len(ids)).astype(np.int64)
                label = merged(label, label[u], label[v])
    some = np.flatnonzero(links)
    return pa.table({"id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some]), "near": pa.array(ids[label[some]], pa.int64())})


def near_duplicates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """vec_id, n_links, component_id for every row of ``rows`` (vec_id, embedding).

    Null and zero vectors, those with null or non-finite components, and null vec_ids link with nothing; others
    with vectors of their own length, each length by an index of its own. Equal vectors are indexed once and count as many links as they are rows; rows
    that repeat a vec_id are vectors of their own; ties of a component go to the smallest vec_id. A vector with itself
    is no link. Components may be as small or large as doubles are. Vectors of any length are held whole, a group's at once; other columns are not read.
    """
    narrow = rows.schema["embedding"].dataType == T.ArrayType(T.FloatType(), rows.schema["embedding"].dataType.containsNull)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = rows.select("vec_id", "embedding", sound.alias("sound"), F.size("embedding").alias("dim"), F.xxhash64(F.lit(1), "embedding").alias("d1"), F.xxhash64(F.lit(2), "embedding").alias("d2"))
    out = keyed.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for r in keyed.where("sound").groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        out = out.union(_linked(keyed.where(f"sound and dim = {r['dim']}"), r["dim"], r["n"], "<f4" if narrow else "<f8", scratch))
    return out


def _linked(good: DataFrame, dim: int, n: int, kind: str, scratch: Scratch) -> DataFrame:
    """vec_id, n_links, component_id of ``n`` sound vectors of one length, whose components are of ``kind``."""
    if dim == 1:  # a zero component more changes no angle, and gives both codebooks something to hold
        good, dim = good.withColumn("embedding", F.concat("embedding", F.array(F.lit(0.0).cast("float" if kind == "<f4" else "double")))), 2
    classes = good.groupBy("d1", "d2").agg(F.min("vec_id").alias("_first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    # A vec_id may stand for several vectors: classes have numbers of their own.
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    most = int(min(MOST_SAMPLE, max(SAMPLE, 8 * n ** (1 / 3))))
    sample = classes.orderBy(F.xxhash64("d1", "d2"), "id").limit(most).select("embedding").collect()
    shared = good.sparkSession.sparkContext.broadcast(Index(np.array([r["embedding"] for r in sample], np.float64), n))

    def assign(batches):
        """A row for each group that a vector visits, and one for its own."""
        index = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                flat = np.asarray(part.column("embedding").flatten()).astype(kind).reshape(-1, dim)
                x = unit(flat.astype(np.float64))
                cells, visits = index.cell(x), index.visited(x).astype(np.int32)
                groups, own = index.group[visits], index.group[cells]
                out = []
                for r in range(len(x)):
                    calls = groups[r] == own[r]
                    out.append((r, own[r], True, calls.any(), visits[r].tobytes()))
                    out += [(r, g, False, True, visits[r][groups[r] == g].tobytes()) for g in np.unique(groups[r][~calls])]
                at = np.array([o[0] for o in out])
                vectors = [v.tobytes() for v in flat]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(at)), part.column("copies").take(pa.array(at)), pa.array(cells[at], pa.int32()), pa.array([vectors[k] for k in at], pa.binary()), pa.array([o[4] for o in out], pa.binary()),
                        pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out]), pa.array([bool(o[3]) for o in out]),
                    ],
                    ["id", "copies", "cell", "vector", "visits", "g", "member", "visitor"],
                )

    placed = classes.select("id", "copies", "embedding").mapInArrow(assign, "id long, copies long, cell int, vector binary, visits binary, g int, member boolean, visitor boolean")
    placed = scratch.keep(placed, "placed")
    count = lambda c: F.greatest(F.ceil(F.count_if(c) / (4 * meeting(dim))), F.lit(1)).cast("int")
    parts = scratch.keep(placed.groupBy("g").agg(count("member").alias("pm"), count("visitor").alias("pv")), "parts")
    rows = placed.join(parts, "g")
    # Where a group is one part, a member that visits is one row; else each role has rows of its own.
    whole = "pm = 1 and pv = 1"
    one = rows.where(whole).select("*", (F.col("member").cast("int") + 2 * F.col("visitor").cast("int")).alias("role"), F.lit(0).alias("s"), F.lit(0).alias("q"))
    mine = lambda p: F.pmod(F.xxhash64("id"), F.col(p)).cast("int")
    each = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
    split = rows.where(f"not ({whole})")
    members = split.where("member").select("*", F.lit(1).alias("role"), mine("pm").alias("s"), each("pv").alias("q"))
    visitors = split.where("visitor").select("*", F.lit(2).alias("role"), each("pm").alias("s"), mine("pv").alias("q"))
    every = one.unionByName(members).unionByName(visitors).select("g", "s", "q", "role", "id", "copies", "cell", "vector", "visits")
    met = every.groupBy("g", "s", "q").applyInArrow(lambda t: meet(t, kind), "id long, links long, near long")
    met = scratch.keep(met, "met")
    scratch.drop(placed)
    joined = components(scratch, met.select(F.col("id").alias("a"), F.col("near").alias("b")))
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    out = classes.select("d1", "d2", "id", "copies", "_first").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    out = scratch.keep(out.select("d1", "d2", "_first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "linked")
    least = out.groupBy("component").agg(F.min("_first").alias("component_id"))
    out = scratch.keep(out.join(least, "component").select("d1", "d2", "n_links", "component_id"), "result")
    return good.select("vec_id", "d1", "d2").join(out, ["d1", "d2"]).select("vec_id", "n_links", "component_id")


def op8(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows``; see :func:`near_duplicates`."""
    out = near_duplicates(rows, Scratch(rows.sparkSession, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
