"""Token ids in binary files with a shared zstandard dictionary.

A dictionary is trained on the serialised ids of short documents; every document is a frame of its own that is
compressed with it, so one short document can be read without its neighbours and still compresses well. A file is
a part of the documents in ascending order of their ids:

    header   8 bytes b"PLTOKEN1", then the bytes of one id (2 or 4) as one byte, then the SHA-256 of the dictionary, LF
    frames   one a document, each followed by LF
    index    one zstandard frame of JSON lists: doc_ids, where frames end, numbers of ids; then LF
    footer   b"PLTOKEND", the file's number and where the index begins, each as 8 bytes, LF

Numbers are little-endian. Files are written by Spark's own text writer, whose rows are the pieces above, so that any
folder Spark can write to will do. The dictionary is in the folder ``dictionary`` beside the folder ``files``.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as X
from ._store import Scratch, lean
from ._tokenizers import ByteLevel, loaded

MAGIC, END, LF = b"PLTOKEN1", b"PLTOKEND", b"\n"
_FOOTER = struct.Struct("<8sQQ")
LEVEL = 3
#: Bytes of a dictionary, of a text that it may be trained on, and how many of these there are, about and at most.
DICTIONARY_BYTES, SHORT, SAMPLE = 1 << 16, 8192, 4096
#: Bytes of a file, on average.
FILE_BYTES = 32 << 20


class Damaged(ValueError):
    """A file that is not as it was written, or not of this dictionary."""


def trained(samples: list[bytes]) -> bytes:
    """A dictionary for such samples; empty where there are too few of them to train one."""
    if sum(map(len, samples)) < 1 << 12 or len(samples) < 16:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class Frames:
    """Compresses and restores the ids of single documents."""

    def __init__(self, dictionary: bytes, width: int):
        self.hash, self.kind = hashlib.sha256(dictionary).digest(), {2: "<u2", 4: "<u4"}[width]
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self._in, self._out = zstandard.ZstdCompressor(level=LEVEL, **shared), zstandard.ZstdDecompressor(**shared)
        self.header = MAGIC + bytes([width]) + self.hash

    def pack(self, ids: np.ndarray) -> bytes:
        return self._in.compress(ids.astype(self.kind).tobytes())

    def unpack(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self._out.decompress(frame), self.kind)


def file_of(rows: Iterator[tuple[int | None, int, bytes]], number: int, frames: Frames) -> Iterator[bytes]:
    """The pieces of one file, without the LF after each, of (doc_id, number of ids, frame); none for no rows."""
    ids, ends, counts, at = [], [], [], len(frames.header) + 1
    for doc_id, n, frame in rows:
        if not ids:
            yield frames.header
        at += len(frame)
        ids.append(doc_id)
        counts.append(n)
        ends.append(at)
        at += 1
        yield frame
    if ids:
        yield zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps([ids, ends, counts], separators=(",", ":")).encode())
        yield _FOOTER.pack(END, number, at)


class File:
    """One file's bytes, whose index is read and whose frames are read on demand."""

    def __init__(self, raw: bytes, frames: Frames):
        self.raw, self.frames = memoryview(raw), frames
        if len(raw) < _FOOTER.size + 1 + len(frames.header) or raw[: len(MAGIC)] != MAGIC:
            raise Damaged("no file of token ids")
        if raw[: len(frames.header)] != frames.header:
            raise Damaged("written with another dictionary or another width of ids")
        mark, self.number, at = _FOOTER.unpack_from(raw, len(raw) - 1 - _FOOTER.size)
        if mark != END or at > len(raw):
            raise Damaged("cut short")
        try:
            index = zstandard.ZstdDecompressor().decompress(raw[at : len(raw) - 2 - _FOOTER.size])
        except zstandard.ZstdError as e:
            raise Damaged("broken index") from e
        self.doc_ids, ends, counts = json.loads(index)
        self.ends, self.counts = np.array(ends, np.int64), np.array(counts, np.int64)
        self.begins = np.concatenate([[len(frames.header)], self.ends[:-1]]) + 1

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        found = self.frames.unpack(self.raw[self.begins[k] : self.ends[k]])
        if len(found) != self.counts[k]:
            raise Damaged(f"document {self.doc_ids[k]} has {len(found)} ids and not {self.counts[k]}")
        return found


def _short(docs: DataFrame) -> list[str]:
    """Texts to train on: about SAMPLE of the short ones, by a hash of id and text, and never more than twice that."""
    short = docs.where(F.octet_length("text").between(1, SHORT))
    n = short.count()
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    return [r["text"] for r in short.where(place < int((1 << 40) * min(1.0, SAMPLE / max(1, n)))).select("text").limit(2 * SAMPLE).collect()]


def write(docs: DataFrame, path: str, vocabulary: str, end: int | None, scratch: Scratch) -> None:
    """Write doc_id and text of every row to ``path``, in ascending order of doc_id, nulls last.

    A null text is an empty one. With ``end``, that id follows every document. Rows that repeat a doc_id are documents of their
    own, in the order of a hash of their frames; they may lie in several files.
    """
    spark = docs.sparkSession
    lean(spark)
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    after = [] if end is None else [end]
    coder = ByteLevel(source, True)
    width = 2 if max([len(coder.pieces.n) - 1, *after]) < 1 << 16 else 4
    ids, off = coder.encode(_short(docs))
    dictionary = trained([np.append(ids[a:b], after).astype(f"<u{width}").tobytes() for a, b in zip(off[:-1], off[1:], strict=True)])
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), width, bytearray(dictionary))], "hash string, width int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast((source, dictionary))

    def compressed(batches):
        source, dictionary = shared.value
        coder, frames = loaded(ByteLevel, source, True), Frames(dictionary, width)
        for batch in batches:
            for a, b, _, _ in X.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, off = coder.encode(part.column(1).to_pylist())
                packed = [frames.pack(np.append(ids[i:j], after)) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off) + len(after), pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "frame"])

    kept = scratch.keep(docs.mapInArrow(compressed, "doc_id long, n long, frame binary"), "frames")
    size = kept.agg(F.sum(F.octet_length("frame"))).collect()[0][0] or 0
    tie = kept.withColumn("tie", F.xxhash64("frame")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    dealt = tie.repartitionByRange(max(1, -(-size // FILE_BYTES)), *order).sortWithinPartitions(*order).select("doc_id", "n", "frame")

    def pieces(batches):
        frames, number = Frames(shared.value[1], width), TaskContext.get().partitionId()
        rows = ((r["doc_id"], r["n"], r["frame"]) for batch in batches for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist())
        some, size = [], 0
        for piece in file_of(rows, number, frames):
            some.append(piece)
            size += len(piece)
            if size > 1 << 20 or len(some) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["value"])
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["value"])

    dealt.mapInArrow(pieces, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/files")
    scratch.drop(kept)


def _frames(spark: SparkSession, path: str) -> tuple[bytes, int]:
    found = spark.read.parquet(f"{path}/dictionary").collect()[0]
    dictionary = bytes(found["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != found["hash"]:
        raise Damaged("the dictionary is not the one that was written")
    return dictionary, found["width"]


def _scan(spark: SparkSession, path: str, made, schema: str) -> DataFrame:
    """What ``made`` yields, as record batches, of every file under ``path``; a file is read whole by one task."""
    lean(spark)
    shared = spark.sparkContext.broadcast(_frames(spark, path))

    def run(batches):
        frames = Frames(*shared.value)
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                if len(body := raw.as_buffer()):  # a task without documents may leave an empty file
                    yield from made(name.as_py(), File(body.to_pybytes(), frames))

    return spark.read.format("binaryFile").load(f"{path}/files").select("path", "content").mapInArrow(run, schema)


def _batched(file: File, which: list[int], make) -> Iterator[pa.RecordBatch]:
    """``make`` of some documents at once, whose ids are no more than about a million."""
    a = 0
    while a < len(which):
        b = a + max(1, int(np.searchsorted(np.cumsum(file.counts[which[a:]]), 1 << 20)))
        yield make(which[a:b])
        a = b


def index(spark: SparkSession, path: str) -> DataFrame:
    """path, number, k, doc_id, begin, end, n_tokens of every document: where its frame lies in which file."""

    def made(name, file):
        n = len(file.doc_ids)
        columns = [pa.array([name] * n), pa.array([file.number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(file.doc_ids, pa.int64()), *map(pa.array, (file.begins, file.ends, file.counts))]
        yield pa.RecordBatch.from_arrays(columns, ["path", "number", "k", "doc_id", "begin", "end", "n_tokens"])

    return _scan(spark, path, made, "path string, number long, k long, doc_id long, begin long, end long, n_tokens long")


def read(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, token_ids of the documents under ``path``, or only of those ``wanted``, whose frames alone are restored."""
    some = None if wanted is None else frozenset(wanted)

    def made(_, file):
        which = [k for k, i in enumerate(file.doc_ids) if some is None or i in some]
        yield from _batched(file, which, lambda ks: pa.RecordBatch.from_arrays([pa.array([file.doc_ids[k] for k in ks], pa.int64()), pa.array([file.ids(k).astype(np.int32) for k in ks], pa.list_(pa.int32()))], ["doc_id", "token_ids"]))

    return _scan(spark, path, made, "doc_id long, token_ids array<int>")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """number, k, doc_id, before, n_tokens, ids_crc32 of every document, from its restored ids.

    ``k`` counts documents and ``before`` ids within the file of that ``number``.
    """

    def made(_, file):
        crc = [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(len(file.doc_ids))]
        columns = [pa.array([file.number] * len(crc), pa.int64()), pa.array(range(len(crc)), pa.int64()), pa.array(file.doc_ids, pa.int64()), pa.array(np.cumsum(file.counts) - file.counts), pa.array(file.counts), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["number", "k", "doc_id", "before", "n_tokens", "ids_crc32"])

    return _scan(spark, path, made, "number long, k long, doc_id long, before long, n_tokens long, ids_crc32 long")


def starts(files: DataFrame) -> DataFrame:
    """number, first: ids of all files before each of ``files`` (number, n). Files are counted in blocks of 1,024."""
    block = F.floor(F.col("number") / 1024)
    files = files.withColumn("block", block)
    blocks = files.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("of_block"))
    within = files.withColumn("within", F.sum("n").over(Window.partitionBy("block").orderBy("number")) - F.col("n"))
    return within.join(blocks, "block").select("number", (F.col("of_block") + F.col("within")).alias("first"))


def op12(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of ``docs``, from the files that :func:`write` makes of them.

    A null text is an empty one and has the end id alone. Rows of null doc_ids come last, and rows that repeat a doc_id one after
    another in the order of a hash; a text of any length is one frame, held whole by its task. An empty table makes no
    file and no row; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "tokenfile")
    path = scratch.path("tokens")
    write(docs, path, vocabulary, end, scratch)
    told = scratch.keep(summary(docs.sparkSession, path), "summary")
    first = starts(told.groupBy("number").agg(F.sum("n_tokens").alias("n")))
    return told.join(first, "number").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
