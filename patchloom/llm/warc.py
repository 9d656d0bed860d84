"""WARC archives: captures written as request, response or revisit, and metadata records, and assembled again.

Records are built and written by the engine itself: the text writer puts CR LF CR LF after each record, which is how
the format ends one. Files are bounded in bytes, but for a single larger record. Reading parses whole files by the
records' Content-Length, so payloads may hold any separator; what is damaged is told and reading goes on at the next
record. The records of one capture are joined through WARC-Concurrent-To, whichever of them states it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch

CRLF = "\r\n"
#: Bytes of payload that a capture of a file has at most, and records of such a file, each for four times the bytes
#: and a quarter of the records: files stay near 64 MB.
LEAST_BYTES, PER_FILE, CLASSES = 1 << 16, 3072, 6
#: base32 digits of the engine's number conversion, and those of RFC 4648.
_DIGITS, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, "
    "content_type string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary, error string"
)


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes, without padding: 160 bits are 32 digits."""
    hexed = F.sha1(F.encode(text, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _RFC)


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise("") for k, v in headers]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def _id(kind: str) -> Column:
    """A record id that a retried task makes again: a name-based one of the page and its payload."""
    h = F.sha1(F.concat_ws("|", F.lit(kind), F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.col("digest")))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12)), F.lit(">"))


def write(pages: DataFrame, path: str, scratch: Scratch, date: str = "2024-01-01T00:00:00Z", least: int = 0) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``, three records a page.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id is a response and the
    others are revisits of it without a payload; smaller payloads are all responses, and so are all rows of that
    largest page_id. A null page_id is never the largest: such a row revisits the response that has its payload, or
    is a response where only null page_ids have it. A null html is empty, a null url is left out. Rows that repeat a
    page_id are captures of their own, each by its own payload.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    noted = pages.select("page_id", sha1_base32(F.col("html")).alias("digest"), F.octet_length("html").alias("n"))
    noted = scratch.keep(noted, "digests")
    owner = noted.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"))
    owner = scratch.keep(owner.where("copies > 1 and owner is not null").select("digest", "owner"), "owners")
    again = noted.join(owner, "digest").where("not page_id <=> owner").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "owner").distinct()
    again = scratch.keep(again, "revisits")
    rows = pages.withColumn("digest", sha1_base32(F.col("html")))
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["_page"]) & (rows["digest"] == again["_digest"]), "left").drop("_page", "_digest")
    # As many rows as there are classes.
    present = sorted(r["k"] for r in noted.select(_size_class(F.col("n")).alias("k")).distinct().collect())
    http = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF * 2)
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    revisit = F.col("owner").isNotNull()
    when = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))]
    page = ("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    reply = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", _id("response")), *when, ("WARC-Payload-Digest", digest),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("X-Payload-Length", F.octet_length("html").cast("string")), ("X-Refers-To-Page", F.col("owner").cast("string")), ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    ask = [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _id("request")), *when, ("WARC-Concurrent-To", _id("response")), ("Content-Type", F.lit("application/http; msgtype=request"))]
    note = [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _id("metadata")), *when, ("WARC-Concurrent-To", _id("response")), page, ("Content-Type", F.lit("application/warc-fields"))]
    records = F.array(
        _record(ask, F.concat(F.lit("GET "), F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)?$", 1), F.lit("/")), F.lit(" HTTP/1.1" + CRLF * 2))),
        _record(reply, F.concat(http, F.when(revisit, "").otherwise(F.col("html")))),
        _record(note, F.concat(F.lit("fetchTimeMs: 0" + CRLF))),
    )
    for k in present:
        out = rows.where(_size_class(F.octet_length("html")) == k).select(F.explode(records).alias("value"))
        out.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(3, PER_FILE >> 2 * k)).text(path)


def _size_class(n: Column) -> Column:
    """0 for payloads of up to LEAST_BYTES, one more for each four times as many, CLASSES - 1 at most."""
    out = F.lit(CLASSES - 1)
    for k in reversed(range(CLASSES - 1)):
        out = F.when(n <= LEAST_BYTES << 2 * k, k).otherwise(out)
    return out


def _inflated(raw: bytes) -> tuple[bytes, str | None]:
    """A file's bytes, and what is wrong with it: plain, one gzip member, or a member a record."""
    if raw[:2] != b"\x1f\x8b":
        return raw, None
    out, error = [], None
    while raw:
        one = zlib.decompressobj(31)
        try:
            out.append(one.decompress(raw) + one.flush())
        except zlib.error as e:
            error = f"broken gzip member: {e}"
            break
        if not one.eof:
            error = "gzip member cut short"
            break
        raw = one.unused_data.lstrip(b"\0")
        if raw and raw[:2] != b"\x1f\x8b":
            error = f"{len(raw)} bytes after the last gzip member"
            break
    return b"".join(out), error


def _next(raw: bytes, at: int) -> int:
    """Where the next line that begins a record begins."""
    found = raw.find(b"\nWARC/", at)
    return len(raw) if found < 0 else found + 1


def parse(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], memoryview, str | None]]:
    """(headers, block, what is wrong) of each record. Bytes that are no record make one without headers; a record
    without a length reaches to the next record, and a cut block is as long as it is."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(raw):
            return
        end = raw.find(b"\r\n\r\n", at)
        if raw[at : at + 5] != b"WARC/" or end < 0:
            stop = _next(raw, at)
            yield [], view[at:stop], f"{stop - at} bytes that are no record"
            at = stop
            continue
        lines = raw[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]
        size = dict(headers).get("content-length", "")
        begin = end + 4
        if size.isascii() and size.isdigit():
            at = begin + int(size)
            error = None if at <= len(raw) else f"block cut short by {at - len(raw)} bytes"
        else:
            at, error = _next(raw, begin), "no Content-Length"
        yield headers, view[begin : min(at, len(raw))], error


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``; payloads are what follows the HTTP header of a response.

    Digest and length are those of the payload as read; a revisit has those its header states. ``error`` says what
    is wrong with a record; bytes that are no record, and broken archives, are rows without a record_type. Without
    ``payloads`` the column is null, which spares moving the bodies.
    """

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                body, error = _inflated(raw.as_buffer().to_pybytes())
                rows, size = [], 0
                for headers, block, wrong in parse(body):
                    rows.append(_row(headers, block, wrong, payloads))
                    size += len(block) if payloads else 0
                    if len(rows) >= 1024 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
                if error:
                    rows.append(_row([], memoryview(b""), error, False))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    spark_files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return spark_files.select("content").mapInArrow(run, RECORD)


_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string()))]
    + [(n, pa.string()) for n in ("refers_to", "target_uri", "content_type", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string())]
)


def _row(stated: list[tuple[str, str]], block: memoryview, error: str | None, payloads: bool) -> dict:
    headers: dict[str, str] = {}
    for k, v in stated:
        headers[k] = f"{headers[k]}, {v}" if k in headers else v
    kind = headers.get("warc-type")
    body, digest, size = None, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    if kind == "response":
        raw = bytes(block)
        cut = raw.find(b"\r\n\r\n")
        body = raw[cut + 4 :] if cut >= 0 and "http" in headers.get("content-type", "") else raw
        digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
    elif kind == "revisit":
        length = headers.get("x-payload-length", "")
        size = int(length) if length.isascii() and length.isdigit() else None
    return {
        "record_id": headers.get("warc-record-id"), "record_type": kind, "concurrent_to": [v for k, v in stated if k == "warc-concurrent-to"], "refers_to": headers.get("x-refers-to-page"),
        "target_uri": headers.get("warc-target-uri"), "content_type": headers.get("content-type"), "payload_digest": digest, "payload_bytes": size,
        "headers": list(headers.items()), "payload": body if payloads else None, "error": error,
    }


def captures_of(records: DataFrame, scratch: Scratch) -> DataFrame:
    """(record_id, capture): the response, or other main record, that each request and metadata record belongs to.

    Directly where either names the other, the first by record_id where several do, or through other records of
    the capture. Those that reach no main record are not in the result.
    """
    beside = F.col("record_type").isin("request", "metadata")
    known = scratch.keep(records.where("record_id is not null and record_type is not null").select("record_id", beside.alias("beside"), "concurrent_to"), "links")
    main, side = known.where("not beside"), known.where("beside")
    named = side.select("record_id", F.explode("concurrent_to").alias("capture"))
    naming = main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture")).join(side.select("record_id"), "record_id", "left_semi")
    direct = named.join(main.select(F.col("record_id").alias("capture")).distinct(), "capture").select("record_id", "capture").unionByName(naming)
    found = scratch.keep(direct.groupBy("record_id").agg(F.min("capture").alias("capture")), "captures")
    left = scratch.keep(side.join(found, "record_id", "left_anti").select("record_id").distinct(), "left")
    if left.isEmpty():
        return found
    pairs = named.select(F.col("record_id").alias("a"), F.col("capture").alias("b"))
    pairs = scratch.keep(pairs.union(pairs.select("b", "a")).distinct(), "pairs")
    while not left.isEmpty():
        step = pairs.join(left.select(F.col("record_id").alias("a")), "a").join(found.select(F.col("record_id").alias("b"), "capture"), "b")
        step = scratch.keep(step.groupBy(F.col("a").alias("record_id")).agg(F.min("capture").alias("capture")), "captures")
        if step.isEmpty():
            break
        left = scratch.keep(left.join(step, "record_id", "left_anti"), "left")
        found = found.unionByName(step)
    return found


def assemble(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata (arrays of structs, in record_id order).

    ``response`` is the capture's main record: a response, a revisit or a record of another type. Requests and
    metadata, which are small, are gathered first and joined to it, so payloads are moved once. Those of no main
    record make captures with a null response. Rows without a record_type, which only tell of damage, are left out.
    """
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("record_type") == kind, F.struct("record_id", "record_type", "target_uri", "content_type", F.to_json("headers").alias("headers")))))
    records = records.where("record_type is not null")
    beside = F.col("record_type").isin("request", "metadata")
    side = records.where(beside).drop("payload").join(captures_of(records, scratch), "record_id", "left")
    side = side.groupBy(F.coalesce("capture", F.get("concurrent_to", F.lit(0)), "record_id").alias("capture_id")).agg(of("request").alias("request"), of("metadata").alias("metadata"))
    main = records.where(~beside).select(F.col("record_id").alias("capture_id"), F.struct(*[c for c in records.columns if c != "concurrent_to"]).alias("response"))
    return main.join(side, "capture_id", "full")


def op4(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every row of ``pages``, read back from
    the archives that :func:`write` makes of them. Null, repeated and tied page_ids: see there; other columns are
    not read; an empty table makes no archive and no row."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write(pages, path, scratch)
    if pages.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = scratch.keep(read(pages.sparkSession, path, payloads=False), "records")
    captures = assemble(records, scratch).where("response is not null")
    page = F.get_json_object(F.get("metadata", F.lit(0))["headers"], "$.x-page-id")
    return captures.select(
        page.try_cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.col("response.refers_to").try_cast("long").alias("refers_to"),
    )
