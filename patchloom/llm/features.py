"""Labelled samples and hashed text features for the classifiers.

Features are computed from the text alone. A training sample is bounded in rows and bytes by parameters: its rows
are the ones of the smallest hashes of doc_id among the documents that are labelled and not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._store import lean


#: Bytes of text in a sample, at most: rows beyond are left out of it.
SAMPLE_BYTES = 64 << 20


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids have the remainder of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """(doc_id, text, y): at most ``most`` labelled rows outside ``held_out``, one a doc_id.

    Only documents of the table count against the bound. Rows with a null id or label are no examples, and a doc_id
    with both labels is none; of several texts of a doc_id one is taken, by its hash.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    there = texts.select("doc_id", F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).alias("one")).where("doc_id is not null")
    there = there.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("one").alias("one"))
    rows = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y", "one.h", "one.n").collect()
    chosen, size = [], 0
    for r in rows:
        if size + r["n"] <= SAMPLE_BYTES:
            chosen.append((r["doc_id"], r["y"], r["h"]))
            size += r["n"]
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int, h long")
    return texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "y")


def sets_of(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (feature, text) with their counts, sorted by text: (features, counts, n + 1 offsets)."""
    order = np.argsort(of.astype(np.uint64) << np.uint64(40) | h.astype(np.uint64))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    return h[at], counts, np.searchsorted(of[at], np.arange(n + 1))


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each text's values as bytes."""
    return pa.array([values[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())


def collected(rows: DataFrame, featurise, schema: str) -> list:
    """The sample's features on the driver, which fits the model; rows are as many as the sample has."""

    lean(rows.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b, data, off in X.slices(batch.column("text")):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), "y": batch.column("y").slice(a, b - a)} | featurise(data, off))

    return sorted(rows.mapInArrow(run, f"doc_id long, y int, {schema}").collect(), key=lambda r: (r["doc_id"], r["y"]))


def scores(docs: DataFrame, score, model, carried: list[str]) -> DataFrame:
    """The columns ``carried`` of ``docs`` and a score of the text for every row; ``score(model, data, off)`` runs on slices."""
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField("_score", T.DoubleType())])
    # The text is sent once, whether it is carried or not.
    at = carried.index("text") if "text" in carried and isinstance(docs.schema["text"].dataType, T.StringType) else len(carried)

    def run(batches):
        for batch in batches:
            for a, b, data, off in X.slices(batch.column(at)):
                kept = [batch.column(k).slice(a, b - a) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score(shared.value, data, off).astype(np.float64))], [*carried, "_score"])

    return docs.select(*carried, *([F.col("text").cast("string").alias("_text")] if at == len(carried) else [])).mapInArrow(run, schema)


def scored(docs: DataFrame, score, held_out: Column, at: float, model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scores(docs, score, model, ["doc_id"]).withColumnRenamed("_score", "score")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
