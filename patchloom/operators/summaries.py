"""Summaries that merge: counts, and sketches of distinct files and fingerprints, over batches that never meet again.

A batch leaves one row for each repository and day; rows of any batches add up. Sketches are those of the engine
(HyperLogLog), of :data:`PRECISION` bits: 4 KB a sketch, with a standard error of about 1.6 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 12
_COUNTS = ("findings", "suppressed", "critical", "high")


def summarised(findings: DataFrame, keys: tuple[str, ...] = ("repo", "day")) -> DataFrame:
    """``keys``, counts and sketches of ``findings`` (the keys, file, fingerprint, severity, suppressed, score)."""
    sketch = lambda c: F.hll_sketch_agg(c, PRECISION).alias(f"{c}s")
    level = lambda s: F.count_if((F.col("severity") == s) & ~F.col("suppressed")).alias(s)
    counts = (F.count("*").alias("findings"), F.count_if("suppressed").alias("suppressed"), level("critical"), level("high"))
    return findings.groupBy(*keys).agg(*counts, F.max("score").alias("worst"), sketch("file"), sketch("fingerprint"))


def merged(summaries: DataFrame, keys: tuple[str, ...] = ("repo", "day")) -> DataFrame:
    """Rows of any number of batches added up by ``keys``, which may be fewer than those they were made by."""
    union = lambda c: F.hll_union_agg(c).alias(c)
    return summaries.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _COUNTS], F.max("worst").alias("worst"), union("files"), union("fingerprints"))


def told(summaries: DataFrame) -> DataFrame:
    """``summaries`` with estimates of distinct files and fingerprints in place of the sketches."""
    return summaries.withColumns({c: F.hll_sketch_estimate(c) for c in ("files", "fingerprints")})
