"""Changes made of documents, for queries over tables that hold no patches, in Spark and in DuckDB's SQL.

A document is a file of the patch doc_id div 20, its lines are dealt to hunks of 20, and kinds, file states and
suppression notes follow from positions, so that both engines derive the same relation from the same table.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import MARKER
from ..operators.diff import with_anchors
from ..sources.rules import RuleSet, compile_set, parse_pack

EXTENSIONS = [".py", ".go", ".tf", ".yml", ".md"]
NOTE = f" # {MARKER}[corpus.*] vetted"


def rules() -> RuleSet:
    return compile_set([parse_pack((resources.files("patchloom") / "plans" / "corpus_rules.yaml").read_text(encoding="utf-8"), "corpus")])


def _keys(docs: DataFrame) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    state = F.when(F.col("doc_id") % 4 == 0, "created").when(F.col("doc_id") % 4 == 1, "deleted").otherwise("modified")
    return docs.select(
        F.floor(F.col("doc_id") / 20).alias("patch_id"), (F.col("doc_id") % 20).cast("int").alias("file_idx"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("path"), state.alias("status"), F.lit(False).alias("binary"), "doc_id", "text",
    )


def split_lines(docs: DataFrame) -> DataFrame:
    """The lines of ``docs`` (keyed documents) with their hunks, without numbers."""
    rows = docs.select("*", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).drop("text")
    kind = F.when(F.col("pos") % 7 == 3, "removed").when(F.col("pos") % 7 == 5, "context").otherwise("added")
    note = F.when((F.col("doc_id") + F.col("pos")) % 9 == 4, NOTE).otherwise("")
    rows = rows.withColumns({
        "hunk_idx": F.floor(F.col("pos") / 20).cast("int"), "line_idx": (F.col("pos") % 20).cast("int"), "kind": kind, "text": F.concat("raw", note),
    })
    rows = rows.withColumn("section", F.when(F.col("hunk_idx") % 3 == 1, F.concat(F.lit("func handler_"), F.col("doc_id").cast("string"))).otherwise("")).withColumn("new_start", F.col("hunk_idx") * 20 + 1)
    return rows.drop("raw", "pos", "doc_id")


def by_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, all of a patch in one task: documents are exchanged as they are, before they are split."""
    return split_lines(_keys(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")).repartition("patch_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents' changes."""
    rows = split_lines(_keys(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    so_far = Window.partitionBy("patch_id", "file_idx", "hunk_idx").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda *k: F.coalesce(F.sum(F.col("kind").isin(*k).cast("int")).over(so_far), F.lit(0)) + F.col("new_start")
    rows = rows.withColumns({
        "old_line": F.when(F.col("kind") == "added", 0).otherwise(moved("context", "removed")).cast("int"), "new_line": F.when(F.col("kind") == "removed", 0).otherwise(moved("context", "added")).cast("int"),
    })
    return with_anchors(rows)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all documents' changes."""
    docs = _keys(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.size(F.split("text", "\n", -1))
    # Of n lines at positions 0 to n - 1: those at 3 and at 5 of each 7.
    at = lambda k: F.floor((n - k - 1 + 7) / 7)
    return docs.where("text is not null").select(
        "patch_id", "file_idx", "path", "status", "binary", F.lit("").alias("old_path"), (n - at(3) - at(5)).cast("int").alias("additions"), at(3).cast("int").alias("deletions"), F.lit(1).alias("first_start")
    )


_EXT = "['" + "', '".join(EXTENSIONS) + "']"
#: The same relations as common table expressions: ln (lines) and fl (files).
SQL = f"""
src AS (SELECT doc_id // 20 AS patch_id, (doc_id % 20)::INT AS file_idx, doc_id, source || '/' || lang || '/doc_' || doc_id || {_EXT}[(doc_id % 5 + 1)::INT] AS path,
  CASE doc_id % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'deleted' ELSE 'modified' END AS status, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
rw AS (SELECT * EXCLUDE (parts), unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM src),
l0 AS (SELECT patch_id, file_idx, (pos // 20)::INT AS hunk_idx, (pos % 20)::INT AS line_idx, path, status,
  CASE pos % 7 WHEN 3 THEN 'removed' WHEN 5 THEN 'context' ELSE 'added' END AS kind,
  raw || CASE WHEN (doc_id + pos) % 9 = 4 THEN '{NOTE}' ELSE '' END AS text,
  CASE WHEN (pos // 20) % 3 = 1 THEN 'func handler_' || doc_id ELSE '' END AS section, ((pos // 20) * 20 + 1)::INT AS new_start FROM rw),
l1 AS (SELECT *, new_start + coalesce(sum((kind IN ('context', 'removed'))::INT) OVER w, 0) AS o, new_start + coalesce(sum((kind IN ('context', 'added'))::INT) OVER w, 0) AS n FROM l0
  WINDOW w AS (PARTITION BY patch_id, file_idx, hunk_idx ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT * EXCLUDE (o, n), (CASE WHEN kind = 'added' THEN 0 ELSE o END)::INT AS old_line, (CASE WHEN kind = 'removed' THEN 0 ELSE n END)::INT AS new_line FROM l1),
ln AS (SELECT *, coalesce(last_value(CASE WHEN new_line > 0 THEN new_line END IGNORE NULLS) OVER w, greatest(new_start, 1))::INT AS anchor_line, lag(text) OVER w AS prev_text FROM l2
  WINDOW w AS (PARTITION BY patch_id, file_idx, hunk_idx ORDER BY line_idx)),
fl AS (SELECT patch_id, file_idx, any_value(path) AS path, any_value(status) AS status, count(*) FILTER (kind = 'added') AS additions, count(*) FILTER (kind = 'removed') AS deletions FROM ln GROUP BY ALL)
"""
