"""Parsing patches too large for one task: segments of lines, summaries of them, and what comes before each.

:func:`diff.parse` reads a patch by windows over all of its lines. Here a patch is cut into segments of any lengths, such as
the splits of a file. All that a line must know of those before it are sums (files begun, hunks begun, lines of
each kind) and what these were at the last beginning of a file or hunk; both can be summed up for a segment alone and
composed over segments. So lines meet in windows over one segment, and only a row for each segment in a
window over a patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from . import diff
from .diff import Diff

SEGMENT = ["patch_id", "segment"]


def scan(rows: DataFrame, sums: list[str], marks: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """``rows`` (patch_id, segment, ord) with ``s_<name>``: the sum of each of ``sums`` up to a row of its patch, and for
    each mark a struct of these sums, and of more columns, at the last row up to this one where its condition holds.

    Segments follow one another in the order of their numbers, rows in that of ``ord``.
    """
    within = Window.partitionBy(*SEGMENT).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s_{c}": F.sum(c).over(within) for c in sums})
    here = lambda more: F.struct(*[F.col(f"s_{c}").alias(c) for c in sums], *more)
    rows = rows.withColumns({m: F.last(F.when(at, here(more)), ignorenulls=True).over(within) for m, (at, more) in marks.items()})
    # A row for each segment: its sums, and its last marks by sums within it.
    each = rows.groupBy(*SEGMENT).agg(*[F.sum(c).alias(f"t_{c}") for c in sums], *[F.max_by(m, "ord").alias(m) for m in marks])
    before = Window.partitionBy("patch_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({f"o_{c}": F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)) for c in sums})

    def moved(m: str) -> Column:
        """A mark of a segment by sums of the whole patch."""
        fields = [(F.col(m)[c] + F.col(f"o_{c}")).alias(c) for c in sums] + [F.col(m)[c].alias(c) for c in marks[m][1]]
        return F.when(F.col(m).isNotNull(), F.struct(*fields))

    each = each.withColumns({m: moved(m) for m in marks})
    carried = each.select(*SEGMENT, *[f"o_{c}" for c in sums], *[F.last(m, ignorenulls=True).over(before).alias(f"c_{m}") for m in marks])
    rows = rows.join(carried, SEGMENT)
    rows = rows.withColumns({m: F.coalesce(moved(m), F.col(f"c_{m}")) for m in marks} | {f"s_{c}": F.col(f"s_{c}") + F.col(f"o_{c}") for c in sums})
    return rows.drop(*[f"o_{c}" for c in sums], *[f"c_{m}" for m in marks])


def lines_of_files(spark: SparkSession, path: str) -> DataFrame:
    """patch_id, segment, ord, line of the files under ``path``, a patch each; the splits of a file are its segments.

    A file is read by as many tasks as it has splits of ``spark.sql.files.maxPartitionBytes``. Files without a line have no row.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("patch_id"), F.col("_metadata.file_block_start").alias("segment"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))
    return rows


def cut_up(patches: DataFrame, lines: int) -> DataFrame:
    """The lines of ``patches`` (patch_id, text) in segments of so many."""
    return diff.split_lines(patches.where("patch_id is not null and text is not null")).withColumn("segment", F.floor(F.col("ord") / lines))


def parse_lines(rows: DataFrame, strict_hunks: bool = False) -> Diff:
    """What :func:`diff.parse` makes of the same patches, from their lines (patch_id, segment, ord, line).

    ``ord`` orders the lines of a segment, and segments stand in the order of their numbers. Whatever the segments
    are, the files and lines are the same. Rows of null patch_ids are left out.
    """
    rows = rows.where("patch_id is not null")
    git = F.col("line").startswith("diff --git ")
    opens = git | F.col("line").startswith("--- ")
    # The first line of all that can begin a file does; later ones do where they are git's.
    place = F.struct("segment", "ord")
    of_patch = rows.groupBy("patch_id").agg(F.max(F.octet_length("line")).alias("longest"), F.min(F.when(opens, place)).alias("first"))
    judged = of_patch.select("patch_id", F.when(F.col("longest") > diff.MAX_LINE, "line too long").alias("reason"))
    sound = of_patch.where(F.col("longest") <= diff.MAX_LINE).select("patch_id", "first")
    rows = rows.join(sound, "patch_id").where(place >= F.col("first")).withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    rows = diff.tagged(rows.withColumn("starts", (git | (opens & place.eqNullSafe(F.col("first")))).cast("int")).drop("first"))
    if strict_hunks:
        rows = _owed(rows)
    kind = diff.kind_of()
    rows = rows.withColumns({"ends": diff.ending().cast("int"), **{k: F.coalesce((kind == k).cast("int"), F.lit(0)) for k in ("added", "removed", "context")}})
    rows = rows.withColumns({"o0": diff.number_of("old_start"), "n0": diff.number_of("new_start"), "section": trimmed(F.regexp_extract("line", diff._HUNK, 2))})
    rows = scan(rows, ["starts", "heads", "ends", "added", "removed", "context"], {"file": (F.col("starts") == 1, []), "hunk": (F.col("heads") == 1, ["o0", "n0", "section"])})
    since = lambda *names: sum((F.col(f"s_{c}") - F.col("hunk")[c] for c in names[1:]), F.col(f"s_{names[0]}") - F.col("hunk")[names[0]])
    rows = rows.withColumns({"file_no": F.col("s_starts"), "hunk_no": F.col("s_heads") - F.col("file")["heads"]})
    rows = rows.withColumn("kind", F.when((F.col("hunk_no") > 0) & (since("ends") == 0), kind))
    rows = rows.withColumns({
        "n0": F.col("hunk")["n0"], "section": F.col("hunk")["section"], "line_no": since("added", "removed", "context") - 1,
        "old_at": F.col("hunk")["o0"] + since("context", "removed") - F.col("context") - F.col("removed"), "new_at": F.col("hunk")["n0"] + since("context", "added") - F.col("context") - F.col("added"),
        "last_new": F.when(since("context", "added") > 0, F.col("hunk")["n0"] + since("context", "added") - 1), "ord": F.struct("segment", "ord"),
    })
    anchor = F.when(F.col("last_new") > 0, F.col("last_new")).otherwise(F.greatest("n0", F.lit(1))).cast("int")
    files, lines = diff.built(rows.withColumn("anchor_line", anchor), "anchor_line")
    return Diff(files.drop("file_no"), lines, diff.rejected(judged, files))


def _owed(rows: DataFrame) -> DataFrame:
    """Header tags inside the lines that a hunk still owes are its lines."""
    first, body = F.substring("line", 1, 1), F.col("heads") == 0
    rows = rows.withColumns({
        "old_side": (body & first.isin("-", " ", "")).cast("int"), "new_side": (body & first.isin("+", " ", "")).cast("int"),
        "owes_old": F.when(F.col("heads") == 1, diff.owed_lines(0)), "owes_new": F.when(F.col("heads") == 1, diff.owed_lines(1)),
    })
    rows = scan(rows, ["old_side", "new_side"], {"owing": (F.col("heads") == 1, ["owes_old", "owes_new"])})
    left = lambda side, owes: F.col("owing")[owes] - (F.col(f"s_{side}") - F.col(side) - F.col("owing")[side])
    owed = body & (((first == "-") & (left("old_side", "owes_old") > 0)) | ((first == "+") & (left("new_side", "owes_new") > 0)))
    rows = rows.withColumn("tag", F.when(F.coalesce(owed, F.lit(False)), "").otherwise(F.col("tag")))
    return rows.drop("old_side", "new_side", "owes_old", "owes_new", "owing", "s_old_side", "s_new_side")
