"""Unified diffs as relations: patches -> lines with their files and hunks.

Every step is a window over one patch in line order, so patches are parsed in parallel and one shuffle by
patch_id serves them all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Bytes that a line of a patch may have.
MAX_LINE = 1 << 20
#: What the header lines of a file start with, in the order they are tried.
_HEADERS = ["diff --git ", "old mode ", "new mode ", "new file mode ", "deleted file mode ", "rename from ", "rename to ", "copy from ", "copy to ", "Binary files ", "GIT binary patch", "--- ", "+++ ", "@@"]
_ESCAPES = {"a": "07", "b": "08", "f": "0C", "n": "0A", "r": "0D", "t": "09", "v": "0B"}


def unquoted(path: Column) -> Column:
    """A path without C-style quotes: escapes and octal bytes become what they stand for."""
    body = F.substring(path, F.lit(2), F.length(path) - 2)
    parts = F.regexp_extract_all(body, F.lit(r"(?s)(\\[0-3][0-7]{2}|\\.|[^\\]+|\\$)"), F.lit(1))

    def hexed(p: Column) -> Column:
        letter = F.substring(p, 2, 1)
        known = F.element_at(F.create_map(*[F.lit(x) for kv in _ESCAPES.items() for x in kv]), letter)
        octal = F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")
        raw = lambda x: F.hex(F.encode(x, "UTF-8"))
        return F.when(p.rlike(r"^\\[0-3][0-7]{2}$"), octal).when(p.rlike(r"(?s)^\\."), F.coalesce(known, raw(letter))).otherwise(raw(p))

    text = F.decode(F.unhex(F.array_join(F.transform(parts, hexed), "")), "UTF-8")
    return F.when(path.rlike(r'(?s)^".*"$') & (F.length(path) > 1), text).otherwise(path)


def unprefixed(path: Column) -> Column:
    """Without the one-letter folder that git puts before each side; the null device has no path."""
    return F.when(path == "/dev/null", "").otherwise(F.regexp_replace(path, "^[abiwco]/", ""))


def header_paths(rest: Column) -> tuple[Column, Column]:
    """Both paths of a file header: quoted, two words, or parted where the second begins with b/."""
    quoted = F.regexp_extract(rest, r'(?s)^("(?:[^"\\]|\\.)*")', 1)
    after = trimmed(F.substring(rest, F.length(quoted) + 1, F.lit(1 << 30)))
    words = F.filter(F.split(trimmed(rest), r"\s+"), lambda w: w != "")
    n = F.size(words)
    at = F.array_position(F.transform(F.slice(words, 2, F.greatest(n - 1, F.lit(1))), lambda w: w.startswith("b/")), True).cast("int")
    parted = (n > 2) & (at > 0) & F.get(words, F.lit(0)).startswith("a/")
    left = F.when(parted, F.array_join(F.slice(words, F.lit(1), at), " ")).otherwise(F.get(words, F.lit(0)))
    right = F.when(parted, F.array_join(F.slice(words, at + 1, F.greatest(n - at, F.lit(0))), " ")).otherwise(F.try_element_at(words, F.lit(-1)))
    plain = lambda x: F.when(n > 0, unprefixed(x)).otherwise("")
    return (F.when(quoted != "", unprefixed(unquoted(quoted))).otherwise(plain(left)), F.when(quoted != "", unprefixed(unquoted(after))).otherwise(plain(right)))


@dataclass
class Diff:
    """``lines``: every hunk line with its file; ``files``: a row per file; ``rejected``: patches not parsed."""

    files: DataFrame
    lines: DataFrame
    rejected: DataFrame


def split_lines(patches: DataFrame) -> DataFrame:
    """patch_id, ord, line: what is between line feeds, without one carriage return at the end."""
    rows = patches.select("patch_id", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)).alias("ord", "line"))
    return rows.select("patch_id", "ord", F.regexp_replace("line", r"\r\z", "").alias("line"))


def parse(patches: DataFrame, strict_hunks: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Diff:
    """The files and lines of ``patches`` (patch_id, text). Both are read from the same rows, which ``keep`` may write.

    Header lines count wherever they stand, so a removed line ``-- x`` reads as an old path; with
    ``strict_hunks`` they count only where the hunk's header says that its lines have ended. Patches with a line
    of more than :data:`MAX_LINE` bytes, without any file, with a null text or id are rejected with a reason.
    """
    patches = patches.select(F.col("patch_id"), F.col("text"))
    long = F.exists(F.split("text", "\n", -1), lambda x: F.octet_length(x) > MAX_LINE)
    reason = F.when(F.col("patch_id").isNull(), "no patch_id").when(F.col("text").isNull(), "no text").when((F.octet_length("text") > MAX_LINE) & long, "line too long")
    judged = patches.withColumn("reason", reason)
    rows = split_lines(judged.where("reason is null"))
    by_patch = Window.partitionBy("patch_id").orderBy("ord")
    before = by_patch.rowsBetween(Window.unboundedPreceding, -1)
    git = F.col("line").startswith("diff --git ")
    opens = git | F.col("line").startswith("--- ")
    rows = rows.withColumn("begun", F.coalesce(F.max(opens.cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("starts", (git | ((F.col("begun") == 0) & opens)).cast("int"))
    rows = tagged(rows.withColumn("file_no", F.sum("starts").over(by_patch)).where("file_no > 0").drop("begun"))
    if strict_hunks:
        rows = _within_counts(rows)
    by_file = Window.partitionBy("patch_id", "file_no").orderBy("ord")
    rows = rows.withColumn("hunk_no", F.sum("heads").over(by_file))
    by_hunk = Window.partitionBy("patch_id", "file_no", "hunk_no").orderBy("ord")
    so_far = by_hunk.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("closed", F.max(ending().cast("int")).over(by_hunk))
    rows = rows.withColumn("kind", F.when((F.col("hunk_no") > 0) & (F.col("closed") == 0), kind_of()))
    head = lambda c: F.first(c).over(by_hunk)
    rows = rows.withColumn("o0", head(number_of("old_start"))).withColumn("n0", head(number_of("new_start")))
    rows = rows.withColumn("section", head(F.when(F.col("heads") == 1, trimmed(F.regexp_extract("line", _HUNK, 2)))))
    moved = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(so_far), F.lit(0))
    rows = rows.withColumn("old_at", F.col("o0") + moved("context", "removed")).withColumn("new_at", F.col("n0") + moved("context", "added"))
    rows = rows.withColumn("line_no", F.sum(F.col("kind").isNotNull().cast("int")).over(by_hunk) - 1)
    # What a line needs of its file is found in the same windows, so lines are exchanged once and joined with nothing.
    whole = Window.partitionBy("patch_id", "file_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    old_path, path, binary = (c.over(whole) for c in _places())
    rows = rows.withColumns({"path": F.coalesce(path, old_path, F.lit("")), "binary": binary})
    rows = rows.withColumn("file_idx", (F.sum(((F.col("starts") == 1) & (F.col("path") != "")).cast("int")).over(by_patch) - 1).cast("int"))
    rows = rows.withColumn("_new", F.when(F.col("kind").isin("context", "added") & (F.col("new_at") > 0), F.col("new_at")))
    rows = rows.withColumn("anchor_line", F.coalesce(F.last("_new", ignorenulls=True).over(by_hunk), F.greatest("n0", F.lit(1))).cast("int"))
    rows = keep(rows.select("patch_id", "file_no", "ord", "line", "tag", "heads", "kind", "hunk_no", "line_no", "old_at", "new_at", "n0", "section", "path", "binary", "file_idx", "anchor_line"))
    files = _files(rows.drop("path", "binary", "file_idx").withColumn("line", F.when(F.col("tag") != "", F.col("line"))))
    lines = _lines(rows.where("path <> ''"), "file_idx", "path", "binary", "anchor_line").drop("file_no")
    return Diff(files.drop("file_no"), lines.select("patch_id", *[c for c in lines.columns if c not in ("patch_id", "anchor_line")], "anchor_line"), rejected(judged, files))


def built(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Files, and lines with ``more`` columns, of rows that know their file, hunk, kind and places."""
    files = _files(rows)
    return files, _lines(rows, *more).join(files.select("patch_id", "file_no", "file_idx", "path", "binary"), ["patch_id", "file_no"]).drop("file_no")


def _lines(rows: DataFrame, *more: str) -> DataFrame:
    return rows.where("kind is not null").select(
        "patch_id", "file_no", (F.col("hunk_no") - 1).cast("int").alias("hunk_idx"), F.col("line_no").cast("int").alias("line_idx"), "kind",
        F.when(F.col("line") == "", "").otherwise(F.substring("line", F.lit(2), F.length("line"))).alias("text"),
        F.when(F.col("kind") == "added", 0).otherwise(F.col("old_at")).cast("int").alias("old_line"), F.when(F.col("kind") == "removed", 0).otherwise(F.col("new_at")).cast("int").alias("new_line"),
        F.col("section"), F.col("n0").alias("new_start"), *more,
    )


def rejected(judged: DataFrame, files: DataFrame) -> DataFrame:
    """patch_id, reason of patches with a reason, and of those that have no file."""
    none = judged.where("reason is null").join(files.select("patch_id").distinct(), "patch_id", "left_anti").select("patch_id", F.lit("no file changes found").alias("reason"))
    return judged.where("reason is not null").select("patch_id", "reason").union(none)


#: A hunk's header: what stands between the signs, and the section after them.
_HUNK = r"^@@(.*?)@@(.*)$"


def _ranges() -> Column:
    return F.split(trimmed(F.regexp_extract("line", _HUNK, 1)), r"\s+")


def tagged(rows: DataFrame) -> DataFrame:
    """``rows`` (line) with tag, the header a line begins with; old_start and new_start of a hunk's header; heads, 1 for a sound one."""
    tag = F.lit("")
    for h in reversed(_HEADERS):
        tag = F.when(F.col("line").startswith(h), h).otherwise(tag)
    ranges, number = _ranges(), r"([+-]?\d{1,9})(?:,[+-]?\d{1,9})?$"
    # The null-safe access matters: a broken header has fewer ranges.
    old, new = F.get(ranges, F.lit(0)), F.get(ranges, F.lit(1))
    start = lambda x, sign: F.regexp_extract(F.coalesce(x, F.lit("")), f"^[{sign}]{number}", 1)
    rows = rows.withColumn("tag", tag).withColumn("old_start", F.when(F.col("tag") == "@@", start(old, "-")).otherwise("")).withColumn("new_start", F.when(F.col("tag") == "@@", start(new, "+")).otherwise(""))
    return rows.withColumn("heads", ((F.col("old_start") != "") & (F.col("new_start") != "")).cast("int"))


def ending() -> Column:
    """Whether a tagged line ends its hunk."""
    binary = F.col("tag").isin("Binary files ", "GIT binary patch")
    return binary | ((F.col("tag") == "") & ~F.substring("line", 1, 1).isin("+", "-", " ", "\\", ""))


def kind_of() -> Column:
    """What a tagged line is inside a hunk; null for headers and other lines."""
    first = F.substring("line", 1, 1)
    return F.when(F.col("tag") == "", F.when(first == "+", "added").when(first == "-", "removed").when(first.isin(" ", ""), "context"))


def number_of(start: str) -> Column:
    """The line number that a hunk's header gives; zero counts as one."""
    return F.when(F.col(start).rlike("^[+-]?0+$"), 1).otherwise(F.col(start).try_cast("int"))


def owed_lines(k: int) -> Column:
    """How many lines of one side a hunk's header announces."""
    return F.coalesce(F.regexp_extract(F.get(_ranges(), F.lit(k)), r"^[-+]\d+,(\d+)$", 1).try_cast("int"), F.lit(1))


def _within_counts(rows: DataFrame) -> DataFrame:
    """Header tags inside the lines that a hunk still owes are its lines."""
    by_patch = Window.partitionBy("patch_id").orderBy("ord")
    sized = rows.withColumn("seq", F.sum("heads").over(by_patch)).withColumn("owes_old", F.when(F.col("heads") == 1, owed_lines(0))).withColumn("owes_new", F.when(F.col("heads") == 1, owed_lines(1)))
    at = Window.partitionBy("patch_id", "seq").orderBy("ord")
    first = F.substring("line", 1, 1)
    body = F.col("heads") == 0
    done = lambda signs: F.coalesce(F.sum((body & first.isin(*signs)).cast("int")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    old_left, new_left = F.first("owes_old").over(at) - done(("-", " ", "")), F.first("owes_new").over(at) - done(("+", " ", ""))
    owed = (F.col("seq") > 0) & body & (((first == "-") & (old_left > 0)) | ((first == "+") & (new_left > 0)))
    return sized.withColumn("owed", F.coalesce(owed, F.lit(False))).withColumn("tag", F.when(F.col("owed"), "").otherwise(F.col("tag"))).drop("seq", "owes_old", "owes_new", "owed")


def _value(tag: str) -> Column:
    return F.when(F.col("tag") == tag, trimmed(F.substring("line", F.lit(len(tag) + 1), F.length("line"))))


def _side(tag: str) -> Column:
    return F.substring_index(_value(tag), "\t", 1)


def _places() -> tuple[Column, Column, Column]:
    """The old path, the path and whether it is binary, over the rows of a file; null where no header says."""
    value, side = _value, _side
    path_of = lambda tag: F.when(side(tag) != "/dev/null", unprefixed(unquoted(side(tag))))
    head_old, head_new = (F.when(F.col("tag") == "diff --git ", x) for x in header_paths(value("diff --git ")))
    written = lambda *cs: F.max_by(F.coalesce(*cs), F.when(F.coalesce(*cs, F.lit("")) != "", F.col("ord")))
    old = written(head_old, F.when(F.col("tag").isin("rename from ", "copy from "), unquoted(F.coalesce(value("rename from "), value("copy from ")))), path_of("--- "))
    new = written(head_new, F.when(F.col("tag").isin("rename to ", "copy to "), unquoted(F.coalesce(value("rename to "), value("copy to ")))), path_of("+++ "))
    return old, new, F.max(F.col("tag").isin("Binary files ", "GIT binary patch"))


def _files(rows: DataFrame) -> DataFrame:
    value, side = _value, _side
    old_path, path, binary = _places()
    status = F.when((F.col("tag") == "new file mode ") | (side("--- ") == "/dev/null"), "created").when((F.col("tag") == "deleted file mode ") | (side("+++ ") == "/dev/null"), "deleted")
    status = status.when(F.col("tag").isin("rename from ", "rename to "), "renamed")
    mode = lambda *tags: F.coalesce(F.max_by(F.coalesce(*map(value, tags)), F.when(F.col("tag").isin(*tags), F.col("ord"))), F.lit(""))
    files = rows.groupBy("patch_id", "file_no").agg(
        old_path.alias("old_path"), path.alias("path"), F.max_by(status, F.when(status.isNotNull(), F.col("ord"))).alias("status"), binary.alias("binary"),
        mode("old mode ", "deleted file mode ").alias("old_mode"), mode("new mode ", "new file mode ").alias("new_mode"),
        F.count_if(F.col("kind") == "added").alias("additions"), F.count_if(F.col("kind") == "removed").alias("deletions"),
        F.min_by("n0", F.when(F.col("heads") == 1, F.col("ord"))).alias("first_start"),
    )
    files = files.withColumn("old_path", F.coalesce("old_path", F.lit(""))).withColumn("path", F.coalesce("path", F.col("old_path"))).where("path <> ''")
    moved = F.col("status").isNull() & (F.col("old_path") != "") & (F.col("old_path") != F.col("path"))
    files = files.withColumn("status", F.when(moved, "renamed").otherwise(F.coalesce("status", F.lit("modified"))))
    files = files.withColumn("old_path", F.when((F.col("status") != "renamed") & (F.col("old_path") == F.col("path")), "").otherwise(F.col("old_path")))
    idx = F.row_number().over(Window.partitionBy("patch_id").orderBy("file_no")) - 1
    return files.withColumn("file_idx", idx)


def with_anchors(lines: DataFrame) -> DataFrame:
    """``lines`` with anchor_line: the last line of the new file at or above each, from the hunk's start on."""
    hunk = Window.partitionBy("patch_id", "file_idx", "hunk_idx").orderBy("line_idx")
    last = F.last(F.when(F.col("new_line") > 0, F.col("new_line")), ignorenulls=True).over(hunk)
    return lines.withColumn("anchor_line", F.coalesce(last, F.greatest("new_start", F.lit(1))).cast("int"))


def totals(files: DataFrame) -> DataFrame:
    """patch_id, files, additions, deletions."""
    return files.groupBy("patch_id").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
