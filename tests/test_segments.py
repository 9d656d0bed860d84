"""Patches parsed in segments are the same as parsed whole, whatever the segments."""

import random

import pytest

from patchloom.operators import diff, segments
from patchloom.sources.patches import from_texts

from .test_diff import BASIC

PIECES = [
    "diff --git a/x.go b/x.go", "--- a/x.go", "+++ b/x.go", "@@ -10,3 +10,4 @@ func main() {", "@@ -1 +1 @@", "@@ -0,0 +1,2 @@", "@@ nonsense @@", " same", "-old", "+new", "", "\\ No newline at end of file", "--- removed dashes",
    "+++ added pluses", "new file mode 100644", "deleted file mode 100755", "rename from a", "rename to b", "Binary files a/x and b/x differ", "GIT binary patch", "prose", "-", "+", "+x\r", "diff --git \"a/q\\303\\251\" \"b/q\\303\\251\"", "--- /dev/null", "+++ /dev/null",
]


def texts():
    rng = random.Random(11)
    out = {"basic": BASIC, "empty": "", "prose": "a\nb\n", "feeds": "\n\n", "bare": "junk\n--- a/x\t2020-01-01\n+++ b/x\n@@ -1 +1 @@\n-a\r\n+b\r\n--- a/y\n+++ b/y\n@@ -3 +3 @@\n+c", "early": "@@ -1,9 +1,9 @@\n-x\n--- a/y\n+++ b/y\n@@ -1,2 +1,2 @@\n--- z\n+q\n"}
    for k in range(70):
        out[f"r{k}"] = "\n".join(rng.choices(PIECES, weights=[4, 2, 2, 4, 3, 1, 1, 8, 8, 8, 1, 1, 1, 1, *[1] * 13][: len(PIECES)], k=rng.randint(1, 40))) + rng.choice(["", "\n"])
    return out


def relations(d):
    order = ["patch_id", "file_idx", "hunk_idx", "line_idx"]
    lines = d.lines.select(sorted(d.lines.columns)).orderBy(*order)
    return [sorted(map(str, d.files.select(sorted(d.files.columns)).collect())), list(map(str, lines.collect())), sorted(map(tuple, d.rejected.collect())), lines.dtypes]


@pytest.mark.parametrize("strict", [False, True])
def test_same_as_whole(spark, strict):
    patches = from_texts(spark, texts())
    whole = relations(diff.parse(patches, strict))
    assert len(whole[1]) > 200
    for size in (2,):
        got = relations(segments.parse_lines(segments.cut_up(patches, size), strict))
        assert got[0] == whole[0] and got[1] == whole[1] and got[3] == whole[3]
        assert got[2] == whole[2]


def test_one_file_in_many_tasks(spark, tmp_path):
    """A file of many splits: rows of many tasks, the same relation as from its text at once."""
    body = "".join(f"diff --git a/f{k}.py b/f{k}.py\n--- a/f{k}.py\n+++ b/f{k}.py\n@@ -1,{k % 50} +1,{k % 60} @@ def f{k}():\n" + "".join(f"{'+- '[j % 3]}line {j} of {k}\n" for j in range(k % 50 + 3)) for k in range(600))
    (tmp_path / "big.patch").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = segments.lines_of_files(spark, str(tmp_path))
        assert rows.select("segment").distinct().count() > 5 and rows.rdd.getNumPartitions() > 5
        got = segments.parse_lines(rows)
        drop = lambda d: [sorted(map(str, x.drop("patch_id").collect())) for x in (d.files.select(sorted(d.files.columns)), d.lines.select(sorted(d.lines.columns)))]
        assert drop(got) == drop(diff.parse(from_texts(spark, {"p": body})))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_lines_are_rejected(spark):
    rows = from_texts(spark, {"long": "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+" + "x" * (1 << 20) + "\n", "fine": BASIC})
    got = segments.parse_lines(segments.cut_up(rows, 2))
    assert [tuple(r) for r in got.rejected.collect()] == [("long", "line too long")] and {r["patch_id"] for r in got.files.collect()} == {"fine"}
