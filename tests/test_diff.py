import pytest

from patchloom.operators import diff
from patchloom.sources.patches import from_texts


def parsed(spark, text, strict=False):
    d = diff.parse(from_texts(spark, {"p": text}), strict)
    files = [r.asDict() for r in d.files.orderBy("file_idx").collect()]
    lines = [(r["file_idx"], r["hunk_idx"], r["kind"][0], r["text"], r["old_line"], r["new_line"]) for r in d.lines.orderBy("file_idx", "hunk_idx", "line_idx").collect()]
    return files, lines, [tuple(r) for r in d.rejected.collect()]


BASIC = "diff --git a/x.go b/x.go\nindex 1..2 100644\n--- a/x.go\n+++ b/x.go\n@@ -10,3 +10,4 @@ func main() {\n a\n-b\n+c\n+d\n\\ No newline at end of file\n e\n@@ -40 +41 @@\n-z\n"


def test_numbers_sections_and_totals(spark):
    files, lines, rejected = parsed(spark, BASIC)
    assert lines == [(0, 0, "c", "a", 10, 10), (0, 0, "r", "b", 11, 0), (0, 0, "a", "c", 0, 11), (0, 0, "a", "d", 0, 12), (0, 0, "c", "e", 12, 13), (0, 1, "r", "z", 40, 0)]
    f = files[0]
    assert (f["path"], f["status"], f["additions"], f["deletions"], f["first_start"], f["old_path"]) == ("x.go", "modified", 2, 2, 10, "") and not rejected
    d = diff.parse(from_texts(spark, {"p": BASIC}))
    assert [r["anchor_line"] for r in d.lines.orderBy("hunk_idx", "line_idx").collect()] == [10, 10, 11, 12, 13, 41]
    assert {r["section"] for r in d.lines.collect()} == {"func main() {", ""}


def test_created_deleted_renamed_binary_quoted(spark):
    text = (
        "diff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+x\ndiff --git a/d b/d\ndeleted file mode 100755\n--- a/d\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
        "diff --git a/o b/p\nsimilarity index 100%\nrename from o\nrename to p\ndiff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n"
        'diff --git "a/sp\\303\\251 x" "b/sp\\303\\251 x"\n--- "a/sp\\303\\251 x"\n+++ "b/sp\\303\\251 x"\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/with space b/with space\nold mode 100644\nnew mode 100755\n'
        "diff --git a/c1 b/c2\ncopy from c1\ncopy to c2\n"
    )
    files, _, _ = parsed(spark, text)
    got = [(f["path"], f["old_path"], f["status"], f["binary"], f["old_mode"], f["new_mode"]) for f in files]
    assert got == [
        ("n", "", "created", False, "", "100644"), ("d", "", "deleted", False, "100755", ""), ("p", "o", "renamed", False, "", ""), ("i.png", "", "modified", True, "", ""), ("spé x", "", "modified", False, "", ""),
        ("with space", "", "modified", False, "100644", "100755"), ("c2", "c1", "renamed", False, "", ""),
    ]


def test_bare_diffs_and_rejections(spark):
    files, lines, _ = parsed(spark, "junk\n--- a/x\t2020-01-01\n+++ b/x\t2020-01-02\n@@ -1 +1 @@\n-a\r\n+b\r\n")
    assert [f["path"] for f in files] == ["x"] and [x[3] for x in lines] == ["a", "b"]
    bad = spark.createDataFrame([("e", ""), ("prose", "hello\nworld"), ("n", None), (None, "x"), ("long", "+" * ((1 << 20) + 1))], "patch_id string, text string")
    assert {(r[0], r[1]) for r in diff.parse(bad).rejected.collect()} == {("e", "no file changes found"), ("prose", "no file changes found"), ("n", "no text"), (None, "no patch_id"), ("long", "line too long")}


@pytest.mark.parametrize("header", ["@@ nonsense @@", "@@@ -1 -1 +1 @@@", "@@ -1", "@@ -x +1 @@"])
def test_broken_hunk_headers_leave_the_hunk_open(spark, header):
    _, lines, _ = parsed(spark, f"diff --git a/x b/x\n@@ -1,2 +1,2 @@\n+a\n{header}\n+b\n")
    assert [(x[1], x[3]) for x in lines] == [(0, "a"), (0, "b")]


def test_quirks_and_strict_hunks(spark):
    text = "diff --git a/x.sql b/x.sql\n--- a/x.sql\n+++ b/x.sql\n@@ -1,2 +1,1 @@\n--- drop it\n-b\n+c\n\n-- \n2.40\n+after\n"
    files, lines, _ = parsed(spark, text)
    assert files[0]["old_path"] == "drop it" and [x[3] for x in lines] == ["b", "c", "", "- "]
    files, lines, _ = parsed(spark, text, strict=True)
    assert files[0]["old_path"] == "" and lines[0][2:] == ("r", "-- drop it", 1, 0)


def test_zero_starts_become_one(spark):
    _, lines, _ = parsed(spark, "diff --git a/x b/x\n@@ -0,0 +0,2 @@\n+a\n+b\n")
    assert [x[5] for x in lines] == [1, 2]
