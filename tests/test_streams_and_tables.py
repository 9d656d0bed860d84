"""Stateful streams, the maintained baseline and commits as a source."""

import datetime
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from patchloom.operators import diff
from patchloom.sources import baseline as B
from patchloom.sources import git_source, patches
from patchloom.sources.baseline_table import BaselineTable
from patchloom.streaming import stateful

T0 = datetime.datetime(2024, 5, 1)
HOUR = datetime.timedelta(hours=1)


def told(spark, tmp_path, batches, quiet=6 * 3600, late="1 hour"):
    """The events after each batch has gone through a query of its own from the same checkpoint."""
    out, dropped = [], 0
    for k, rows in enumerate(batches):
        at = spark.createDataFrame([(r, f, T0 + HOUR * h) for r, f, h in rows], "repo string, fingerprint string, at timestamp")
        at.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("repo string, fingerprint string, at timestamp").parquet(str(tmp_path / "in"))
        q = stateful.told_once(stream, quiet, late).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += stateful.late_rows(q)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        out.append(sorted((r["fingerprint"], r["event"], (r["at"] - T0) / HOUR, r["times"]) for r in rows))
    return out, dropped


def test_told_once_over_restarts(spark, tmp_path):
    out, dropped = told(spark, tmp_path, [[("r", "a", 0), ("r", "a", 1), ("r", "b", 2), (None, "c", 1)], [("r", "a", 6), ("r", "b", 9)], [("r", "a", 13), ("r", "z", 40)], [("r", "z", 41), ("r", "a", 5)]])
    opened = [[x for x in o if x[1] == "opened"] for o in out]
    assert opened[0] == [("a", "opened", 0, 0), ("b", "opened", 2, 0)]
    assert opened[1] == [*opened[0], ("b", "opened", 9, 0)] and ("b", "closed", 2, 1) in out[1]
    assert ("a", "opened", 13, 0) in opened[2] and ("a", "closed", 6, 3) in out[2]
    assert ("a", "closed", 13, 1) in out[3] and ("b", "closed", 9, 1) in out[3]
    # The row of hour 5 came after the watermark: it is counted and tells nothing.
    assert dropped == 1 and len([x for x in opened[3] if x[0] == "a"]) == 2


def test_sessions_of_a_table_and_a_stream(spark, tmp_path):
    rows = [("r", T0), ("r", T0 + HOUR), ("r", T0 + 5 * HOUR), ("q", T0), (None, T0)]
    table = spark.createDataFrame(rows, "repo string, at timestamp")
    want = {("r", T0, T0 + 3 * HOUR, 2), ("r", T0 + 5 * HOUR, T0 + 7 * HOUR, 1), ("q", T0, T0 + 2 * HOUR, 1)}
    assert {tuple(r) for r in stateful.sessions(table, "2 hours").collect()} == want
    table.union(spark.createDataFrame([("r", T0 + 90 * HOUR)], table.schema)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    stateful.sessions(stream, "2 hours").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("bursts").collect()} == want


ENTRY = "repo string, fingerprint string, rule string, file string, reason string, added_at string"


def test_baseline_table(spark, tmp_path):
    table = BaselineTable(spark, str(tmp_path / "base"))
    assert table.versions() == [] and table.entries().count() == 0
    v1 = table.add(spark.createDataFrame([("r", "f1", "a", "x.py", "ok", "d1"), ("r", "f1", "a", "a.py", "first by file", "d1"), ("q", "f1", "a", "x", None, "d1"), (None, "f9", "a", "x", "", "d1"), ("r", None, "a", "x", "", "d1")], ENTRY))
    v2 = table.add(spark.createDataFrame([("r", "f1", "a", "b.py", "later", "d2"), ("r", "f2", "b", "x.py", "new \"q\" <&>", "d2")], ENTRY))
    v3 = table.remove(spark.createDataFrame([("r", "f1"), ("r", "none")], "repo string, fingerprint string"))
    v4 = table.add(spark.createDataFrame([("r", "f1", "a", "c.py", "again", "d4")], ENTRY))
    of = lambda v: {(r["repo"], r["fingerprint"]): (r["file"], r["reason"], r["added_at"], r["version"]) for r in table.entries(v).collect()}
    first = {("r", "f1"): ("a.py", "first by file", "d1", 1), ("q", "f1"): ("x", None, "d1", 1), ("", "f9"): ("x", "", "d1", 1)}
    assert table.versions() == [v1, v2, v3, v4] == [1, 2, 3, 4] and of(1) == first
    assert of(2) == first | {("r", "f2"): ("x.py", "new \"q\" <&>", "d2", 2)}
    assert ("r", "f1") not in of(3) and of(None)["r", "f1"] == ("c.py", "again", "d4", 4)
    # A version that was not written whole does not count.
    (tmp_path / "base" / "version=00000005").mkdir()
    assert table.versions() == [1, 2, 3, 4]
    table.export(str(tmp_path / "json"), "2024 \"now\"")
    found = [json.loads(p.read_text()) for p in (tmp_path / "json" / "repo=r").glob("part-*")]
    assert len(found) == 1 and found[0]["generated"] == "2024 \"now\"" and [e["fingerprint"] for e in found[0]["entries"]] == ["f1", "f2"]
    read = B.entries(spark, str(tmp_path / "json" / "repo=r"))
    assert {r["fingerprint"]: r["reason"] for r in read.collect()} == {"f1": "again", "f2": "new \"q\" <&>"}


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("config", "user.email", "dev@a.example")
    run("config", "user.name", "Dev")

    def commit(k):
        (root / f"f{k % 3}.py").write_text(f"a = {k}\nb = 'é'\n")
        run("add", "-A")
        run("commit", "-qm", f"change {k}")
        return subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()

    return str(root), commit


def test_commits_as_a_source(spark, repo, tmp_path):
    root, commit = repo
    ids = [commit(k) for k in range(7)]
    git_source.register(spark)
    read = lambda **o: spark.read.format(git_source.NAME).options(path=root, **o).load()
    rows = read(commitsPerTask=3)
    assert rows.rdd.getNumPartitions() == 3 and [r["patch_id"] for r in rows.collect()] == ids
    assert {r["author"] for r in rows.collect()} == {"dev@a.example"} and rows.where("at is null").count() == 0
    assert [r["patch_id"] for r in read(base=ids[3]).collect()] == ids[4:] and read(base=ids[6]).count() == 0
    files = diff.parse(rows.select("patch_id", "text")).files
    assert {(r["patch_id"], r["path"], r["status"]) for r in files.collect()} == {(i, f"f{k % 3}.py", "created" if k < 3 else "modified") for k, i in enumerate(ids)}
    whole = read(base=ids[1], head=ids[6], whole="true").collect()
    assert [r["text"] for r in whole] == [r["text"] for r in patches.from_git(spark, root, ids[1], ids[6]).collect()]
    with pytest.raises(Exception, match="path names no repository"):
        spark.read.format(git_source.NAME).load().count()


def test_commits_as_a_stream(spark, repo, tmp_path):
    root, commit = repo
    ids = [commit(k) for k in range(3)]
    git_source.register(spark)

    def run():
        stream = spark.readStream.format(git_source.NAME).option("path", root).load().select("patch_id", "text")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r["patch_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == sorted(ids)
    ids += [commit(3), commit(4)]
    assert run() == sorted(ids)
