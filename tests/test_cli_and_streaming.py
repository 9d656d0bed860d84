import pytest

from patchloom import cli
from patchloom.plans import corpus
from patchloom.plans.queries import as_patches
from patchloom.streaming.incremental import analysed, arriving, risk_by_time

DATA = "/root/testdata/sf0.001"


def test_driver_side_commands(tmp_path, capsys):
    assert cli.main(["rules", "list", "--category", "secrets"]) == 0 and "secret.service-token" in capsys.readouterr().out
    assert cli.main(["rules", "show", "secret.service-tokn"]) == 2 and "similar" in capsys.readouterr().err
    assert cli.main(["rules", "languages"]) == 0 and cli.main(["rules", "categories"]) == 0 and cli.main(["rules", "docs"]) == 0 and cli.main(["version"]) == 0
    assert cli.main(["init", "--root", str(tmp_path)]) == 0 and cli.main(["init", "--root", str(tmp_path)]) == 2 and cli.main(["init", "--root", str(tmp_path), "--force"]) == 0
    assert cli.main(["scan", "--diff", str(tmp_path / "none")]) == 2 and cli.main(["nonsense"]) == 2


def test_scan(spark, tmp_path, monkeypatch):
    (tmp_path / "p.diff").write_text("diff --git a/x.py b/x.py\n@@ -1 +1,2 @@\n+t = 'ghp_" + "a1B2" * 10 + "'\n")
    monkeypatch.setattr(cli, "_session", lambda: spark)
    args = ["scan", "--diff", str(tmp_path / "p.diff"), "--root", str(tmp_path), "--only", "secret.service-token", "--fail-on", "critical", "--out", str(tmp_path / "o.txt"), "--ci-out", str(tmp_path / "ci")]
    assert cli.main(args) == 1
    assert "secret.service-token" in (tmp_path / "o.txt").read_text() and "failed=true" in (tmp_path / "ci").read_text() and "a1B2a1B2" not in (tmp_path / "o.txt").read_text()


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for r in as_patches(spark, DATA).limit(3).collect():
        (folder / f"{r['patch_id']}.diff").write_text(r["text"])
    analysed(arriving(spark, f"file://{folder}"), corpus.rules(), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    scores = spark.read.parquet(f"file://{tmp_path}/out/scores")
    assert scores.count() == 3
    from patchloom.plans.analysis import analyse
    from patchloom.sources.patches import from_files

    batch = analyse(from_files(spark, f"file://{folder}"), corpus.rules())
    one = lambda df: sorted((r["patch_id"].rpartition("/")[2], r["total"]) for r in df.select("patch_id", "total").collect())
    assert one(scores) == one(batch.scores)
    assert sum(r["patches"] for r in risk_by_time(scores).collect()) == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        arriving(spark, str(tmp_path / "none"))


def test_version_names_commit_and_date(tmp_path, monkeypatch, capsys):
    from patchloom import cli

    assert cli.main(["version"]) == 0 and "commit " in capsys.readouterr().out
    monkeypatch.setattr(cli, "__file__", str(tmp_path / "cli.py"))
    assert cli.built() == ("unknown", "unknown")
    (tmp_path / "BUILD").write_text("abc1234 2024-05-06\n")
    assert cli.built() == ("abc1234", "2024-05-06")
