"""Commits of a git repository as a data source: ``spark.read.format("git_patches")``, and as a stream.

A commit is a patch. Tasks read ranges of commits, each by its own git process, so the repository must be where the
executors are, as a work tree on a shared file system is. A stream's offset is the commit it has read up to.
"""

from __future__ import annotations

import datetime
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "patch_id string, text string, author string, at timestamp"
NAME = "git_patches"


def _git(root: str, *args: str) -> str:
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=600, check=False)
    if out.returncode:
        raise RuntimeError(f"git {args[0]}: {out.stderr.decode('utf-8', 'replace').strip()}")
    return out.stdout.decode("utf-8", "replace")


@dataclass
class Commits(InputPartition):
    """Some commits, oldest first; or one comparison of two."""

    root: str
    ids: tuple[str, ...]
    context: int
    base: str = ""

    def rows(self) -> Iterator[tuple]:
        how = ["--no-color", "--no-ext-diff", "--find-renames", f"-U{self.context}"]
        for i in self.ids:
            author, at = _git(self.root, "show", "-s", "--format=%ae%n%ct", i).strip().rsplit("\n", 1)
            args = ["diff", *how, f"{self.base}...{i}"] if self.base else ["diff-tree", "-p", "--root", "--no-commit-id", "-m", "--first-parent", *how, i]
            yield i, _git(self.root, *args), author, datetime.datetime.fromtimestamp(int(at), datetime.UTC)


class _Options:
    """Options by their names in lower case, as Spark hands them on."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("the option path names no repository")
        self.root, self.base, self.head = options["path"], options.get("base", ""), options.get("head", "HEAD")
        self.whole = str(options.get("whole", "false")).lower() == "true"
        self.context, self.per_task = int(options.get("context", 5)), max(1, int(options.get("commitspertask", 200)))

    def commit(self, ref: str) -> str:
        return _git(self.root, "rev-parse", "--verify", ref + "^{commit}").strip()

    def between(self, base: str, head: str) -> list[Commits]:
        ids = _git(self.root, "rev-list", "--reverse", "--topo-order", f"{base}..{head}" if base else head).split()
        return [Commits(self.root, tuple(ids[k : k + self.per_task]), self.context) for k in range(0, len(ids), self.per_task)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> list[Commits]:
        if self.o.whole:
            return [Commits(self.o.root, (self.o.commit(self.o.head),), self.o.context, self.o.base or self.o.commit(self.o.head + "~1"))]
        return self.o.between(self.o.base, self.o.commit(self.o.head)) or [Commits(self.o.root, (), self.o.context)]

    def read(self, partition: Commits) -> Iterator[tuple]:
        return partition.rows()


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def initialOffset(self) -> dict:
        return {"commit": self.o.commit(self.o.base) if self.o.base else ""}

    def latestOffset(self) -> dict:
        return {"commit": self.o.commit(self.o.head)}

    def partitions(self, start: dict, end: dict) -> list[Commits]:
        return self.o.between(start["commit"], end["commit"]) if start["commit"] != end["commit"] else []

    def read(self, partition: Commits) -> Iterator[tuple]:
        return partition.rows()

    def commit(self, end: dict) -> None:
        pass


class GitPatches(DataSource):
    """Options: path; base and head, the commits after one and up to another; context, lines around changes; commitsPerTask;
    whole, one patch of all that head has beyond base."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make ``git_patches`` known to a session."""
    spark.dataSource.register(GitPatches)
