"""Where patches come from: files of diffs, tables, texts, and a git work tree."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "patch_id string, text string"


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """A patch per file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("patch_id"), F.col("value").alias("text"))


def from_table(rows: DataFrame, patch_id: str = "patch_id", text: str = "text") -> DataFrame:
    return rows.select(F.col(patch_id).alias("patch_id"), F.col(text).alias("text"))


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), SCHEMA)


def _git(root: str, *args: str) -> str:
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120, check=False)
    if out.returncode:
        raise RuntimeError(f"git {args[0]}: {out.stderr.strip()}")
    return out.stdout


def _known(root: str, ref: str) -> bool:
    try:
        return bool(_git(root, "rev-parse", "--verify", "--quiet", ref + "^{commit}"))
    except RuntimeError:
        return False


def base_ref(root: str = ".") -> str:
    """The branch to compare with: what CI says, the remote's head, a main branch, or the commit before."""
    asked = [os.environ.get(v, "") for v in ("GITHUB_BASE_REF", "CI_MERGE_REQUEST_TARGET_BRANCH_NAME")]
    tries = [t for b in asked if b for t in (f"origin/{b}", b)] + ["origin/HEAD", "origin/main", "origin/master", "main", "master", "HEAD~1"]
    return next((t for t in tries if _known(root, t)), "")


def repo_root(root: str = ".") -> str:
    """The top folder of the work tree that holds ``root``; ``root`` itself outside of any."""
    try:
        return _git(root, "rev-parse", "--show-toplevel").strip() or root
    except RuntimeError:
        return root


def described(root: str = ".", base: str = "", head: str = "", staged: bool = False) -> str:
    """What a comparison is of, in words."""
    if staged:
        return "staged changes"
    if not base:
        return "changes of the work tree"
    short = lambda ref: _git(root, "rev-parse", "--short", ref).strip() if _known(root, ref) else ref
    return f"{base} ({short(base)}) to {head or 'HEAD'} ({short(head or 'HEAD')})"


def from_git(spark: SparkSession, root: str = ".", base: str = "", head: str = "", staged: bool = False, context: int = 5) -> DataFrame:
    """One patch of a work tree: staged changes, a range, or the work tree itself."""
    args = ["diff", "--no-color", "--no-ext-diff", "--find-renames", f"-U{context if context > 0 else 5}"]
    args += ["--cached"] if staged else [f"{base}...{head or 'HEAD'}"] if base else []
    return from_texts(spark, {os.path.abspath(root): _git(root, *args)})
