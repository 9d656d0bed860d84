"""Code owners as a relation: thousands of rules of many repositories, met by joins instead of a condition for each.

A rule has a key that every path it matches has among its own: a folder or path from the root, a name of a segment, or an ending.
Paths meet the rules of their keys, the rule's pattern confirms, and the last rule wins. Only rules that begin with a
wildcard and end in none of these meet all paths of their repository.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs
from ..functions.text import trimmed

_WILD = re.compile(r"[*?]")


def key_of(pattern: str) -> str:
    """A key of every path that a code-owners pattern matches: p: and a path from the root, s: and a segment, x: and an ending, or *."""
    inner = pattern.strip("/")
    wild = _WILD.search(inner)
    if inner == "" or inner == "*":
        return "*"
    if pattern.startswith("/") or "/" in inner:
        fixed = inner if not wild else inner[: wild.start()].rpartition("/")[0]
        return f"p:{fixed}" if fixed else "*"
    if not wild:
        return f"s:{inner}"
    ending = inner.rpartition(".")[2]
    return f"x:{ending}" if "." in inner and ending and not _WILD.search(ending) and not pattern.endswith("/") else "*"


def rules_of(files: DataFrame) -> DataFrame:
    """repo, rule_ord, pattern, owners, key, regex of code-owners ``files`` (repo, text), one a repository.

    Blank lines and comments are left out; a pattern without owners takes its paths from earlier rules. A null text has no rules.
    """
    rows = files.select("repo", F.posexplode(F.split("text", r"\r?\n")).alias("rule_ord", "line"))
    words = F.split(trimmed(F.col("line")), r"\s+")
    rows = rows.where(~trimmed(F.col("line")).startswith("#") & (trimmed(F.col("line")) != ""))
    rows = rows.select("repo", "rule_ord", F.get(words, F.lit(0)).alias("pattern"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))).alias("owners"))
    rows = rows.withColumn("owners", F.filter("owners", lambda x: x != ""))
    return keyed(rows)


def keyed(rules: DataFrame) -> DataFrame:
    """``rules`` (repo, rule_ord, pattern, owners) with the key and the regular expression of each pattern."""

    def run(batches):
        for b in batches:
            said = b.column("pattern").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([key_of(p) for p in said], pa.string()), pa.array([globs.owners_to_java(p) for p in said], pa.string())], [*b.schema.names, "key", "regex"])

    rules = rules.select(F.coalesce("repo", F.lit("")).alias("repo"), F.col("rule_ord").cast("long").alias("rule_ord"), "pattern", "owners").where("pattern is not null")
    return rules.mapInArrow(run, "repo string, rule_ord long, pattern string, owners array<string>, key string, regex string")


def owners_of_files(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``files`` (repo, path and more) with owners: those of the last rule of the repository that matches, or none.

    A path is judged once however many files have it. Equal rule_ords count as the greater list of owners.
    """
    segments = F.split(path, "/")
    until = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.concat(F.lit("p:"), F.array_join(F.slice(segments, F.lit(1), n), "/")))
    names = F.transform(segments, lambda s: F.concat(F.lit("s:"), s))
    ending = F.array(F.lit("*"), F.concat(F.lit("x:"), F.substring_index(path, ".", -1)))
    paths = files.select(F.coalesce("repo", F.lit("")).alias("_repo"), F.col(path).alias("_path")).where("_path is not null").distinct()
    asked = paths.withColumn(path, F.col("_path")).select("_repo", "_path", F.explode(F.array_distinct(F.concat(until, names, ending))).alias("key"))
    met = asked.join(rules.withColumnRenamed("repo", "_repo"), ["_repo", "key"]).where(F.expr("_path rlike regex"))
    last = met.groupBy("_repo", "_path").agg(F.max_by("owners", F.struct("rule_ord", "owners")).alias("owners"))
    out = files.join(last, (F.coalesce(files["repo"], F.lit("")) == last["_repo"]) & (files[path] == last["_path"]), "left").drop("_repo", "_path")
    return out.withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))
