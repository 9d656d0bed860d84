"""Reviewers of findings: explicit routes, then code owners, then the default."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs
from ..functions.text import trimmed
from ..sources.rules import SEVERITIES
from .findings import severity_rank


class RouteError(ValueError):
    """A route that cannot be used."""


@dataclass(frozen=True)
class Route:
    reviewers: tuple[str, ...]
    name: str = ""
    categories: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    min_severity: str = ""


@dataclass(frozen=True)
class Router:
    """``owners``: (pattern, owners) of a code-owners file, in its order."""

    routes: tuple[Route, ...] = ()
    owners: tuple[tuple[str, tuple[str, ...]], ...] = ()
    default: tuple[str, ...] = ()
    mention: bool = True


def parse_owners(text: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Rules of a code-owners file; blank lines and comments are left out."""
    rows = [line.split() for line in text.splitlines()]
    return tuple((r[0], tuple(r[1:])) for r in rows if r and not r[0].startswith("#"))


def owners_of(path: Column, owners) -> Column:
    """The owners of the last rule that matches a path, which may be none."""
    out = F.array().cast("array<string>")
    for pattern, names in owners:
        out = F.when(path.rlike(globs.owners_to_java(pattern)), F.array(*map(F.lit, names)).cast("array<string>")).otherwise(out)
    return out


def route_matches(route: Route) -> Column:
    """Every kind of selector that a route has must hold; one without any needs a severity to match at all."""
    if not route.reviewers:
        raise RouteError(f"route {route.name!r} has no reviewers")
    if route.min_severity and route.min_severity not in SEVERITIES:
        raise RouteError(f"route {route.name!r}: invalid severity {route.min_severity!r}")
    ok = F.lit(True)
    if route.min_severity:
        ok = severity_rank(F.col("severity")) >= SEVERITIES[route.min_severity]
    if route.categories:
        ok = ok & F.col("category").isin(list(route.categories))
    if route.rules:
        named = F.col("rule_id").isin([r for r in route.rules if not r.endswith("*")])
        for r in route.rules:
            named = named | F.col("rule_id").startswith(r[:-1]) if r.endswith("*") else named
        ok = ok & named
    if route.paths:
        ok = ok & globs.any_of(F.col("file"), list(route.paths))
    return ok if route.categories or route.rules or route.paths or route.min_severity else F.lit(False)


def routed(findings: DataFrame, router: Router) -> DataFrame:
    """``findings`` with reviewers: those of every matching route in order, or else the owners', or else the default."""
    none = F.array().cast("array<string>")
    names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>") if xs else none
    found = F.concat(none, *[F.when(route_matches(r), names(r.reviewers)).otherwise(none) for r in router.routes])
    owned = owners_of(F.col("file"), router.owners)
    chosen = F.when(F.size(found) > 0, found).when(F.size(owned) > 0, owned).otherwise(names(router.default))
    clean = F.array_distinct(F.filter(F.transform(chosen, trimmed), lambda x: x != ""))
    return findings.withColumn("reviewers", F.when(F.col("suppressed"), none).otherwise(clean))


def reviewer_index(findings: DataFrame) -> DataFrame:
    """patch_id, reviewer, n, categories, reviewer_order: live findings by reviewer, most first."""
    from pyspark.sql import Window

    rows = findings.where("not suppressed").select("patch_id", "category", F.explode("reviewers").alias("reviewer"))
    groups = rows.groupBy("patch_id", "reviewer").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("category")).alias("categories"))
    return groups.withColumn("reviewer_order", F.row_number().over(Window.partitionBy("patch_id").orderBy(F.desc("n"), "reviewer")))
