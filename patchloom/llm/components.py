"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def _rank(node: str, salt: int) -> F.Column:
    return F.struct(F.xxhash64(F.lit(salt), F.col(node)).alias("r"), F.col(node).alias("n"))


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component): ``component`` is the smallest node that ``node`` reaches by ``links`` (a long, b long).

    Every round each node moves to whichever of itself and its neighbours ranks first in a random order,
    and the links between the places moved to are the next round's. The order holds for four rounds: two
    settle a star, whose leaves all reach the first of them, and new orders keep long paths shrinking by an
    expected share, so rounds grow with the logarithm of the nodes whatever the shape of the graph. The
    minimum per node is aggregated before its shuffle, and each join has written tables on both sides, so a
    node with very many links is spread by the engine's skew handling. Nodes without links, self-links and
    null ends give no rows; an empty table gives an empty result.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct()
    edges = scratch.keep(edges, "edges")
    moved, rounds = [], 0
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        best = both.groupBy("node").agg(F.min(_rank("near", rounds // 4)).alias("best"))
        to = F.least(F.col("best"), _rank("node", rounds // 4))["n"]
        step = scratch.keep(best.select("node", to.alias("to")), "step")
        moved.append(step)
        sa, sb = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        pairs = edges.join(sa, "a").join(sb, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = scratch.keep(pairs.where("a <> b").distinct(), "edges")
        rounds += 1
    if not moved:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = moved[0]
    for step in moved[1:]:
        at = at.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    at = scratch.keep(at, "labels")
    least = scratch.keep(at.groupBy("to").agg(F.min("node").alias("component")), "least")
    return scratch.keep(at.join(least, "to").select("node", "component"), "components")
