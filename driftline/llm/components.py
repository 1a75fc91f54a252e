"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Minima come from a partial aggregate, so a hub isn't gathered in one task."""
    if large:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = sides.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = sides.join(lows, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(lows.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node with an edge; component is the smallest node reachable.

    `edges` has long columns u, v; direction, repeats and loops don't matter.
    Each round is one large star and one small star, written to the shared
    folder; the rounds needed grow with the logarithm of the number of nodes.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        nxt = materialise(_star(_star(now, True), False))
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = nxt
        if seen == state or not seen[0]:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct().toDF("node", "component"))
