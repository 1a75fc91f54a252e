"""Bounded breadth-first search and paths over links, one join of the frontier a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.intervals import alive_at
from driftline.params import Params
from driftline.sources.store import shared_table


def undirected(edges: DataFrame) -> DataFrame:
    """(at, to) both ways, each once."""
    return edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).union(edges.select("dst", "src")).where("at <> to").distinct()


#: Levels of a search that one plan holds; then what is known is written to the shared folder.
LEVELS = 3


def bfs(edges: DataFrame, start: int, depth: int, both: DataFrame | None = None) -> DataFrame:
    """(node, dist, via): nodes within `depth` links of `start`, and the nodes between on a shortest way.

    Of several parents the smallest wins. Each level joins only the frontier; the
    visited set is an anti join. `both` is `undirected(edges)` if it is at hand.
    """
    spark: SparkSession = edges.sparkSession
    both = shared_table(undirected(edges)) if both is None else both
    seen = spark.createDataFrame([(start, 0, [])], "node long, dist int, via array<long>")
    for d in range(1, depth + 1):
        step = seen.where(F.col("dist") == d - 1).join(both, F.col("node") == F.col("at")).select(
            F.col("to").alias("node"), F.col("node").alias("parent"),
                F.when(F.col("dist") > 0, F.concat("via", F.array("node"))).otherwise(F.col("via")).alias("via")
        )
        best = step.groupBy("node").agg(F.min_by("via", "parent").alias("via"))
        frontier = best.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("dist"), "via")
        seen = seen.unionByName(frontier)
        if d % LEVELS == 0 and d < depth:
            seen = shared_table(seen)
            if seen.where(F.col("dist") == d).isEmpty():
                break
    return seen


def union_links(lives: DataFrame, p: Params) -> DataFrame:
    """Links alive now or that lived long enough in all their intervals together."""
    return lives.where(F.col("alive") | (F.col("lifetime_days") >= p.ghost_min_lifetime_days))


def transitive(lives: DataFrame, start: int, depth: int, p: Params) -> DataFrame:
    """(node, via, union_dist, head_dist): near in the union graph, farther or unreachable over live links."""
    # One table serves both searches; a pair is live if any of its links is.
    linked = union_links(lives, p)
    ends = linked.select(F.col("src").alias("at"), F.col("dst").alias("to"), "alive").union(linked.select("dst", "src", "alive")).where("at <> to")
    both = shared_table(ends.groupBy("at", "to").agg(F.bool_or("alive").alias("alive")))
    wide = bfs(linked, start, depth, both.select("at", "to")).select("node", F.col("dist").alias("union_dist"), "via").where("union_dist > 0")
    live = bfs(linked, start, 3, both.where("alive").select("at", "to")).select("node", F.col("dist").alias("head_dist"))
    return wide.join(live, "node", "left").where(F.col("head_dist").isNull() | (F.col("head_dist") > F.col("union_dist")))


def hops(lives: DataFrame, kept: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step, src, dst, kind, alive, last_died) along a way; `nodes` has one row with array<long> `way`.

    Each hop is the smallest kept link between its ends and keeps the link's own direction.
    """
    steps = nodes.select(F.posexplode(F.expr("transform(sequence(1, size(way) - 1), i -> struct(element_at(way, cast(i as int)) as x, element_at(way, cast(i + 1 as int)) as y))")).alias("step", "hop")).select("step", "hop.x", "hop.y")
    keep = kept.select("src", "dst", "kind").join(lives, ["src", "dst", "kind"])
    on = ((F.col("src") == F.col("x")) & (F.col("dst") == F.col("y"))) | ((F.col("src") == F.col("y")) & (F.col("dst") == F.col("x")))
    both = keep.select("*", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    found = steps.withColumns({"lo": F.least("x", "y"), "hi": F.greatest("x", "y")}).join(both, ["lo", "hi"]).where(on)
    first = F.min(F.struct((F.col("src") != F.col("x")).alias("back"), "kind", "src", "dst", "alive", "last_died")).alias("h")
    return found.groupBy("step").agg(first).select("step", "h.src", "h.dst", "h.kind", "h.alive", "h.last_died")


def way(lives: DataFrame, intervals: DataFrame | None, a: int, b: int, p: Params, as_of: int | None = None) -> dict[str, DataFrame | None]:
    """The live path from a to b (now or as of a commit) and, without one, the path over the union graph.

    Values are hop tables; an empty live table is the path from a file to itself. Intervals are read for `as_of` only.
    """
    live = lives.where("alive") if as_of is None else alive_at(intervals, as_of)

    def route(kept: DataFrame) -> DataFrame | None:
        row = bfs(kept, a, 6).where(F.col("node") == b).select("dist", F.concat(F.array(F.lit(a)), "via", F.array(F.lit(b))).alias("way"))
        first = row.first()
        if first is None:
            return None
        if first["dist"] == 0:
            return lives.limit(0).select(F.lit(0).alias("step"), "src", "dst", "kind", "alive", "last_died")
        return hops(lives, kept, row)

    found = route(live)
    wide = route(union_links(lives, p)) if found is None else None
    return {"live_path": found, "union_path": wide}
