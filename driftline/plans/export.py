"""Sinks: JSON, DOT and GraphML text, and the payload of the web view."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.paths import group_label
from driftline.functions.scalars import edge_kind_name, round_to, xml_escape


def edge_states(lives: DataFrame, ghosts: DataFrame) -> DataFrame:
    """Adds state: live, ghost (cut, still coupled) or dead."""
    marked = lives.join(ghosts.select("src", "dst", "kind", F.lit(True).alias("ghost")), ["src", "dst", "kind"], "left")
    return marked.withColumn("state", F.when(F.col("alive"), "live").when(F.col("ghost"), "ghost").otherwise("dead"))


def _named(states: DataFrame, names: DataFrame) -> DataFrame:
    return states.join(names.toDF("src", "from"), "src").join(names.toDF("dst", "to"), "dst")


def to_json(states: DataFrame, names: DataFrame, cochange: DataFrame) -> dict[str, DataFrame]:
    """Three tables of JSON lines: files (dead ones by their last path), edges with state, co-change."""
    edges = _named(states, names).select(F.to_json(F.struct("from", "to", edge_kind_name(F.col("kind")).alias("kind"), "state")).alias("value"))
    pairs = cochange.join(names.toDF("a", "path_a"), "a").join(names.toDF("b", "path_b"), "b")
    return {
        "files": names.select(F.to_json(F.struct("id", "path")).alias("value")), "edges": edges,
        "cochange": pairs.select(F.to_json(F.struct(F.col("path_a").alias("a"), F.col("path_b").alias("b"), "n",
            round_to(F.col("lift"), 2).alias("lift"))).alias("value")),
    }


def to_dot(states: DataFrame, names: DataFrame, alive: DataFrame) -> DataFrame:
    """Ordered lines (part, value) of a DOT graph: living nodes, live edges, ghosts dashed."""
    quoted = F.concat(F.lit('"'), F.replace("path", F.lit('"'), F.lit('\\"')), F.lit('"'))
    nodes = names.join(alive, "id", "left_semi").select(F.lit(1).alias("part"), F.concat(F.lit("  "), quoted, F.lit(";")).alias("value"))
    style = F.when(F.col("state") == "ghost", F.lit(" [style=dashed]")).otherwise(F.lit(""))
    edges = _named(states.where("state <> 'dead'"), names).select(F.lit(2).alias("part"),
        F.concat(F.format_string('  "%s" -> "%s"', "from", "to"), style, F.lit(";")).alias("value"))
    ends = states.sparkSession.createDataFrame([(0, "digraph history {"), (3, "}")], "part int, value string")
    return ends.union(nodes).union(edges).orderBy("part", "value")


def to_graphml(states: DataFrame, names: DataFrame, alive: DataFrame) -> DataFrame:
    """Ordered lines (part, value) of a GraphML document; paths are escaped."""
    node = F.format_string('<node id="n%d"><data key="path">%s</data></node>', "id", xml_escape(F.col("path")))
    edge = F.format_string('<edge source="n%d" target="n%d"><data key="state">%s</data></edge>', "src", "dst", "state")
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="path" for="node"/><key id="state" for="edge"/><graph edgedefault="directed">'
    ends = states.sparkSession.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, value string")
    nodes = names.join(alive, "id", "left_semi").select(F.lit(1).alias("part"), node.alias("value"))
    edges = states.where("state <> 'dead'").select(F.lit(2).alias("part"), edge.alias("value"))
    return ends.union(nodes).union(edges).orderBy("part", "value")


#: Groups that a page tells apart, the last for all others; lifts of coupled and of hidden pairs; joint changes and number of hidden ones.
GROUPS, CO_LIFT, HIDDEN_LIFT, HIDDEN_N, HIDDEN_MOST = 8, 2, 8, 3, 40


def web_payload(lives: DataFrame, cochange: DataFrame, files: DataFrame, meta: dict) -> dict:
    """meta, groups, nodes [path, group, degree, coupling], live pairs, coupled and hidden pairs [a, b, lift, n, weight].

    Pairs are of places in `nodes`. A hidden pair has a high lift and no live link.
    This is the living graph of one repository on its way to one page: the driver
    holds it whole, row by row from the executors, so it must fit there.
    """
    living = files.where("current_path IS NOT NULL").select("id", F.col("current_path").alias("path"))
    ids = living.select("id")

    def both_live(t: DataFrame) -> DataFrame:
        return t.join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi")

    live = both_live(lives.where("alive").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    co = both_live(cochange.where(F.col("lift") >= CO_LIFT))
    hidden = co.where((F.col("lift") >= HIDDEN_LIFT) & (F.col("n") >= HIDDEN_N)).join(live, ["a", "b"],
        "left_anti").orderBy(F.desc("w_decayed"), "a", "b").limit(HIDDEN_MOST)
    ends = live.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).alias("d"),
        F.lit(0.0).alias("w")).union(co.select(F.explode(F.array("a", "b")), F.lit(0), "w_decayed"))
    sums = ends.groupBy("id").agg(F.sum("d").alias("degree"), round_to(F.sum("w"), 2).alias("coupling")).join(living, "id")
    nodes = list(sums.select("id", "path", group_label(F.col("path")).alias("g"), "degree", "coupling").orderBy("id").toLocalIterator())
    sizes = Counter(n["g"] for n in nodes)
    groups = [g for g, _ in sorted(sizes.items(), key=lambda x: (-x[1], x[0]))]
    if len(groups) > GROUPS:
        groups = [*groups[: GROUPS - 1], "other"]
    number = {g: i for i, g in enumerate(groups)}
    at = {n["id"]: i for i, n in enumerate(nodes)}

    def coupled(t: DataFrame) -> list[list]:
        rows = t.select("a", "b", round_to(F.col("lift"), 1).alias("lift"), "n", round_to(F.col("w_decayed"), 3).alias("w")).orderBy(F.desc("w"), "a", "b")
        return [[at[r["a"]], at[r["b"]], r["lift"], r["n"], r["w"]] for r in rows.toLocalIterator()]

    out = {
        "groups": groups, "nodes": [[n["path"], number.get(n["g"], len(groups) - 1), n["degree"], n["coupling"]] for n in nodes],
        "live": [[at[r["a"]], at[r["b"]]] for r in live.orderBy("a", "b").toLocalIterator()], "co": coupled(co), "hidden": coupled(hidden),
    }
    return out | {"meta": meta | {"files": living.count(), "live": len(out["live"]), "cochange": len(out["co"])}}
