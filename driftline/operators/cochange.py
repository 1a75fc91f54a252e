"""Weighted, time-decayed co-change of files: support, confidence and lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import confidence, lift
from driftline.operators.classify import included
from driftline.params import Params
from driftline.sources.store import shared_table, small


def counted(commits: DataFrame, touches: DataFrame, p: Params) -> DataFrame:
    """Touches of the commits that count, with weight and decayed weight."""
    return touches.select("commit_id", "file_id").join(included(commits, p), "commit_id")


def commit_sets(commits: DataFrame, touches: DataFrame, p: Params) -> DataFrame:
    """(commit_id, weight, decayed, files): the files of each commit that counts, in order. One shuffle by commit, no self-join."""
    return counted(commits, touches, p).groupBy("commit_id").agg(F.first("weight").alias("weight"), F.first("decayed").alias("decayed"),
        F.sort_array(F.collect_set("file_id")).alias("files"))


def pairs(sets: DataFrame, n: int | None = None) -> DataFrame:
    """(a, b, commit_id, weight, decayed) with a < b for every two files of a commit.

    A counted commit has at most max_commit_files files, so the files of one fit in
    an array. The arrays are shuffled by `a`, into `n` tasks if given, before they
    are spread out, so grouping by (a, b) needs no further shuffle.
    """
    left = sets.where(F.size("files") > 1).select("commit_id", "weight", "decayed", "files", F.posexplode("files").alias("i", "a"))
    left = left.select("a", "commit_id", "weight", "decayed", F.slice("files", F.col("i") + 2, F.size("files")).alias("bs")).where(F.size("bs") > 0)
    left = left.repartition(n, "a") if n else left.repartition("a")
    return left.select("a", F.explode("bs").alias("b"), "commit_id", "weight", "decayed")


def together(sets: DataFrame, n: int | None = None) -> DataFrame:
    """(a, b, n, w_support, w_decayed, first_commit, last_commit) of each two files that changed together twice or more."""
    return pairs(sets, n).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w_support"), F.sum("decayed").alias("w_decayed"),
        F.min("commit_id").alias("first_commit"), F.max("commit_id").alias("last_commit"),
    ).where("n >= 2")


def cochange(commits: DataFrame, touches: DataFrame | None, p: Params, sets: DataFrame | None = None, n: int | None = None,
    of: int | None = None) -> DataFrame:
    """One row for each two files that changed together twice or more; with `of`, of those that it is one of.

    `sets`: `commit_sets`, if at hand (touches aren't read then).
    """
    sets = commit_sets(commits, touches, p) if sets is None else sets
    support = small(shared_table(sets.select(F.explode("files").alias("file_id"), "decayed").groupBy("file_id").agg(F.sum("decayed").alias("w"))))
    total = included(commits, p).agg(F.coalesce(F.sum("decayed"), F.lit(0.0)).alias("total"))
    both_of = together(sets, n) if of is None else together(sets.where(F.array_contains("files", of)), n).where((F.col("a") == of) | (F.col("b") == of))
    out = both_of.join(support.toDF("a", "wa"), "a", "left").join(support.toDF("b", "wb"), "b", "left").join(F.broadcast(total))
    wa, wb, both = F.coalesce("wa", F.lit(0.0)), F.coalesce("wb", F.lit(0.0)), F.col("w_decayed")
    return out.select(
        "a", "b", "n", "w_support", "w_decayed", confidence(both, wa).alias("conf_ab"), confidence(both, wb).alias("conf_ba"),
        lift(both, wa, wb, F.col("total")).alias("lift"), "first_commit", "last_commit",
    )


def both_ways(table: DataFrame) -> DataFrame:
    """Each pair from either side: file_id, other, conf (of other given file_id) and the rest."""
    rest = ["n", "w_support", "w_decayed", "lift", "first_commit", "last_commit"]
    return table.select(F.col("a").alias("file_id"), F.col("b").alias("other"), F.col("conf_ab").alias("conf"), *rest).union(
        table.select(F.col("b").alias("file_id"), F.col("a").alias("other"), F.col("conf_ba").alias("conf"), *rest)
    )


def strong(table: DataFrame, p: Params) -> DataFrame:
    """Pairs that pass the reporting gates; the gates can move without recomputing the table."""
    return table.where((F.col("n") >= p.min_cochange_n) & (F.col("lift") >= p.min_lift))
