"""Links that were cut while their ends kept changing together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import days_between, ghost_score
from driftline.model import MECHANICAL
from driftline.operators.cochange import commit_sets
from driftline.params import Params
from driftline.sources.store import small


def ghosts(commits: DataFrame, touches: DataFrame | None, files: DataFrame, lives: DataFrame, p: Params, sets: DataFrame | None = None,
    n: int | None = None, few: bool = False) -> DataFrame:
    """(src, dst, kind, severed_commit, lifetime_days, cochanges_since, conf_since, score).

    Candidates are links whose last interval is closed, by a commit that isn't
    mechanical, after a life of at least the threshold, with both ends alive.
    conf_since is the decayed weight of the source's later touches that also touch
    the target, over that of all its later touches.

    `sets`: `commit_sets`, if at hand (touches aren't read then); `n`: tasks of the
    shuffle; `few`: `lives` has the links of few sources only, and is cheap to read.
    """
    alive = small(files.where("current_path IS NOT NULL").select("id"))
    held = lives.where(~F.col("alive") & F.col("last_died").isNotNull() & (F.col("last_days") >= p.ghost_min_lifetime_days))
    if "cut_time" not in lives.columns:
        held = held.join(commits.select(F.col("id").alias("last_died"), F.col("author_time").alias("cut_time"), F.col("excluded").alias("cut_excluded")), "last_died")
    candidates = (
        held.where(F.col("cut_excluded").bitwiseAND(F.lit(MECHANICAL)) == 0)
        .join(alive.toDF("src"), "src", "left_semi").join(alive.toDF("dst"), "dst", "left_semi")
        .select("src", F.col("last_died").alias("commit_id"), F.lit(0.0).alias("decayed"), F.array("dst").alias("others"),
            F.struct("kind", "cut_time", F.col("last_days").alias("lifetime_days")).alias("cut"))
    )
    sets = commit_sets(commits, touches, p) if sets is None else sets
    touched = sets.select("commit_id", "decayed", "files", F.explode("files").alias("src"))
    if few:
        touched = touched.join(small(candidates.select("src").distinct()), "src", "left_semi")
    touched = touched.select("src", "commit_id", "decayed", F.array_remove("files", F.col("src")).alias("others"))
    # Touches and cuts of a source meet in one shuffle; each cut is a marker row among what came after it.
    marked = touched.withColumn("cut", F.lit(None).cast(candidates.schema["cut"].dataType)).unionByName(candidates)
    marked = marked.repartition(n, "src") if n else marked.repartition("src")
    after = Window.partitionBy("src").orderBy(F.desc("commit_id")).rangeBetween(Window.unboundedPreceding, -1)
    of_src = marked.withColumn("w_src", F.sum("decayed").over(after))
    of_both = Window.partitionBy("src", "dst").orderBy(F.desc("commit_id")).rangeBetween(Window.unboundedPreceding, -1)
    spread = of_src.select("src", F.explode("others").alias("dst"), "commit_id", "decayed", "cut", "w_src")
    sums = spread.withColumns({"w_both": F.sum("decayed").over(of_both), "cochanges_since": F.count_if(F.col("cut").isNull()).over(of_both)})
    now = commits.agg(F.max("author_time").alias("now"))
    conf = F.coalesce(F.least(F.col("w_both") / F.col("w_src"), F.lit(1.0)), F.lit(0.0))
    out = sums.where(F.col("cut").isNotNull() & (F.col("cochanges_since") > 0)).join(F.broadcast(now)).withColumn("conf_since", conf)
    out = out.where((F.col("cochanges_since") >= p.ghost_min_cochanges_since) & (F.col("conf_since") >= p.ghost_min_conf_since))
    out = out.select("src", "dst", "cut.kind", F.col("commit_id").alias("severed_commit"), "cut.lifetime_days", "cochanges_since", "conf_since", "now", "cut.cut_time")
    score = ghost_score(F.col("conf_since"), F.col("cochanges_since"), days_between(F.col("now"), F.col("cut_time")), F.col("lifetime_days"), p.half_life_days)
    return out.select("src", "dst", "kind", "severed_commit", "lifetime_days", "cochanges_since", "conf_since", score.alias("score"))
