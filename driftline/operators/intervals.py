"""Life intervals from snapshots, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import whole_days


def build_intervals(processed: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("dst", "kind"), n: int | None = None) -> DataFrame:
    """(src, *keys, born, died) from what each source declared each time it was processed.

    `processed`: every (src, commit_id); `targets`: (src, *keys, commit_id). A
    target opens at the first snapshot that has it and closes at the source's
    next snapshot that lacks it; died is null while it is open. Both meet in one
    shuffle by source, into `n` tasks if given.
    """
    none = F.lit(None).cast(targets.select(F.struct(*keys).alias("k")).schema["k"].dataType)
    rows = processed.select("src", "commit_id", F.lit(True).alias("done"), none.alias("k")).union(
        targets.select("src", "commit_id", F.lit(False), F.struct(*keys)))
    rows = rows.repartition(n, "src") if n else rows.repartition("src")
    said = rows.groupBy("src", "commit_id").agg(F.bool_or("done").alias("done"), F.collect_set("k").alias("said")).where("done")
    return said_intervals(said, keys)


def said_intervals(snapshots: DataFrame, keys: tuple[str, ...] = ("dst", "kind"), also: tuple[str, ...] = ()) -> DataFrame:
    """`build_intervals` from (src, commit_id, said): an array of the keys that each source declared at each commit, partitioned by src.

    Consecutive snapshots are islands of (snapshot number - row number). Of each
    column of `also`, what it is at born and at died comes as born_* and died_*.
    """
    by_src = Window.partitionBy("src").orderBy("commit_id")
    here = F.struct("commit_id", *also)
    snaps = snapshots.select("src", here.alias("here"), "said", F.row_number().over(by_src).alias("seq"), F.lead(here).over(by_src).alias("next"))
    seen = snaps.select("src", "here", "seq", "next", F.explode("said").alias("k")).select("src", "k.*", "here", "seq", "next")
    island = F.col("seq") - F.row_number().over(Window.partitionBy("src", *keys).orderBy("seq"))
    found = seen.withColumn("island", island).groupBy("src", *keys, "island").agg(F.min("here").alias("born"), F.max_by("next", "seq").alias("died"))
    ends = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("born", "died") for c in also]
    return found.select("src", *keys, F.col("born.commit_id").alias("born"), F.col("died.commit_id").alias("died"), *ends)


def life_spans(births: DataFrame, deaths: DataFrame) -> DataFrame:
    """(file_id, span, enter, enter_path, death, death_path): when each file was there; death is null while it is.

    Both sides have (file_id, commit_id, path); births are first appearances and
    returns. A file that dies and returns in one commit dies first.
    """
    events = births.select("file_id", "commit_id", F.lit(1).alias("enters"),
        "path").unionByName(deaths.select("file_id", "commit_id", F.lit(0).alias("enters"), "path"))
    order = Window.partitionBy("file_id").orderBy("commit_id", "enters")
    after = F.lead(F.struct("enters", "commit_id", "path")).over(order)
    spans = events.withColumn("after", after).where("enters = 1").select(
        "file_id", F.col("commit_id").alias("enter"), F.col("path").alias("enter_path"),
        F.when(F.col("after.enters") == 0, F.col("after.commit_id")).alias("death"),
            F.when(F.col("after.enters") == 0, F.col("after.path")).alias("death_path"),
    )
    return spans.withColumn("span", F.row_number().over(Window.partitionBy("file_id").orderBy("enter")))


def intervals_with_deaths(snapshots: DataFrame, targets: DataFrame, spans: DataFrame) -> DataFrame:
    """(src, dst, kind, born, died) where targets die and return.

    `snapshots`: every (src, commit_id) at which a source was read; `targets`: (src,
    dst, kind, commit_id) that a snapshot declares; `spans`: `life_spans` of all files.

    A source's death is a snapshot that declares nothing. The death of a target ends
    its links. They open again at its return if the source lives then, whatever
    the source has said in between, until its next snapshot. So a link is open while
    its target lives and the source's last snapshot within the target's lives
    declares it, unless a return in between found the source dead.

    Within a commit deaths come first, in order of path, then returns in order of
    path, then snapshots: a return that its commit's snapshot denies leaves an
    interval without length.
    """
    gone = spans.where("death IS NOT NULL").select(F.col("file_id").alias("src"), F.col("death").alias("commit_id"), F.col("death_path").alias("gone"))
    seen = snapshots.select("src", "commit_id").distinct().withColumn("gone", F.lit(None).cast("string"))
    # A snapshot at the commit of a death belongs to a return in that commit and follows it.
    by_src = Window.partitionBy("src").orderBy("commit_id", F.col("gone").isNull())
    timeline = seen.unionByName(gone).withColumn("seq", F.row_number().over(by_src)).withColumn("next", F.lead(F.struct("commit_id", "gone")).over(by_src))
    lives = spans.select(F.col("file_id").alias("dst"), "span", "enter", "enter_path", "death", "death_path")
    inside = (F.col("enter") <= F.col("commit_id")) & (F.col("death").isNull() | (F.col("death") > F.col("commit_id")))
    said = targets.select("src", "dst", "kind", "commit_id").distinct().join(timeline.where("gone IS NULL"),
        ["src", "commit_id"]).join(lives, "dst").where(inside)
    link = ["src", "dst", "kind"]
    island = F.col("seq") - F.row_number().over(Window.partitionBy(*link, "span").orderBy("commit_id"))
    islands = said.withColumn("island", island).groupBy(*link, "span", "island").agg(
        F.min("commit_id").alias("born"), F.max_by("next", "seq").alias("next"), F.first("death").alias("death"), F.first("death_path").alias("death_path")
    )
    first_denied = F.col("death").isNull() | (F.col("next.commit_id") < F.col("death"))
    # Both ends may die in one commit; the first path goes first.
    first_denied = first_denied | ((F.col("next.commit_id") == F.col("death")) & F.coalesce(F.col("next.gone") < F.col("death_path"), F.lit(False)))
    islands = islands.withColumn("armed", ~F.coalesce(first_denied, F.lit(False)) & F.col("death").isNotNull())
    islands = islands.withColumn("died", F.when(F.col("armed"), F.col("death")).otherwise(F.col("next.commit_id")))
    own = islands.select(*link, "span", "born", "died", F.lit(False).alias("carried"))
    carried = _carried(islands.where("armed").select(*link, "span"), lives, timeline, spans)
    # A reopened link that the next snapshot confirms goes on as that snapshot's interval; a death of the source in between parts them.
    rows = own.unionByName(carried)
    order = Window.partitionBy(*link, "span").orderBy("born", F.desc("carried"))
    goes_on = F.lag("carried").over(order) & (F.lag("died").over(order) == F.col("born"))
    grouped = rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("new").over(order))
    # Null (still open) wins over every end.
    return grouped.groupBy(*link, "span", "part").agg(F.min("born").alias("born"),
        F.when(F.bool_or(F.col("died").isNull()), None).otherwise(F.max("died")).alias("died")).select(*link, "born", "died")


def _carried(armed: DataFrame, lives: DataFrame, timeline: DataFrame, spans: DataFrame) -> DataFrame:
    """(src, dst, kind, span, born, died, carried) of links that a target's return opens again; `carried` if a snapshot is what comes next.

    Only links whose target has died and returned get here. What a source said
    next after each return comes from one window a source with marker rows.
    """
    link = ["src", "dst", "kind"]
    later = armed.withColumnRenamed("span", "since").join(lives, "dst").where("span > since")
    asked = later.select("src", F.col("enter").alias("at")).distinct()
    events = timeline.where("gone IS NULL").select("src", F.col("commit_id").alias("at"), F.lit(1).alias("mark"), F.lit(None).cast("string").alias("gone"))
    events = events.unionByName(timeline.where("gone IS NOT NULL").select("src", F.col("commit_id").alias("at"), F.lit(2).alias("mark"), "gone"))
    # A death at the commit of the return is over by then; a snapshot there comes after it.
    events = events.unionByName(asked.select("src", "at", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("gone")))
    place = F.when(F.col("mark") == 2, 0).when(F.col("mark") == 0, 1).otherwise(2)
    # Backwards, as a frame that only grows takes one pass.
    ahead = Window.partitionBy("src").orderBy(F.desc("at"), F.desc(place)).rowsBetween(Window.unboundedPreceding, -1)
    following = events.withColumn("f",
        F.last(F.when(F.col("mark") > 0, F.struct("at", "gone")), ignorenulls=True).over(ahead)).where("mark = 0").select("src",
            F.col("at").alias("enter"), "f")
    # Whether the source lived then: the latest end of its lives that began before, from another window with marker rows.
    ever = F.lit(2**63 - 1)
    births = spans.select(F.col("file_id").alias("src"), F.col("enter").alias("at"), F.col("enter_path").alias("path"), F.coalesce("death", ever).alias("until"))
    asks = later.select("src", F.col("enter").alias("at"), F.col("enter_path").alias("path")).distinct().withColumn("until", F.lit(None).cast("long"))
    came = Window.partitionBy("src").orderBy("at", "path", F.col("until").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lived = births.unionByName(asks).withColumn("last", F.max("until").over(came)).where("until IS NULL").select("src", F.col("at").alias("enter"),
        F.col("path").alias("enter_path"), (F.coalesce("last", F.lit(0)) > F.col("at")).alias("there"))
    there = later.join(lived, ["src", "enter", "enter_path"]).drop("enter_path")
    steps = there.join(following, ["src", "enter"])
    denied = F.col("death").isNull() | (F.col("f.at") < F.col("death")) | ((F.col("f.at") == F.col("death"))
        & F.coalesce(F.col("f.gone") < F.col("death_path"), F.lit(False)))
    steps = steps.withColumn("ends", F.coalesce(F.col("f").isNotNull() & denied, F.lit(False)))
    before = Window.partitionBy(*link, "since").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    # Up to here every return found the source alive, and no snapshot came while the target lived.
    kept = steps.withColumn("ok", F.col("there") & F.coalesce(F.bool_and(F.col("there") & ~F.col("ends")).over(before), F.lit(True))).where("ok")
    return kept.select(*link, "span", F.col("enter").alias("born"),
        F.when(F.col("ends"), F.col("f.at")).otherwise(F.col("death")).alias("died"), (F.col("ends") & F.col("f.gone").isNull()).alias("carried"))


def edges_of(intervals: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, resolution): one row a link, the most exact resolution seen."""
    if resolutions is None:
        return intervals.select("src", "dst", "kind").distinct().withColumn("resolution", F.lit(0))
    return resolutions.groupBy("src", "dst", "kind").agg(F.min("resolution").alias("resolution"))


def lifetimes(intervals: DataFrame, commits: DataFrame) -> DataFrame:
    """(src, dst, kind, alive, n_intervals, last_born, last_died, lifetime_days).

    The lifetime sums each interval's whole days; an open one runs to the latest
    commit. Commit 0 has the earliest commit's time. Intervals with the times (and
    exclusions) of their ends need no join to the commits; what severed the last one comes as cut_time and cut_excluded then.
    """
    span = commits.agg(F.min("author_time").alias("first"), F.max("author_time").alias("now"))
    told = "born_author_time" in intervals.columns
    timed, born_time, died_time = intervals, *map(F.col, ("born_author_time", "died_author_time") if told else ("born_time", "died_time"))
    if not told:
        times = commits.select("id", "author_time")
        timed = intervals.join(times.toDF("born", "born_time"), "born", "left").join(times.toDF("died", "died_time"), "died", "left")
    timed = timed.join(F.broadcast(span))
    days = whole_days(F.when(F.col("died").isNull(), F.col("now")).otherwise(F.coalesce(died_time, "now")),
        F.coalesce(born_time, F.when(F.col("born") == 0, F.col("first")).otherwise(F.col("now"))))
    cut = [died_time.alias("cut_time"), F.col("died_excluded").alias("cut_excluded")] if told else []
    last = F.max_by(F.struct("born", "died", days.alias("days"), *cut), "born")
    return timed.groupBy("src", "dst", "kind").agg(
        F.bool_or(F.col("died").isNull()).alias("alive"), F.count("*").alias("n_intervals"), last.alias("last"), F.sum(days).alias("lifetime_days")
    ).select("src", "dst", "kind", "alive", "n_intervals", F.col("last.born").alias("last_born"), F.col("last.died").alias("last_died"),
        F.col("last.days").alias("last_days"), "lifetime_days", *(["last.cut_time", "last.cut_excluded"] if told else []))


def alive_at(intervals: DataFrame, commit: Column | int) -> DataFrame:
    """Links with an interval that holds the commit: born at or before it, not yet dead."""
    c = F.lit(commit) if isinstance(commit, int) else commit
    return intervals.where((F.col("born") <= c) & (F.col("died").isNull() | (F.col("died") > c))).select("src", "dst", "kind").distinct()
