"""Registered queries of the indexing half, over the test tables as a change log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import classify, extract, identity
from driftline.operators import evidence as E
from driftline.operators import intervals as I
from driftline.operators.resolve import resolve
from driftline.params import TESTDATA
from driftline.plans.index import symbol_intervals
from driftline.plans.star_queries import FILE
from driftline.sources import changelog, star
from driftline.sources.store import commit_as_of, shared_table

#: Revisions that `as_of_commit` asks about.
REVS = ("1995-06-17", "1998-08-02")
#: Added to a customer's key when it is a document among files.
DOC = 1_000_000_000


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_table(changelog.changes(star.history(spark, sf_dir)))


def change_log(spark, sf_dir):
    return changelog.changes(star.history(spark, sf_dir)).drop("history", "open_line")


def identity_files(spark, sf_dir):
    rows = identity.fold(_log(spark, sf_dir))
    counts = [F.count_if(F.col("table") == t).alias(f"n_{t}") for t in ("file_paths", "touches", "deaths", "returns")]
    first = F.col("table") == "files"
    return rows.groupBy("file_id").agg(F.max(F.when(first, F.col("path"))).alias("first_path"),
        F.max(F.when(first, F.col("commit_id"))).alias("born_commit"), *counts)


def identity_spans(spark, sf_dir):
    return identity.fold(_log(spark, sf_dir), wanted=frozenset(("file_paths",))).select("file_id", "path",
        F.col("commit_id").alias("from_commit"), "to_commit", "confidence")


def edge_intervals_with_deaths(spark, sf_dir):
    log = _log(spark, sf_dir)
    spans = I.life_spans(log.where("change = 'A'"), log.where("change = 'D'"))
    return I.intervals_with_deaths(log.where("change <> 'D'").select(F.col("file_id").alias("src"), "commit_id"), changelog.links(log), spans)


def symbol_spans(spark, sf_dir):
    """Each file defines its own name and one that changes with what a touch adds."""
    log = _log(spark, sf_dir).withColumn("q", F.concat(F.lit("q"), (F.col("lines_added") % 7).cast("string"))).withColumn("blob_oid",
        F.concat_ws("-", "file_id", "q"))
    events = log.where("change <> 'D'").select("file_id", "commit_id", "blob_oid", "q")
    names = F.array(F.concat(F.lit("s"), F.col("file_id").cast("string")), F.col("q"))
    parsed = events.dropDuplicates(["blob_oid"]).select("blob_oid",
        F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("fn").alias("kind"))).alias("defs"))
    return symbol_intervals(events, parsed, log.where("change = 'D'"))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links and import health; files of even number define a symbol of their name while they live."""
    log = _log(spark, sf_dir)
    asked, parsed = changelog.parses(log)
    spans = I.life_spans(log.where("change = 'A'"), log.where("change = 'D'"))
    symbols = spans.where("file_id % 2 = 0").select(F.concat(F.lit("s"), F.col("file_id").cast("string")).alias("name"), "file_id",
        F.col("enter").alias("first_commit"), F.col("death").alias("last_commit"))
    return resolve(asked, parsed, symbols, changelog.paths(log))


def import_links(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("src", "commit_id", "dst", "kind", "resolution")


def import_health(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].select("src", "commit_id", "imports_total", "imports_resolved")


def source_extract(spark, sf_dir):
    found = extract.extract_blobs(changelog.sources(spark, sf_dir))
    return found.select(
        "blob_oid", "lang", F.array_join("imports.spec", ",").alias("specs"), F.array_join(F.flatten("imports.names"), ",").alias("names"),
            F.array_join("calls", ",").alias("calls"),
        F.array_join(F.transform("defs", lambda d: F.concat_ws(":", d["name"], d["kind"])), ",").alias("defs"),
            F.array_join("doc_links", ",").alias("doc_links"), F.array_join("doc_tokens", ",").alias("doc_tokens"),
    )


def normalized_changes(spark, sf_dir):
    n = F.col("p_partkey")
    folders = F.array(*map(F.lit, ("src", "vendor", "dist", "lib/node_modules")))

    def path(i):
        return F.concat(F.element_at(folders, (i % 4 + 1).cast("int")), F.lit("/p"), n.cast("string"), F.when(n % 11 == 0, ".min.js").otherwise(".js"))

    change = F.element_at(F.array(*map(F.lit, "AMDR")), (n % 4 + 1).cast("int"))
    parts = star.read(spark, sf_dir, "part")
    raw = parts.select("p_partkey", change.alias("change"), path(F.floor(n / 4)).alias("path"),
        F.when(change == "R", path(F.floor(n / 16))).alias("old_path"), F.concat(F.lit("b"), n.cast("string")).alias("new_blob"))
    return classify.normalize_changes(raw).withColumn("phase", F.col("phase").cast("long"))


def import_only_lines(spark, sf_dir):
    n = F.col("p_partkey")
    lines = F.flatten(F.array(F.array_repeat(F.lit("  import a"), (n % 5 * 3).cast("int")),
        F.array_repeat(F.lit("x = 1"), (n % 3).cast("int")), F.array_repeat(F.lit("}"), (n % 2).cast("int"))))
    rows = star.read(spark, sf_dir, "part").select("p_partkey", lines.alias("lines"))
    py = F.lit("py")
    return rows.select("p_partkey", S.round_to(classify.import_only_fraction(py, F.col("lines")), 6).alias("fraction"),
        classify.import_only(py, F.col("lines"), TESTDATA).alias("import_only"))


def as_of_commit(spark, sf_dir):
    commits = star.history(spark, sf_dir)["commits"]
    return spark.createDataFrame([(r, commit_as_of(commits, r)) for r in REVS], "rev string, id long")


def blast_docs(spark, sf_dir):
    """Documents that refer to the file, with how far they are behind."""
    h = star.history(spark, sf_dir)
    # Only documents that refer to the file are evidence.
    pairs = shared_table(star.doc_links(h["sets"], h["tasks"]).where(F.col("code") == FILE).withColumn("doc", F.col("doc") + DOC))
    touched = h["sets"].where(F.array_contains("files", FILE)).select(F.lit(FILE).cast("long").alias("code"), "commit_id", (F.col("weight") > 0).alias("counts"))
    behind = shared_table(E.drift_behind(pairs, touched))
    lives = shared_table(pairs.where(F.col("code") == FILE).select(
        F.col("doc").alias("src"), F.col("code").alias("dst"), F.lit(3).alias("kind"), F.lit(True).alias("alive"),
            F.lit(1).cast("long").alias("n_intervals"), F.lit(0).cast("long").alias("lifetime_days")
    ))
    none = lives.limit(0)
    ghosts = none.select("src", "dst", "kind", F.lit(0).cast("long").alias("severed_commit"), "lifetime_days",
        F.lit(0).cast("long").alias("cochanges_since"), F.lit(0.0).alias("conf_since"))
    zero = F.lit(0).cast("long")
    cochange = none.select(F.col("src").alias("a"), F.col("dst").alias("b"), zero.alias("n"),
        *[F.lit(0.0).alias(c) for c in ("w_support", "w_decayed", "conf_ab", "conf_ba", "lift")], zero.alias("first_commit"), zero.alias("last_commit"))
    ranked = E.blast(FILE, lives, lives.select("src", "dst", "kind", F.lit(0).alias("resolution")), ghosts, cochange, h["files"],
        h["commits"], TESTDATA, drift=behind, kinds=frozenset({"live", "doc"}))
    types = F.array_join(F.array_sort(F.transform("evidence", lambda e: e["type"])), ",")
    late = F.aggregate("evidence", F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["commits_behind"], F.lit(0)))
    return ranked.select((F.col("file_id") - DOC).alias("doc"), "rank", types.alias("types"), late.alias("commits_behind"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        change_log, identity_files, identity_spans, edge_intervals_with_deaths, symbol_spans, import_links, import_health, source_extract,
            normalized_changes, import_only_lines, as_of_commit, blast_docs,
    )
}
