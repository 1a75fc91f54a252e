"""From a git repository to a store: scan, identity, parse, resolve, intervals, co-change, ghosts.

Each stage is a DataFrame over the whole history; only the identity fold is
sequential, over change metadata. An incremental run scans and resolves new
commits only and keeps the parses of blobs already seen; identities are folded
again over the metadata of all commits and the derived tables are computed afresh.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import paths as P
from driftline.operators import classify, identity, intervals, textsearch
from driftline.operators.cochange import cochange
from driftline.operators.extract import extract_blobs
from driftline.operators.ghosts import ghosts
from driftline.operators.resolve import Manifests, resolve
from driftline.params import Params
from driftline.sources import git
from driftline.sources.store import IndexMissing, Store, missing_blobs, shared_table, upsert

PARSER_VERSION = 1


_MANIFESTS = "commit_id long, module string, crate string, folder string"


def read_manifest(path: str, text: str) -> tuple[str | None, str | None, str | None]:
    """(Go module, crate name, its source folder) of a go.mod at the top or a Cargo.toml anywhere."""
    if path == "go.mod":
        return next((x.strip()[7:].strip() for x in text.splitlines() if x.strip().startswith("module ")), None), None, None
    m = re.search(r'^\s*\[package\]\s*$(?:(?!^\s*\[).)*?^\s*name\s*=\s*"([^"\n]+)"', text, re.M | re.S)
    folder = path.rpartition("/")[0]
    return None, m[1].replace("-", "_") if m else None, f"{folder}/src" if folder else "src"


def manifests(changed: DataFrame, repo: str) -> Manifests:
    """What manifests said, by commit; `changed` has (commit_id, path, blob_oid). One row for each change of one is collected."""
    mine = changed.where("blob_oid IS NOT NULL AND (path = 'go.mod' OR path LIKE '%Cargo.toml')").select("commit_id", "path", "blob_oid")
    texts = git.scan_blobs(mine.select("blob_oid").distinct(), repo)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [read_manifest(p, c.decode("utf-8", "replace")) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame([(int(c), *s) for c, s in zip(b["commit_id"], said, strict=True)], columns=["commit_id", "module", "crate", "folder"])

    rows = mine.join(texts, "blob_oid").select("commit_id", "path", "content").mapInPandas(run, _MANIFESTS)
    return Manifests(sorted((tuple(r) for r in rows.where("module IS NOT NULL OR crate IS NOT NULL").collect()), key=lambda r: (r[0], r[3] or "")))


def symbol_intervals(events: DataFrame, parsed: DataFrame, deaths: DataFrame) -> DataFrame:
    """(name, file_id, kind, first_commit, last_commit) by the same island rule as links."""
    done = events.select(F.col("file_id").alias("src"), "commit_id")
    defs = events.join(parsed.select("blob_oid", F.explode("defs").alias("d")), "blob_oid").select(F.col("file_id").alias("src"),
        F.col("d.name").alias("name"), F.col("d.kind").alias("kind"), "commit_id")
    spans = intervals.build_intervals(done.union(deaths.select(F.col("file_id").alias("src"), "commit_id")), defs, ("name", "kind"))
    return spans.select("name", F.col("src").alias("file_id"), "kind", F.col("born").alias("first_commit"), F.col("died").alias("last_commit"))


def build(spark: SparkSession, repo: str, out: str, p: Params = Params(), first_parent: bool = True, since: str | None = None,
    incremental: bool = False) -> tuple[Store, dict]:
    """Index a repository into `out`; returns the store and a report."""
    repo = git.open_repo(repo)
    head = git.head(repo)
    old: Store | None = None
    if incremental:
        old = Store(spark, out)
        if old.meta.get("head_oid") == head:
            return old, {"commits_indexed": 0, "caveats": []}
    elif Store.exists(spark, out):
        raise FileExistsError(f"{out} exists; index incrementally or remove it")
    caveats: list[str] = []
    kw: dict = {"first_parent": first_parent}
    if since and re.fullmatch(r"\d{4}-\d\d-\d\d", since):
        kw["since"] = int(spark.sql(f"SELECT unix_seconds(timestamp'{since} 00:00:00')").first()[0])
    elif since:
        kw["hide"] = since
    listed = git.list_commits(repo, hide=old.meta["head_oid"], first_parent=first_parent) if old else git.list_commits(repo, **kw)
    if not listed:
        raise ValueError("no commits to index")
    first = (old.table("commits").agg(F.max("id")).first()[0] or 0) + 1 if old else 1
    commits = git.scan_commits(spark, listed, first)
    p = Params(**(vars(p) | {"exclude_merges": not first_parent}))
    changes = shared_table(classify.normalize_changes(git.scan_diffs(commits, repo, p.rename_threshold)))
    if old:
        before = old.table("changes")
        commits = shared_table(old.table("raw_commits").unionByName(commits))
        changes = shared_table(before.unionByName(changes))
    parent = listed[0][1] if not old else None
    seeds = git.scan_tree(spark, repo, parent).where(~P.is_excluded_path(F.col("path"))).withColumn("history", F.lit("h")) if parent else None
    if old and old.has("seeds"):
        seeds = old.table("seeds")
    folded = shared_table(identity.fold(changes.withColumn("history", F.lit("h")), seeds))
    spans = folded.where("table = 'file_paths'").select("file_id", "path", F.col("commit_id").alias("from_commit"), "to_commit", "confidence")
    # A path changed twice in one commit leaves an empty span.
    spans = shared_table(spans.where("to_commit IS NULL OR to_commit > from_commit"))
    deaths = folded.where("table = 'deaths'").select("file_id", "commit_id", "path")
    lives = shared_table(intervals.life_spans(folded.where("table IN ('files', 'returns')"), deaths))
    lang = P.lang_of(F.col("path"))
    lines = changes.select("commit_id", "path", classify.import_only(lang, F.col("changed_lines"), p).alias("import_only"))
    touches = folded.where("table = 'touches'").join(lines.dropDuplicates(["commit_id", "path"]), ["commit_id", "path"], "left")
    touches = touches.select("commit_id", "file_id", "path", "change", "blob_oid", "lines_added", "lines_removed",
        F.coalesce("import_only", F.lit(False)).alias("import_only"))
    # Of several touches of a file in a commit the last one counts, in the order in which the fold went.
    place = F.struct(F.array_position(F.array(*map(F.lit, "DRMA")), F.col("change")), "path")
    touches = shared_table(upsert(touches.limit(0), touches.withColumn("seq", place), ["commit_id", "file_id"]).select(touches.columns))
    classified = shared_table(classify.classify(commits, touches, p))
    seeded = folded.where("table = 'files' AND commit_id = 0").select("commit_id", "file_id", "path", "blob_oid")
    events = touches.where("change <> 'D'").select("commit_id", "file_id", "path", "blob_oid").union(seeded).withColumn("lang",
        lang).where("lang IS NOT NULL AND blob_oid IS NOT NULL")
    have = old.table("parsed") if old else None
    wanted = events.select("blob_oid", "lang")
    todo = missing_blobs(wanted, have, PARSER_VERSION) if have is not None else missing_blobs(wanted,
        wanted.limit(0).withColumn("parser_version", F.lit(0)), PARSER_VERSION)
    blobs = git.scan_blobs(todo, repo).join(todo, "blob_oid")
    parsed = extract_blobs(blobs).withColumn("parser_version", F.lit(PARSER_VERSION))
    parsed = shared_table(parsed.unionByName(have) if have is not None else parsed)
    symbols = shared_table(symbol_intervals(events, parsed, deaths))
    known = manifests(touches.where("change <> 'D'").select("commit_id", "path", "blob_oid").union(seeded.select("commit_id", "path", "blob_oid")), repo)
    asked = events.select(F.col("file_id").alias("src"), "commit_id", "path", "lang", "blob_oid")
    # A link depends on what came before its commit only, so those of commits indexed earlier stand.
    edges, health = resolve(asked.where(F.col("commit_id") >= first) if old else asked, parsed, symbols, spans, known)
    if old:
        edges, health = old.table("resolved").unionByName(edges), old.table("import_health").unionByName(health)
    edges, health = shared_table(edges), shared_table(health)
    read = events.select(F.col("file_id").alias("src"), "commit_id")
    all_intervals = shared_table(intervals.intervals_with_deaths(read, edges.select("src", "dst", "kind", "commit_id"), lives))
    now = spans.where("to_commit IS NULL").select(F.col("file_id").alias("id"), F.col("path").alias("current_path"))
    born = folded.where("table = 'files'").select(F.col("file_id").alias("id"), F.col("path").alias("first_path"), F.col("commit_id").alias("born_commit"))
    died = deaths.groupBy(F.col("file_id").alias("id")).agg(F.max("commit_id").alias("died_commit"))
    files = born.join(now, "id", "left").join(died, "id", "left").withColumn("_p", F.coalesce("current_path", "first_path"))
    files = shared_table(files.select("id", "current_path", P.lang_of(F.col("_p")).alias("lang"), "born_commit",
        F.when(F.col("current_path").isNull(), F.col("died_commit")).alias("died_commit"), P.is_doc(F.col("_p")).alias("is_doc")))
    pairs = shared_table(cochange(classified, touches, p))
    ghost_rows = ghosts(classified, touches, files, intervals.lifetimes(all_intervals, classified), p)
    total, resolved = health.agg(F.coalesce(F.sum("imports_total"), F.lit(0)), F.coalesce(F.sum("imports_resolved"), F.lit(0))).first()
    words = textsearch.build(classified, "id", ["subject", "body"])
    tables = {
        "postings": words.terms, "text_lengths": words.lengths, "resolved": edges, "import_health": health,
        "commits": classified, "raw_commits": commits, "changes": changes, "files": files, "file_paths": spans, "touches": touches,
            "symbols": symbols, "parsed": parsed,
        "edges": edges.groupBy("src", "dst", "kind").agg(F.min("resolution").alias("resolution")), "edge_intervals": all_intervals,
            "cochange": pairs, "ghosts": ghost_rows,
    }
    if seeds is not None:
        tables["seeds"] = seeds
    meta = {
        "repo_path": repo, "head_oid": head, "first_parent": str(first_parent), "max_commit_files": str(p.max_commit_files),
            "half_life_days": str(p.half_life_days),
        "imports_total": str(total), "imports_resolved": str(resolved), "indexed_at": datetime.now(UTC).isoformat(timespec="seconds"),
    }
    store = Store.write(spark, out, tables, meta)
    return store, {"commits_indexed": len(listed), "caveats": caveats}


def staleness(store: Store, repo: str) -> str | None:
    """A warning when the repository has moved on since it was indexed."""
    now = git.head(repo)
    if now == store.meta["head_oid"]:
        return None
    missed = len(git.list_commits(repo, hide=store.meta["head_oid"]))
    return f"the store is {missed} commits behind"


__all__ = ["IndexMissing", "build", "manifests", "staleness"]
