"""Command line: index a repository, then ask. Text on stdout, or JSON with --json.

Exit codes: 0 fine, 1 other errors, 2 no store, 3 no such file, 4 other schema.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.functions.scalars import parse_days
from driftline.operators import cochange as C
from driftline.operators import evidence as E
from driftline.operators import graph as G
from driftline.operators import intervals as I
from driftline.operators import textsearch as X
from driftline.params import Params
from driftline.plans import export, human, index, serve
from driftline.sources.store import FileNotInHistory, IndexMissing, SchemaMismatch, Store, commit_as_of, display_paths, resolve_paths


class Ask:
    """A store with what every question needs: parameters, names and link lifetimes."""

    def __init__(self, store: Store) -> None:
        self.store, self.t = store, store.table
        self.p = Params(max_commit_files=int(store.meta.get("max_commit_files", 50)), half_life_days=float(store.meta.get("half_life_days", 365)))
        self.names = display_paths(self.t("files"), self.t("file_paths"))
        self.lives = I.lifetimes(self.t("edge_intervals"), self.t("commits"))

    def file(self, path: str) -> int:
        row = resolve_paths(self.store.spark.createDataFrame([(path,)], "path string"), self.t("files"), self.t("file_paths")).first()
        if row["file_id"] is None:
            raise FileNotInHistory(path)
        return row["file_id"]

    def dated(self, column: str, name: str) -> DataFrame:
        """(column, name): a commit's id, date and subject. Commit 0 is the start of the index."""
        c = self.t("commits")
        return c.select(F.col("id").alias(column),
            F.struct(S.short_oid(F.col("oid")).alias("oid"), S.date_str(F.col("author_time")).alias("date"), "subject").alias(name))

    def drift(self) -> DataFrame:
        docs = self.lives.where((F.col("kind") == 3) & F.col("alive")).select(F.col("src").alias("doc"), F.col("dst").alias("code"))
        own = self.t("touches").select(F.col("file_id").alias("doc"), "commit_id")
        return E.drift_pairs(docs, own, self.t("touches"), self.t("commits"))

    def named(self, df: DataFrame, **columns: str) -> DataFrame:
        for to, column in columns.items():
            df = df.join(self.names.select(F.col("id").alias(column), F.col("path").alias(to)), column, "left")
        return df

    # Each question returns plain data.

    def blast(self, path: str, depth: int, limit: int, min_confidence: float, kinds: str | None) -> dict:
        q = self.file(path)
        got = E.blast(q, self.lives, self.t("edges"), self.t("ghosts"), self.t("cochange"), self.t("files"), self.t("commits"), self.p,
            self.drift(), depth, E.parse_kinds(kinds), min_confidence)
        rows = self.named(got, path="file_id").orderBy(F.desc("rank"), "path").limit(limit + 1).select("path", "rank", "evidence")
        return {"query": {"file": path, "file_id": q, "head": self.store.meta["head_oid"][:12]}} | _cut(limit, rows)

    def cochange(self, path: str, limit: int, include_structural: bool) -> dict:
        q = self.file(path)
        rows = C.strong(C.both_ways(self.t("cochange")).where(F.col("file_id") == q), self.p)
        alive = self.t("files").where("current_path IS NOT NULL").select(F.col("id").alias("other"), F.col("current_path").alias("path"))
        linked = self.t("edges").where((F.col("src") == q)
            | (F.col("dst") == q)).select(F.when(F.col("src") == q, F.col("dst")).otherwise(F.col("src")).alias("other"),
                F.lit(True).alias("linked")).distinct()
        out = rows.join(alive, "other").join(linked, "other", "left").withColumn("structural_edge", F.coalesce("linked", F.lit(False)))
        out = out if include_structural else out.where("NOT structural_edge")
        out = out.join(self.dated("first_commit", "first"), "first_commit").join(self.dated("last_commit", "last"), "last_commit")
        return {"query": {"file": path}} | _cut(limit,
            out.orderBy(F.desc("w_decayed"), "other").limit(limit + 1).select("path", "n", S.round_to(F.col("conf"), 2).alias("confidence"),
                S.round_to(F.col("lift"), 1).alias("lift"), "first", "last", "structural_edge"))

    def ghosts(self, path: str | None, limit: int) -> dict:
        g = self.t("ghosts")
        if path:
            q = self.file(path)
            g = g.where((F.col("src") == q) | (F.col("dst") == q))
        top = self.named(g.orderBy(F.desc("score"), "src", "dst", "kind").limit(limit + 1),
            **{"from": "src", "to": "dst"}).join(self.dated("severed_commit", "severed_at"), "severed_commit", "left")
        return _cut(limit, top.orderBy(F.desc("score"), "from", "to").select("from", "to", S.edge_kind_name(F.col("kind")).alias("kind"),
            "severed_at", "lifetime_days", "cochanges_since", S.round_to(F.col("conf_since"), 2).alias("confidence_since"),
                S.round_to(F.col("score"), 2).alias("score")))

    def path(self, a: str, b: str, as_of: str | None) -> dict:
        at = commit_as_of(self.t("commits"), as_of) if as_of else None
        found = G.way(self.lives, self.t("edge_intervals"), self.file(a), self.file(b), self.p, at)
        out: dict = {"a": a, "b": b}
        for key, hops in found.items():
            out[key] = None if hops is None else _rows(self.named(hops,
                **{"from": "src", "to": "dst"}).join(self.dated("last_died", "died"), "last_died", "left").orderBy("step").select("from",
                    "to", S.edge_kind_name(F.col("kind")).alias("kind"), "alive", "died"))
        dead = [h["died"] for h in out["union_path"] or [] if not h["alive"] and h.get("died")]
        out["broke_at"] = max(dead, key=lambda d: d["date"]) if dead else None
        return out

    def why(self, a: str, b: str) -> dict:
        x, y = self.file(a), self.file(b)
        on = ((F.col("src") == x) & (F.col("dst") == y)) | ((F.col("src") == y) & (F.col("dst") == x))
        spans = self.t("edge_intervals").where(on).join(self.dated("born", "from"), "born", "left").join(self.dated("died", "to"), "died", "left")
        spans = spans.groupBy("src", "dst", "kind").agg(F.sort_array(F.collect_list(F.struct("born", "from", "to"))).alias("intervals"))
        edges = self.named(self.lives.where(on).join(spans, ["src", "dst", "kind"]).join(self.t("edges"), ["src", "dst", "kind"]),
            **{"from": "src", "to": "dst"})
        ghost = self.t("ghosts").where(on).join(self.dated("severed_commit", "severed"), "severed_commit", "left").select("src", "dst",
            "kind", F.struct("severed", "lifetime_days", "cochanges_since", "conf_since", "score").alias("ghost"))
        pair = self.t("cochange").where((F.col("a") == min(x, y)) & (F.col("b") == max(x, y)))
        out = {"a": a, "b": b, "edges": _rows(edges.join(ghost, ["src", "dst", "kind"], "left").select("from", "to",
            S.edge_kind_name(F.col("kind")).alias("kind"), S.resolution_name(F.col("resolution")).alias("resolution"), "alive", "intervals",
                "ghost")), "cochange": next(iter(_rows(pair)), None)}
        return out | {"caveats": [] if out["edges"] or out["cochange"] else ["no link and no shared history"]}

    def timeline(self, path: str) -> dict:
        q = self.file(path)
        spans = self.t("file_paths").where(F.col("file_id") == q).join(self.dated("from_commit", "from"), "from_commit",
            "left").join(self.dated("to_commit", "to"), "to_commit", "left")
        iv = self.t("edge_intervals").where((F.col("src") == q) | (F.col("dst") == q))
        iv = iv.withColumn("other_id", F.when(F.col("src") == q, F.col("dst")).otherwise(F.col("src"))).withColumn("direction",
            F.when(F.col("src") == q, "out").otherwise("in"))
        both = iv.select(F.col("born").alias("at"), F.lit("opened").alias("event"), "kind", "other_id",
            "direction").union(iv.where("died IS NOT NULL").select("died", F.lit("closed"), "kind", "other_id", "direction"))
        events = self.named(both.orderBy("at", "event", "other_id").limit(200), other="other_id").join(self.dated("at", "commit"), "at",
            "left").orderBy("at", "event", "other_id")
        mine = self.t("touches").where(F.col("file_id") == q).join(self.t("commits").select(F.col("id").alias("commit_id"), "author_time"), "commit_id")
        churn = mine.groupBy(S.quarter_str(F.col("author_time")).alias("period")).agg(F.count("*").alias("touches"),
            F.sum(S.line_total(F.col("lines_added"), F.col("lines_removed"))).alias("lines")).orderBy("period")
        info = self.t("files").where(F.col("id") == q).join(self.dated("born_commit", "born"), "born_commit",
            "left").join(self.dated("died_commit", "died"), "died_commit", "left").select("born", "died")
        return {"file": self.names.where(F.col("id") == q).first()["path"], **_rows(info)[0],
            "paths": _rows(spans.orderBy("from_commit").select("path", "from", "to", "confidence")),
                "edge_events": _rows(events.select("commit", "event", S.edge_kind_name(F.col("kind")).alias("kind"), "other", "direction")),
                    "churn": _rows(churn)}

    def drifted(self, limit: int) -> dict:
        top = self.named(self.drift().orderBy(F.desc("commits_behind"), "doc", "code").limit(limit + 1), doc_path="doc", code_path="code")
        top = top.join(self.dated("doc_last", "doc_at"), "doc_last", "left").join(self.dated("code_last", "code_at"), "code_last",
            "left").orderBy(F.desc("commits_behind"), "doc", "code")
        return _cut(limit, top.select(F.col("doc_path").alias("doc"), F.col("code_path").alias("code"), "commits_behind",
            F.col("doc_at.date").alias("doc_last_touched"), F.col("code_at.date").alias("code_last_touched")))

    def hotspots(self, by: str, limit: int) -> dict:
        if by == "coupling":
            ends, words = C.strong(self.t("cochange"), self.p).select(F.explode(F.array("a", "b")).alias("id"),
                F.col("w_decayed").alias("s")), "coupled partners"
        elif by == "ghosts":
            ends, words = self.t("ghosts").select(F.explode(F.array("src", "dst")).alias("id"), F.col("score").alias("s")), "ghost edges"
        else:
            ends, words = C.counted(self.t("commits"), self.t("touches"), self.p).select(F.col("file_id").alias("id"), F.col("decayed").alias("s")), "touches"
        alive = self.t("files").where("current_path IS NOT NULL").select("id", F.col("current_path").alias("path"))
        out = ends.groupBy("id").agg(F.sum("s").alias("s"), F.count("*").alias("n")).join(alive, "id").select("path",
            S.round_to(F.col("s"), 2).alias("score"), F.format_string(f"%d {words}", "n").alias("detail"))
        return {"by": by} | _cut(limit, out.orderBy(F.desc("score"), "path").limit(limit + 1))

    def search(self, query: str, limit: int) -> dict:
        found = X.bm25(X.Index(self.t("postings"), self.t("text_lengths")), query).orderBy(F.desc("score"), "id").limit(limit)
        out = found.join(self.dated("id", "commit"), "id").join(self.t("commits").select("id", "author"), "id").orderBy(F.desc("score"), "id")
        return {"results": _rows(out.select("commit", "author"))}

    def stats(self) -> dict:
        c = self.t("commits").agg(
            F.count("*").alias("total"), F.count_if(S.has_flag(F.col("excluded"), 1)).alias("excluded_too_large"),
                F.count_if(S.has_flag(F.col("excluded"), 2)).alias("excluded_mechanical"),
            F.count_if("is_merge").alias("merges"),
                (F.round(F.count_if(F.col("weight") <= 0) / F.greatest(F.count("*"), F.lit(1)) * 1000) / 10).alias("excluded_pct"),
        )
        f = self.t("files").agg(F.count("*").alias("total"), F.count("current_path").alias("alive"), F.count_if("is_doc").alias("docs"))
        e = self.lives.agg(F.count("*").alias("total"), F.count_if("alive").alias("live"))
        # Returns count as renames and seeded files don't offset them, as the definition has it.
        r = self.t("file_paths").agg(F.count_if(F.col("from_commit") != 0).alias("spans"), F.count_if(F.col("confidence") < 0.8).alias("low_confidence"))
        commits, files, edges, spans = (_rows(x)[0] for x in (c, f, e, r))
        total, resolved = int(self.store.meta.get("imports_total", 0)), int(self.store.meta.get("imports_resolved", 0))
        return {
            "head": self.store.meta.get("head_oid", ""), "indexed_at": self.store.meta.get("indexed_at"), "commits": commits,
                "files": files | {"dead": files["total"] - files["alive"]}, "edges": edges | {"ghosts": self.t("ghosts").count()},
                    "cochange_pairs": self.t("cochange").count(),
            "imports": {"total": total, "resolved": resolved, "unresolved_ratio": round((total - resolved) / total, 3) if total else 0.0},
            "renames": {"total": max(0, spans["spans"] - files["total"]), "low_confidence": spans["low_confidence"]},
        }

    def web(self) -> dict:
        repo = os.path.basename(self.store.meta.get("repo_path", "").rstrip("/")) or "repo"
        meta = {"repo": repo, "head": self.store.meta.get("head_oid", "")[:7], "commits": self.t("commits").count()}
        return export.web_payload(self.lives, self.t("cochange"), self.t("files"), meta)

    def export(self, kind: str) -> list[str]:
        states, alive = export.edge_states(self.lives, self.t("ghosts")), self.t("files").where("current_path IS NOT NULL").select("id")
        if kind == "json":
            return [r["value"] for t in export.to_json(states, self.names, self.t("cochange")).values() for r in t.toLocalIterator()]
        make = export.to_dot if kind == "dot" else export.to_graphml
        return [r["value"] for r in make(states, self.names, alive).toLocalIterator()]


def _cut(limit: int, df: DataFrame) -> dict:
    """The first rows of a table of at most one more, and whether that one was there."""
    rows = _rows(df)
    return {"results": rows[:limit], "truncated": len(rows) > limit}


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()] if df.columns else []


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftline")
    top.add_argument("--store", help="default: the nearest .driftline upward")
    top.add_argument("--json", action="store_true", help="one JSON object instead of text")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *files: str, limit: bool = False) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for f in files:
            s.add_argument(f.rstrip("?"), nargs="?" if f.endswith("?") else None)
        if limit:
            s.add_argument("--limit", type=int, default=20)
        return s

    s = add("index", "repo?")
    s.set_defaults(repo=".")
    s.add_argument("--jobs", type=int, help="cores of a local session")
    s.add_argument("--quiet", action="store_true", help="no text on success")
    s.add_argument("--since")
    s.add_argument("--incremental", action="store_true")
    s.add_argument("--all-parents", action="store_true")
    s.add_argument("--max-commit-files", type=int, default=50)
    s.add_argument("--half-life", default="365d")
    s = add("blast", "file", limit=True)
    s.add_argument("--depth", type=int, default=2)
    s.add_argument("--min-confidence", type=float, default=0.2)
    s.add_argument("--kinds")
    add("cochange", "file", limit=True).add_argument("--include-structural", action="store_true")
    add("ghosts", "file?", limit=True)
    add("path", "a", "b").add_argument("--as-of")
    add("why", "a", "b")
    add("timeline", "file")
    add("drift", limit=True)
    add("hotspots", limit=True).add_argument("--by", choices=("churn", "coupling", "ghosts"), default="churn")
    add("search", "query", limit=True)
    add("stats")
    add("serve").add_argument("--port", type=int, default=serve.PORT)
    add("export").add_argument("--format", choices=("json", "dot", "graphml"), default="json")
    return top


def answer(spark: SparkSession, o: argparse.Namespace) -> dict | list[str]:
    if o.command == "index":
        out = o.store or os.path.join(o.repo, ".driftline")
        p = Params(max_commit_files=o.max_commit_files, half_life_days=parse_days(o.half_life))
        return index.build(spark, o.repo, out, p, not o.all_parents, o.since, o.incremental)[1]
    store = Store(spark, o.store or Store.find("."))
    ask = Ask(store)
    if o.command == "serve":
        with serve.server(ask.web, o.port) as http:
            print(f"http://{serve.HOST}:{http.server_port}/ (interrupt to stop)", file=sys.stderr)
            try:
                http.serve_forever()
            except KeyboardInterrupt:
                return []
    calls = {
        "blast": lambda: ask.blast(o.file, o.depth, o.limit, o.min_confidence, o.kinds),
            "cochange": lambda: ask.cochange(o.file, o.limit, o.include_structural), "ghosts": lambda: ask.ghosts(o.file, o.limit),
        "path": lambda: ask.path(o.a, o.b, o.as_of), "why": lambda: ask.why(o.a, o.b), "timeline": lambda: ask.timeline(o.file),
            "drift": lambda: ask.drifted(o.limit), "hotspots": lambda: ask.hotspots(o.by, o.limit),
        "search": lambda: ask.search(o.query, o.limit), "stats": ask.stats, "export": lambda: ask.export(o.format),
    }
    out = calls[o.command]()
    if isinstance(out, dict):
        late = index.staleness(store, store.meta["repo_path"]) if os.path.isdir(store.meta.get("repo_path", "")) else None
        out = {"schema": 1, **out, "caveats": [*out.get("caveats", []), *([late] if late else [])]}
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    try:
        if spark is None:
            made = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
            jobs = getattr(o, "jobs", None)
            spark = (made.master(f"local[{jobs}]") if jobs else made).getOrCreate()
        out = answer(spark, o)
    except IndexMissing as e:
        print(f"no store: {e}", file=sys.stderr)
        return 2
    except FileNotInHistory as e:
        print(f"no such file: {e}", file=sys.stderr)
        return 3
    except SchemaMismatch as e:
        print(e, file=sys.stderr)
        return 4
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    if getattr(o, "quiet", False) and not o.json:
        return 0
    lines = out if isinstance(out, list) else [json.dumps(out)] if o.json else human.render(o.command, out)
    print("\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
