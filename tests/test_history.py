"""Scalars, paths, classification, intervals, search and extraction; and registered queries against their SQL."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline.functions import paths as P
from driftline.functions import scalars as S
from driftline.operators import classify, extract, identity, intervals, textsearch
from driftline.operators.evidence import drift_pairs, parse_kinds
from driftline.operators.resolve import Manifests, resolve
from driftline.params import Params
from driftline.plans import export, log_queries, log_sql, star_queries, star_sql
from driftline.streaming.events import hourly

DATA = "/root/testdata/sf0.001"


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert value(spark, S.commit_weight(lit(4), lit(False))) == 0.25 and value(spark, S.commit_weight(lit(0), lit(False))) == 0
    assert value(spark, S.decay(lit(365.0), 365)) == 0.5 and value(spark, S.decay(lit(-3.0), 365)) == 1 and value(spark, S.decay(lit(9.0), 0)) == 1
    assert value(spark, S.lift(lit(16.0), lit(40.0), lit(40.0), lit(100.0))) == 1.0 and value(spark, S.confidence(lit(1.0), lit(0.0))) == 0
    assert value(spark, S.round_to(lit(0.285), 2)) == 0.28
    assert [value(spark, S.date_str(lit(t))) for t in (0, 951782400, 1785542400)] == ["1970-01-01", "2000-02-29", "2026-08-01"]
    assert value(spark, S.quarter_str(lit(1785542400))) == "2026-Q3"
    one, two = (value(spark, S.noisy_or(F.array(*map(lit, x)))) for x in ([0.5], [0.5, 0.4]))
    assert 0.5 == one < two < 1 and value(spark, S.noisy_or(F.array(lit(5.0)))) == pytest.approx(0.999)
    assert value(spark, S.xml_escape(lit('a<b & "c"'))) == "a&lt;b &amp; &quot;c&quot;" and S.parse_days("365d") == 365
    assert tuple(value(spark, S.civil(lit(951782400)))) == (2000, 2, 29) and value(spark, S.hex_oid(lit(bytearray(b"\xab\x01")))) == "ab01"
    assert value(spark, S.transitive_strength(lit(2))) == 0.125 and value(spark, S.structural_strength(lit(0), lit(False))) == 0


def test_paths(spark):
    def get(f, *args):
        return [value(spark, f(F.lit(a))) for a in args]

    assert get(P.normalize_path, "a/./b//../c", "../x", "") == ["a/c", "x", ""]
    assert get(P.is_excluded_path, "vendor/x.py", "a/node_modules/b.js", "yarn.lock", "x.min.js", "src/a.py", "docs/vendor.md") == [True, True, True, True, False, False]
    assert get(P.lang_of, "a.TS", "b/c.md", "Makefile", "x.gemspec") == ["ts", "md", None, "rb"]
    assert get(P.group_label, "a.py", "src/a.py", "packages/x/a.py", "packages/a.py") == ["(root)", "src", "packages/x", "packages"]
    assert get(P.file_stem, "a/b.test.js") == ["b"] and get(P.dir_of, "a/b/c", "c") == ["a/b", ""]


def test_classification(spark):
    assert [value(spark, classify.mechanical_subject(F.lit(s))) for s in ("chore: x", "Run prettier", "choreography", "bump deps", "fix bump", None)] == [True, True, False, True, False, False]
    frac = value(spark, classify.import_only_fraction(F.lit("py"), F.array(*map(F.lit, ["import a", "  from b import c", "}", "", "x = 1", "y"]))))
    assert frac == 0.5
    commits = spark.createDataFrame([(1, "x", False, 0), (2, "chore: y", False, 0), (3, "z", True, 0), (4, "w", False, 0)], "id long, subject string, is_merge boolean, author_time long")
    touches = spark.createDataFrame([(1, i, False) for i in range(4)] + [(2, i, True) for i in range(40)] + [(3, i, False) for i in range(400)], "commit_id long, file_id long, import_only boolean")
    got = {r["id"]: (r["excluded"], r["weight"]) for r in classify.classify(commits, touches, Params()).collect()}
    assert got == {1: (0, 0.25), 2: (2, 0.0), 3: (9, 0.0), 4: (0, 0.0)}
    rows = [("R", "vendor/a", "src/a", "x"), ("R", "src/a", "vendor/a", "x"), ("R", "vendor/a", "dist/a", "x"), ("M", "src/b", None, "y"), ("A", "dist/c", None, "z")]
    kept = classify.normalize_changes(spark.createDataFrame(rows, "change string, path string, old_path string, new_blob string")).collect()
    assert sorted((r["change"], r["path"], r["new_blob"]) for r in kept) == [("A", "src/a", "x"), ("D", "src/a", None), ("M", "src/b", "y")]


def test_intervals_replay(spark):
    import random

    r = random.Random(1)
    snaps = [(s, c, {r.randrange(4) for _ in range(r.randrange(4))}) for s in range(3) for c in sorted(r.sample(range(1, 60), 25))]
    want, open_ = set(), {}
    for s, c, targets in sorted(snaps, key=lambda x: x[1]):
        for d in [d for (x, d) in open_ if x == s and d not in targets]:
            want.add((s, d, open_.pop((s, d)), c))
        for d in targets:
            open_.setdefault((s, d), c)
    want |= {(s, d, b, None) for (s, d), b in open_.items()}
    done = spark.createDataFrame([(s, c) for s, c, _ in snaps], "src long, commit_id long")
    targets = spark.createDataFrame([(s, d, 0, c) for s, c, t in snaps for d in t], "src long, dst long, kind int, commit_id long")
    got = intervals.build_intervals(done, targets)
    assert {(x["src"], x["dst"], x["born"], x["died"]) for x in got.collect()} == want
    assert {(x["src"], x["dst"]) for x in intervals.alive_at(got, 30).collect()} == {(s, d) for s, d, b, e in want if b <= 30 and (e is None or e > 30)}


def test_identity_swap_and_returns():
    state = identity.Identity()
    day = 86400
    state.commit(1, 0, [{"change": "A", "path": "a", "new_blob": "x"}, {"change": "A", "path": "b", "new_blob": "y"}])
    state.commit(2, day, [{"change": "R", "path": "b", "old_path": "a", "new_blob": "x"}, {"change": "R", "path": "a", "old_path": "b", "new_blob": "y"}])
    assert state.live == {"b": 1, "a": 2}
    state.commit(3, 2 * day, [{"change": "D", "path": "a"}, {"change": "D", "path": "b"}])
    state.commit(4, 200 * day, [{"change": "A", "path": "a", "new_blob": "y"}, {"change": "A", "path": "b", "new_blob": "new"}])
    assert state.live == {"a": 2, "b": 3}
    state.commit(5, 201 * day, [{"change": "M", "path": "never", "new_blob": "q"}])
    assert state.live["never"] == 4 and identity.rename_confidence("d/a.x", "e/b.x", "1", "2") == 0.6


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox", "a quick red fox"), (2, "dog", "the red dog ran"), (3, "fox dog", "foxes and dogs")], "id long, subject string, body string")
    index = textsearch.build(docs, "id", ["subject", "body"])

    def ask(q):
        got = textsearch.bm25(index, q).collect()
        assert sorted(got) == sorted(textsearch.bm25(textsearch.lookup(docs, "id", ["subject", "body"], q), q).collect())
        return {r["id"] for r in got}

    assert ask("red") == {1, 2} and ask("red fox") == {1} and ask('"red dog"') == {2} and ask("fox*") == {1, 3}
    assert ask("subject:dog") == {2, 3} and ask("red NOT fox") == {2} and ask("quick OR foxes") == {1, 3}
    assert ask("(quick OR ran) dog") == {2} and ask("red NOT (fox OR ran)") == set() and ask("subject:(fox dog)") == {3} and ask("fox OR dog AND ran") == {1, 2, 3}
    assert ask("NEAR(quick fox, 1)") == {1} and ask("NEAR(quick fox, 0)") == set() and ask("body:NEAR(the ran)") == {2} and ask("NEAR(fox quick)") == {1}
    assert ask("^red") == {1} and ask('"quick red" + fox') == {1} and ask("red + fo*") == {1} and ask("body:^the") == {2} and ask("a NOT quick") == set()
    for bad in ('"open', "AND x", "x NOT", "(a", "a)", "***", "NEAR(a b, x)", "()", "a OR", "x:"):
        with pytest.raises(textsearch.QueryError):
            textsearch.parse(bad)
    score = textsearch.bm25(index, "quick").first()["score"]
    n, df, length, avg = 3, 1, 6, (6 + 5 + 5) / 3
    assert score == pytest.approx(math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / avg)))


def test_extraction():
    def names(x):
        return {d["name"]: d["kind"] for d in x["defs"]}

    ts = extract.extract("ts", b"import {Foo as F, bar} from './foo';\nexport * from \"./re\";\nexport const answer = 1;\nclass Box extends Base { size(): number { return helper(new Thing()); } }\n// import x from 'no'\n")
    assert [(i["spec"], i["reexport"]) for i in ts["imports"]] == [("./foo", False), ("./re", True)] and {"Foo", "bar"} <= set(ts["imports"][0]["names"])
    assert names(ts)["answer"] == "const" and names(ts)["Box"] == "class" and {"helper", "Thing"} <= set(ts["calls"]) and "Base" in ts["type_refs"]
    py = extract.extract("py", b"import os.path\nfrom ..pkg import thing\nclass A:\n  def go(self):\n    return helper(self.run())\n")
    assert [i["spec"] for i in py["imports"]] == ["os.path", "..pkg"] and names(py) == {"A": "class", "go": "fn"} and py["calls"] == ["helper", "run"]
    assert [i["spec"] for i in extract.extract("py", b"import broken\ndef (:\n")["imports"]] == ["broken"]
    rust = extract.extract("rust", b"pub use crate::up::{left, down::deep as e};\nmod inner;\npub struct Point { x: Other }\nfn make() { build(); println!(\"hi\") }\n")
    assert [(i["spec"], i["reexport"]) for i in rust["imports"]] == [("crate::up::left", True), ("crate::up::down::deep", True), ("mod:inner", False)]
    assert extract.expand_use("use a::{self, b::{c as d, e}, f};") == [(p, False) for p in ("a::self", "a::b::c", "a::b::e", "a::f")]
    assert extract.expand_use("pub(crate) use x::y as z;") == [("x::y", True)] and extract.expand_use("use q::*;") == [("q::*", False)]
    assert names(rust)["Point"] == "struct" and {"build", "println"} <= set(rust["calls"]) and "Other" in rust["type_refs"]
    go = extract.extract("go", b'package m\nimport (\n "fmt"\n x "mod/pkg"\n)\nfunc (s *Server) Run() { helper(s) }\ntype Server struct { Next *Node }\n')
    assert [i["spec"] for i in go["imports"]] == ["fmt", "mod/pkg"] and names(go)["Run"] == "method" and "helper" in go["calls"] and "Node" in go["type_refs"]
    rb = extract.extract("rb", b"require 'json'\nrequire_relative 'lib/x'\nmodule M\n  class K < Base\n    def go\n      Other.call_it(1)\n    end\n  end\nend\n")
    assert [i["spec"] for i in rb["imports"]] == ["json", "rel:lib/x"] and names(rb) == {"K": "class", "M": "module", "go": "fn"} and "Other" in rb["type_refs"]
    co = extract.extract("coffee", b"{a, b} = require './util'\nclass Foo extends Bar\n  run: (x) -> helper(x)\n# require './no'\n")
    assert [i["spec"] for i in co["imports"]] == ["./util"] and names(co) == {"Foo": "class", "run": "fn"} and co["calls"] == ["helper"]
    md = extract.extract("md", b"[a](docs/x.md#top) [w](https://e.org) `src/main.rs` `Foo::parse_it()` `ab`")
    assert md["doc_links"] == ["docs/x.md", "src/main.rs"] and md["doc_tokens"] == ["parse_it"]
    assert extract.extract("ts", b"x" * (extract.MAX_BYTES + 1))["calls"] == [] and extract.extract(None, None)["imports"] == []


def test_resolution(spark):
    live = ["app/main.py", "app/__init__.py", "app/util.py", "web/a.ts", "web/b.ts", "web/dir/index.ts", "src/lib.rs", "src/deep/mod.rs", "src/deep/leaf.rs", "lib/tool.rb", "pkg/one.go", "pkg/one_test.go", "README.md",
            "cmd/run.go", "pkg/two.go", "bin/go.rb", "bin/near.rb", "kit/src/lib.rs", "kit/src/part.rs"]
    ids = {p: i for i, p in enumerate(live, 1)}
    said = {
        "app/main.py": ([("app.util", False), ("numpy", False), (".util", False)], ["only_here"], []), "web/a.ts": ([("./b.js", False), ("./dir", True), ("../gone", False)], ["twice"], []),
        "src/deep/leaf.rs": ([("crate::deep", False), ("super::super::nothing", False), ("std::fs", False), ("kit::part::Thing", False)], [], []), "pkg/one.go": ([("example.com/m/pkg", False)], [], []),
        "cmd/run.go": ([("example.com/m/pkg", False), ("example.com/late/pkg", False), ("fmt", False)], [], []), "bin/go.rb": ([("tool", False), ("rel:near", False), ("rel:none", False)], [], []),
        "lib/tool.rb": ([("tool", False)], [], []), "README.md": ([], [], ["src/lib.rs", "missing.md"]),
    }
    files = spark.createDataFrame([(ids[p], 5, p, value(spark, P.lang_of(F.lit(p))), p) for p in said], "src long, commit_id long, path string, lang string, blob_oid string")
    rows = [(p, "x", [{"spec": s, "reexport": r, "names": []} for s, r in i], calls, [], [], links, []) for p, (i, calls, links) in said.items()]
    parsed = spark.createDataFrame(rows, extract.PARSED)
    symbols = spark.createDataFrame([("only_here", ids["app/util.py"], 1, None), ("twice", 2, 1, None), ("twice", 3, 1, None), ("late", 3, 9, None)], "name string, file_id long, first_commit long, last_commit long")
    tree = spark.createDataFrame([(i, p, 1, None) for p, i in ids.items()] + [(99, "gone.ts", 1, 3)], "file_id long, path string, from_commit long, to_commit long")
    edges, health = resolve(files, parsed, symbols, tree, Manifests([(1, "example.com/m", None, None), (1, None, "kit", "kit/src"), (6, "example.com/late", None, None)]))
    at = {i: p for p, i in ids.items()}
    got = {(at[r["src"]], at[r["dst"]], r["kind"], r["resolution"]) for r in edges.collect()}
    assert got == {
        ("app/main.py", "app/util.py", 0, 0), ("app/main.py", "app/util.py", 1, 1), ("web/a.ts", "web/b.ts", 0, 0), ("web/a.ts", "web/dir/index.ts", 4, 0),
        ("src/deep/leaf.rs", "src/deep/mod.rs", 0, 0), ("src/deep/leaf.rs", "kit/src/part.rs", 0, 0), ("README.md", "src/lib.rs", 3, 0),
        ("cmd/run.go", "pkg/one.go", 0, 2), ("cmd/run.go", "pkg/two.go", 0, 2), ("pkg/one.go", "pkg/two.go", 0, 2), ("bin/go.rb", "lib/tool.rb", 0, 0), ("bin/go.rb", "bin/near.rb", 0, 0),
    }
    counts = {at[r["src"]]: (r["imports_total"], r["imports_resolved"]) for r in health.collect()}
    assert counts["cmd/run.go"] == (1, 1) and counts["bin/go.rb"] == (3, 2)
    assert counts["web/a.ts"] == (3, 2) and counts["app/main.py"] == (2, 2) and counts["README.md"] == (2, 1)


def test_manifests_as_of_a_commit():
    from driftline.plans.index import read_manifest

    assert read_manifest("go.mod", "// x\nmodule example.com/m \n\ngo 1.2\n") == ("example.com/m", None, None)
    toml = '[workspace]\nname = "no"\n[package]\nversion = "1"\nname = "my-kit"\n[lib]\nname = "other"\n'
    assert read_manifest("a/kit/Cargo.toml", toml) == (None, "my_kit", "a/kit/src") and read_manifest("Cargo.toml", "[lib]\nname = \"x\"\n")[1] is None
    m = Manifests([(3, "one", None, None), (5, None, "k", "a/src"), (9, "two", "k", "b/src")])
    assert [m.as_of(c) for c in (1, 3, 8, 9)] == [(None, {}), ("one", {}), ("one", {"k": "a/src"}), ("two", {"k": "b/src"})]


def test_drift_counts_after_the_last_touch(spark):
    pairs = spark.createDataFrame([(1, 7), (2, 7)], "doc long, code long")
    own = spark.createDataFrame([(1, 3), (1, 5)], "doc long, commit_id long")
    code = spark.createDataFrame([(7, c) for c in (4, 6, 8, 9)], "file_id long, commit_id long")
    commits = spark.createDataFrame([(c, 0.0 if c == 9 else 1.0) for c in range(1, 10)], "id long, weight double")
    got = {r["doc"]: (r["commits_behind"], r["code_last"]) for r in drift_pairs(pairs, own, code, commits).collect()}
    assert got == {1: (2, 9), 2: (3, 9)} and parse_kinds("live,nonsense") == {"live"}


def test_export(spark):
    lives = spark.createDataFrame([(1, 2, 0, True), (2, 3, 0, False), (1, 3, 0, False)], "src long, dst long, kind int, alive boolean")
    ghosts = spark.createDataFrame([(2, 3, 0)], "src long, dst long, kind int")
    names = spark.createDataFrame([(1, "a<b"), (2, "b"), (3, "c")], "id long, path string")
    states = export.edge_states(lives, ghosts)
    dot = [r["value"] for r in export.to_dot(states, names, names.select("id")).collect()]
    assert dot[0].startswith("digraph") and dot[-1] == "}" and '  "b" -> "c" [style=dashed];' in dot and len(dot) == 7
    xml = "\n".join(r["value"] for r in export.to_graphml(states, names, names.select("id")).collect())
    assert "a&lt;b" in xml and xml.count("<edge") == 2


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = hourly(spark.readStream.schema(events.schema).parquet(f"{DATA}/event[s].parquet"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hours").start()
    query.processAllAvailable()
    query.stop()
    got, want = ({(r["start"], r["event_type"]): (r["n"], round(r["value"], 6)) for r in t.collect()} for t in (spark.table("hours"), hourly(events)))
    assert got == want


@pytest.mark.parametrize("name", ["commit_classified", "touches_dedup", "cochange_pairs", "hotspots_churn", "edge_intervals", "edge_lifetimes", "ghosts", "drift", "path_bfs", "timeline_events", "stats", "search_bm25", "path_scalars", "link_extract", "path_hops", "transitive", "blast", *log_queries.QUERIES])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = (star_queries.QUERIES | log_queries.QUERIES)[name](spark, DATA)
    columns = sorted(found.columns)
    want = c.execute((star_sql.oracle() | log_sql.oracle())[name])
    heads = [d[0] for d in want.description]
    assert sorted(heads) == columns
    b = sorted((tuple(r[heads.index(k)] for k in columns) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[k] for k in columns) for r in found.collect()), key=repr) == b


def test_every_query_has_its_sql():
    assert star_queries.QUERIES.keys() | log_queries.QUERIES.keys() == star_sql.oracle().keys() | log_sql.oracle().keys()


def test_stream_extends_batch_by_batch(spark, tmp_path):
    from driftline.streaming.events import extend

    at, seen = str(tmp_path / "in"), []
    spark.range(5).write.parquet(at)
    for more in (0, 3):
        if more:
            spark.range(5, 5 + more).write.mode("append").parquet(at)
        extend(spark.readStream.schema("id long").parquet(at), lambda df, _: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "done")).awaitTermination()
    assert sorted(seen) == list(range(8))
