"""A scripted repository, indexed end to end: severed link, renames, deletion and return, lint storm, incremental run."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from driftline.operators.evidence import blast
from driftline.operators.intervals import lifetimes
from driftline.params import Params
from driftline.plans import index
from driftline.sources import git
from driftline.sources.store import IndexMissing, Store, display_paths, resolve_paths

P = Params()


class Repo:
    def __init__(self, path):
        self.path = str(path)
        self.run("init", "-q", "-b", "main")

    def run(self, *args, date=None):
        env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x"}
        if date:
            env |= {"GIT_AUTHOR_DATE": f"{date}T12:00:00Z", "GIT_COMMITTER_DATE": f"{date}T12:00:00Z"}
        subprocess.run(["git", "-C", self.path, "-c", "core.autocrlf=false", *args], env=env, check=True, capture_output=True)

    def write(self, name, text):
        at = os.path.join(self.path, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write(text)

    def commit(self, date, subject):
        self.run("add", "-A")
        self.run("commit", "-q", "-m", subject, date=date)


def body(word, n):
    return "".join(f"export function {word}{i}(x) {{ return x + {i}; }}\n" for i in range(20)) + f"// {n}\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = Repo(tmp_path_factory.mktemp("repo"))
    encoder = "import {{ frame0 }} from './{}';\nexport function encode(x) {{ return frame0(x); }}\n// {}\n"
    r.write("src/pane.ts", body("frame", 0))
    r.write("src/encoder.ts", encoder.format("pane", 0))
    r.write("src/parser.ts", body("parse", 0))
    r.write("tests/golden.txt", "0\n")
    r.commit("2024-01-10", "Start")
    for i, d in enumerate(("2024-02-05", "2024-03-05", "2024-04-05", "2024-06-01"), 1):
        r.write("src/pane.ts", body("frame", i))
        r.write("src/encoder.ts", encoder.format("pane", i))
        r.commit(d, f"Frame work {i}")
    for i, d in enumerate(("2024-02-10", "2024-05-10", "2024-09-10", "2025-02-10", "2025-06-06"), 1):
        r.write("src/parser.ts", body("parse", i))
        r.write("tests/golden.txt", f"{i}\n")
        r.commit(d, f"Parser fix {i}")
    r.write("src/iface.ts", "export function frame0(x) { return x; }\n")
    r.write("src/pane.ts", body("frame", 5).replace("frame0", "frameZero"))
    r.write("src/encoder.ts", encoder.format("iface", 5))
    r.commit("2024-08-15", "Extract the interface")
    for i, d in enumerate(("2024-10-01", "2024-12-01", "2025-03-01", "2025-06-01", "2025-09-01"), 6):
        r.write("src/pane.ts", body("frame", i).replace("frame0", "frameZero"))
        r.write("src/encoder.ts", encoder.format("iface", i))
        r.commit(d, f"Tune {i}")
    r.write("src/inner/pane.ts", open(os.path.join(r.path, "src/pane.ts")).read())
    os.remove(os.path.join(r.path, "src/pane.ts"))
    r.commit("2025-10-01", "Move")
    os.rename(os.path.join(r.path, "src/inner/pane.ts"), os.path.join(r.path, "src/inner/holder.ts"))
    r.commit("2025-10-15", "Rename")
    parser = open(os.path.join(r.path, "src/parser.ts")).read()
    os.remove(os.path.join(r.path, "src/parser.ts"))
    r.commit("2025-11-01", "Drop the parser")
    r.write("src/parser.ts", parser)
    r.commit("2025-11-20", "Bring it back")
    for i in range(10):
        r.write(f"lint/m{i}.ts", f"import {{ encode }} from '../src/encoder';\nexport function lint{i}() {{ return encode({i}); }}\n")
    r.commit("2025-12-01", "Add modules")
    for i in range(10):
        r.write(f"lint/m{i}.ts", f"import {{ encode }} from '../src/encoder.ts';\nexport function lint{i}() {{ return encode({i}); }}\n")
    r.commit("2025-12-15", "chore: lint imports")
    return r


@pytest.fixture(scope="module")
def store(spark, repo, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "store")
    s, report = index.build(spark, repo.path, out, P)
    assert report == {"commits_indexed": 22, "caveats": []}
    return s


def names(store):
    return {r["id"]: r["path"] for r in display_paths(store.table("files"), store.table("file_paths")).collect()}


def test_identity(store):
    files = {r["current_path"]: r for r in store.table("files").collect()}
    assert {"src/inner/holder.ts", "src/encoder.ts", "src/parser.ts", "src/iface.ts", "tests/golden.txt"} <= set(files)
    frame = files["src/inner/holder.ts"]
    spans = store.table("file_paths").where(F.col("file_id") == frame["id"]).orderBy("from_commit").collect()
    assert [s["path"] for s in spans] == ["src/pane.ts", "src/inner/pane.ts", "src/inner/holder.ts"]
    assert frame["born_commit"] == 1 and files["src/parser.ts"]["born_commit"] == 1 and files["src/parser.ts"]["died_commit"] is None
    ask = store.spark.createDataFrame([("./src/pane.ts",), ("nowhere",)], "path string")
    got = {r["path"]: r["file_id"] for r in resolve_paths(ask, store.table("files"), store.table("file_paths")).collect()}
    assert got == {"./src/pane.ts": frame["id"], "nowhere": None}


def test_ghost_and_mechanical(store):
    n = names(store)
    cuts = {r["id"]: r["subject"] for r in store.table("commits").collect()}
    found = [(n[r["src"]], n[r["dst"]], cuts[r["severed_commit"]], r) for r in store.table("ghosts").where("kind = 0").collect()]
    ghost = next(g for g in found if g[:2] == ("src/encoder.ts", "src/inner/holder.ts"))
    assert ghost[2] == "Extract the interface" and ghost[3]["cochanges_since"] >= 2 and ghost[3]["conf_since"] >= 0.25
    assert not any(a.startswith("lint/") for a, *_ in found)
    assert store.table("commits").where("(excluded & 2) <> 0").count() >= 1


def test_cochange_and_blast(store):
    n = {v: k for k, v in names(store).items()}
    a, b = sorted((n["src/parser.ts"], n["tests/golden.txt"]))
    pair = store.table("cochange").where((F.col("a") == a) & (F.col("b") == b)).first()
    assert pair["n"] >= 3 and pair["lift"] > 1.5
    lives = lifetimes(store.table("edge_intervals"), store.table("commits"))
    got = blast(n["src/encoder.ts"], lives, store.table("edges"), store.table("ghosts"), store.table("cochange"), store.table("files"), store.table("commits"), P).orderBy(F.desc("rank"), "file_id").collect()
    frame = next(r for r in got if r["file_id"] == n["src/inner/holder.ts"])
    assert {"ghost", "cochange"} <= {e["type"] for e in frame["evidence"]}
    assert frame["rank"] >= max(r["rank"] for r in got) - 0.35


def test_incremental_and_guards(spark, repo, store, tmp_path):
    with pytest.raises(FileExistsError):
        index.build(spark, repo.path, store.path, P)
    with pytest.raises(IndexMissing):
        Store(spark, str(tmp_path))
    again, report = index.build(spark, repo.path, store.path, P, incremental=True)
    assert report["commits_indexed"] == 0
    before = names(again)
    repo.write("src/encoder.ts", "import { frame0 } from './iface';\nexport function encode(x) { return frame0(x) + 1; }\n")
    repo.commit("2026-01-05", "One more")
    assert index.staleness(again, repo.path) == "the store is 1 commits behind"
    after, report = index.build(spark, repo.path, store.path, P, incremental=True)
    assert report == {"commits_indexed": 1, "caveats": []} and names(after) == before
    assert after.table("commits").count() == 23 and git.head(repo.path) == after.meta["head_oid"]
    # The store of an incremental run is that of a run over everything.
    whole, _ = index.build(spark, repo.path, str(tmp_path / "whole"), P)
    for name in ("files", "file_paths", "touches", "symbols", "edges", "edge_intervals", "resolved", "import_health"):
        a, b = (x.table(name) for x in (after, whole))
        assert sorted(map(repr, a.select(b.columns).collect())) == sorted(map(repr, b.collect())), name
    assert (after.meta["imports_total"], after.meta["imports_resolved"]) == (whole.meta["imports_total"], whole.meta["imports_resolved"])


def test_command_line(spark, store, tmp_path, capsys):
    import json

    from driftline.cli import main

    def ask(*args):
        assert main(["--store", store.path, "--json", *args], spark) == 0
        return json.loads(capsys.readouterr().out)

    first = ask("blast", "src/encoder.ts")["results"]
    assert "src/inner/holder.ts" in [r["path"] for r in first]
    got = ask("path", "src/encoder.ts", "src/pane.ts")
    assert got["live_path"] is None and got["broke_at"]["subject"] == "Extract the interface"
    why = ask("why", "src/encoder.ts", "src/inner/holder.ts")
    assert any(e.get("ghost", {}).get("severed", {}).get("subject") == "Extract the interface" for e in why["edges"])
    line = ask("timeline", "src/pane.ts")
    assert line["file"] == "src/inner/holder.ts" and len(line["paths"]) == 3 and line["churn"]
    assert ask("cochange", "src/parser.ts")["results"][0]["path"] == "tests/golden.txt"
    assert ask("stats")["commits"]["excluded_mechanical"] >= 1
    assert ask("search", "interface extract")["results"][0]["commit"]["subject"] == "Extract the interface"
    assert main(["--store", store.path, "blast", "no/such.file"], spark) == 3
    assert main(["--store", str(tmp_path), "stats"], spark) == 2


def test_text_answers(spark, store, capsys):
    from driftline.cli import main

    def ask(*args):
        assert main(["--store", store.path, *args], spark) == 0
        return capsys.readouterr().out

    got = ask("blast", "src/encoder.ts")
    assert "src/inner/holder.ts" in got and "Extract the interface" in got and "ghost import link" in got
    assert "it broke in" in ask("path", "src/encoder.ts", "src/pane.ts") and "Live path" in ask("path", "src/encoder.ts", "src/iface.ts")
    assert "ghost since" in ask("why", "src/encoder.ts", "src/inner/holder.ts") and "src/inner/holder.ts" in ask("timeline", "src/pane.ts")
    assert "src/encoder.ts -> src/inner/holder.ts" in ask("ghosts") and "tests/golden.txt" in ask("cochange", "src/parser.ts")
    assert "mechanical" in ask("stats") and "Hotspots by churn" in ask("hotspots", "--limit", "1") and "larger --limit" in ask("hotspots", "--limit", "1")
    assert "Extract the interface" in ask("search", "interface") and ask("drift").strip()


def test_json_export_and_states(spark, store):
    from driftline.operators.ghosts import ghosts
    from driftline.plans import export

    lives = lifetimes(store.table("edge_intervals"), store.table("commits"))
    states = export.edge_states(lives, store.table("ghosts"))
    got = export.to_json(states, display_paths(store.table("files"), store.table("file_paths")), store.table("cochange"))
    assert any('"state":"ghost"' in r["value"] and "holder.ts" in r["value"] for r in got["edges"].collect())
    assert got["files"].count() == store.table("files").count() and got["cochange"].count() == store.table("cochange").count()
    assert ghosts(store.table("commits"), store.table("touches"), store.table("files"), lives, P).count() == store.table("ghosts").count()


def test_serve(spark, store):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import urlopen

    from driftline.cli import Ask
    from driftline.plans import serve

    data = Ask(store).web()
    paths = [n[0] for n in data["nodes"]]
    assert "src/encoder.ts" in paths and data["meta"]["live"] == len(data["live"]) > 0 and len(data["groups"]) <= 8
    assert all(0 <= n[1] < len(data["groups"]) and n[2] >= 0 for n in data["nodes"]) and all(a < len(paths) and b < len(paths) for a, b in data["live"])
    with serve.server(lambda: data, 0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{http.server_port}"
        with urlopen(f"{at}/data.json") as r:
            assert json.load(r) == json.loads(json.dumps(data)) and r.headers["Cache-Control"] == "no-store"
        with urlopen(at) as r:
            assert "src/encoder.ts" in r.read().decode() and "default-src 'none'" in r.headers["Content-Security-Policy"]
        with pytest.raises(HTTPError):
            urlopen(f"{at}/else")
        http.shutdown()
    assert "</script><b" not in serve.page({"nodes": ["</script><b>"]})


def test_store_keeps_the_generation_before(spark, tmp_path):
    import os

    at = str(tmp_path / "s")
    for k in range(3):
        store = Store.write(spark, at, {"meta": spark.createDataFrame([(k,)], "k long")}, {"n": str(k)})
        assert store.table("meta").first()["k"] == k and store.meta["n"] == str(k)
    assert sum(x.startswith("gen-") for x in os.listdir(at)) == 2 and not store.has("ghosts")


def test_a_link_through_a_death_a_return_and_a_late_drop(spark, tmp_path_factory):
    """The source drops its import while the target is gone; the return opens the link until the source is read again."""
    r = Repo(tmp_path_factory.mktemp("returns"))
    r.write("src/a.ts", "import { x } from './b';\nexport const a0 = x;\n")
    r.write("src/b.ts", body("part", 0))
    r.commit("2024-01-01", "one")
    text = open(os.path.join(r.path, "src/b.ts")).read()
    os.remove(os.path.join(r.path, "src/b.ts"))
    r.commit("2024-01-05", "gone")
    r.write("src/b.ts", text)
    r.commit("2024-01-09", "back")
    r.write("src/a.ts", "export const a0 = 1;\n")
    r.commit("2024-01-20", "dropped")
    store, _ = index.build(spark, r.path, str(tmp_path_factory.mktemp("kept") / "s"), P)
    n = {v: k for k, v in names(store).items()}
    got = store.table("edge_intervals").where((F.col("src") == n["src/a.ts"]) & (F.col("dst") == n["src/b.ts"]) & (F.col("kind") == 0)).orderBy("born").collect()
    assert [(x["born"], x["died"]) for x in got] == [(1, 2), (3, 4)]


def test_seeds_since_and_all_parents(spark, repo, tmp_path):
    """An index that starts in the middle of a history knows the tree before it."""
    store, report = index.build(spark, repo.path, str(tmp_path / "s"), P, since="2025-06-01", first_parent=False)
    assert 0 < report["commits_indexed"] < 22
    files = {x["current_path"]: x for x in store.table("files").collect()}
    assert files["src/encoder.ts"]["born_commit"] == 0 and files["tests/golden.txt"]["born_commit"] == 0
    assert store.table("edge_intervals").where("born = 0").count() > 0
    assert store.table("symbols").where("name = 'parse1' AND first_commit = 0").count() >= 1
