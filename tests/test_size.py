"""What is shuffled and held: the number of shuffles of a plan, and tasks in proportion to the rows."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import cochange
from driftline.operators.evidence import drift_behind
from driftline.plans import star_queries
from driftline.sources import changelog, star, store
from driftline.sources.store import shared_table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def h(spark):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(store, "ROWS", 2000)
        yield star_queries._h(spark, DATA)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lives_and_ghosts_take_one_shuffle_each(h):
    lives = star_queries._lives(h)
    assert shuffles(lives) == 1
    assert shuffles(star_queries._ghosts(h, shared_table(lives))) == 1


def test_pairs_and_drift_are_shuffled_in_arrays(h):
    assert shuffles(cochange.together(star_queries._sets(h), h["tasks"])) == 1
    touched = h["sets"].select(F.explode("files").alias("code"), "commit_id", F.lit(True).alias("counts"))
    assert shuffles(drift_behind(star.doc_links(h["sets"], h["tasks"]), touched, h["tasks"])) == 2


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 500)
    log = changelog.changes(star.history(spark, DATA))
    assert log._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert log.rdd.getNumPartitions() == -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)


def test_small_tables_only_are_broadcast(spark, monkeypatch):
    few = spark.range(5).withColumn("x", F.col("id"))
    monkeypatch.setattr(store, "FEW", 3)
    assert store.small(few) is few
    monkeypatch.setattr(store, "FEW", 5)
    assert store.small(few) is not few


def test_identity_is_folded_by_groups_of_paths(spark, monkeypatch):
    """Random histories against one fold over each, and no task that takes a whole history."""
    import random

    from driftline.operators import identity

    monkeypatch.setattr(store, "ROWS", 100)
    monkeypatch.setattr(identity, "_BATCH", 7)
    rows, trees, want = [], [], []
    for history in ("g", "h"):
        r, state, live, dead = random.Random(history), identity.Identity(), set(), set()
        for path in ("s0", "s1", "p3"):
            trees.append((history, path, "b"))
            live.add(path)
        for path in sorted(live):
            state.seed(path, "b")
        for commit in range(1, 260):
            changes, used = [], set()
            for _ in range(r.randrange(1, 5)):
                path, old, kind, blob = f"p{r.randrange(40)}", None, "A", f"b{r.randrange(3)}"
                if live and r.random() < 0.7:
                    path, kind = r.choice(sorted(live)), r.choice("MMDR")
                if kind == "R":
                    old, path = path, f"p{r.randrange(40)}" if r.random() < 0.1 else path.partition("-")[0] + f"-{r.randrange(3)}"
                if {path, old} & used or (kind in "AR" and path in live):
                    continue
                used |= {path, old}
                changes.append({"change": kind, "path": path, "old_path": old, "new_blob": None if kind == "D" else blob, "lines_added": 1, "lines_removed": None})
                live -= {old} | ({path} if kind == "D" else set())
                live |= {path} if kind != "D" else set()
            state.commit(commit, commit * 86400 * 5, changes)
            rows += [(history, commit, commit * 86400 * 5, c["change"], c["path"], c["old_path"], c["new_blob"], 1, None) for c in changes]
        state.finish()
        want += [(history, *(x if i != 4 or row[0] != "files" else None for i, x in enumerate(row))) for row in state.rows]
    shape = "history string, commit_id long, author_time long, change string, path string, old_path string, new_blob string, lines_added long, lines_removed long"
    got = identity.fold(spark.createDataFrame(rows, shape), spark.createDataFrame(trees, "history string, path string, blob string"))
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert {r[1] for r in want} == {"files", "file_paths", "touches", "deaths", "returns"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_package_import_links_to_every_file_of_it(spark):
    from driftline.operators.extract import PARSED
    from driftline.operators.resolve import Manifests, resolve

    tree = [(i, f"pkg/f{i}.go", i, None) for i in range(1, 31)] + [(31, "cmd/run.go", 1, None), (32, "pkg/gone.go", 1, 5), (33, "pkg/x_test.go", 1, None)]
    live = spark.createDataFrame(tree, "file_id long, path string, from_commit long, to_commit long")
    asked = [(31, 40, "cmd/run.go", "go", "a"), (31, 27, "cmd/run.go", "go", "a"), (30, 40, "pkg/f30.go", "go", "a"), (31, 3, "cmd/run.go", "go", "b")]
    files = spark.createDataFrame(asked, "src long, commit_id long, path string, lang string, blob_oid string")
    told = [("a", "go", [{"spec": s, "reexport": False, "names": ["named"] * (s == "m/pkg")} for s in ("m/pkg", "m/pkg", "m/none", "fmt")], [], [], [], [], []),
            ("b", "go", [{"spec": "m/pkg", "reexport": False, "names": []}], [], [], [], [], [])]
    symbols = spark.createDataFrame([("named", 7, 1, None)], "name string, file_id long, first_commit long, last_commit long")
    edges, health = resolve(files, spark.createDataFrame(told, PARSED), symbols, live, Manifests([(1, "m", None, None)]))
    want = {(31, 40, i) for i in range(1, 31)} | {(31, 27, i) for i in range(1, 28)} | {(30, 40, i) for i in range(1, 30)} | {(31, 3, i) for i in (1, 2, 3, 32)}
    rows = edges.collect()
    assert len(rows) == len(want) and {(r["src"], r["commit_id"], r["dst"]) for r in rows} == want
    # The named symbol is the exacter link to file 7.
    assert all(r["resolution"] == (1 if r["dst"] == 7 else 2) and r["kind"] == 0 for r in rows)
    assert {tuple(r) for r in health.collect()} == {(31, 40, 3, 2), (31, 27, 3, 2), (30, 40, 3, 2), (31, 3, 1, 1)}
    assert "collect_list" not in health._jdf.queryExecution().toString()
