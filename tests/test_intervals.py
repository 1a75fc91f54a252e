"""Link intervals under deaths and returns, against a sequential fold of the same history."""

import random

import pytest

from driftline.operators.intervals import build_intervals, intervals_with_deaths, life_spans


def replay(history, paths):
    """Intervals by going through the commits one by one.

    `history`: for each commit (deaths, returns, {source: declared targets}).
    """
    live, links, held, rows = set(), set(), {}, {}
    for commit, (deaths, returns, snapshots) in enumerate(history, 1):
        def shut(link):
            links.discard(link)
            for row in rows[link]:
                if row[1] is None:
                    row[1] = commit

        def start(link):
            links.add(link)
            if all(row[0] != commit for row in rows.setdefault(link, [])):
                rows[link].append([commit, None])

        for f in sorted(deaths, key=paths.get):
            live.discard(f)
            for link in [x for x in links if x[0] == f]:
                shut(link)
            held[f] = [x for x in links if x[1] == f]
            for link in held[f]:
                shut(link)
        for f in sorted(returns, key=paths.get):
            live.add(f)
            for link in held.pop(f, []):
                if link[0] in live:
                    start(link)
        for f, targets in snapshots.items():
            new = {(f, t) for t in targets}
            for link in [x for x in links if x[0] == f and x not in new]:
                shut(link)
            for link in new - links:
                start(link)
    return sorted((*link, born, died) for link, spans in rows.items() for born, died in spans)


def ask(spark, history, paths):
    deaths = [(f, c, paths[f]) for c, (d, _, _) in enumerate(history, 1) for f in d]
    births = [(f, c, paths[f]) for c, (_, r, _) in enumerate(history, 1) for f in r]
    snaps = [(f, c) for c, (_, _, s) in enumerate(history, 1) for f in s]
    said = [(f, t, 0, c) for c, (_, _, s) in enumerate(history, 1) for f, ts in s.items() for t in ts]
    shape = "file_id long, commit_id long, path string"
    spans = life_spans(spark.createDataFrame(births, shape), spark.createDataFrame(deaths, shape))
    got = intervals_with_deaths(spark.createDataFrame(snaps, "src long, commit_id long"), spark.createDataFrame(said, "src long, dst long, kind int, commit_id long"), spans)
    return sorted(((r["src"], r["dst"], r["born"], r["died"]) for r in got.collect()), key=repr)


def step(deaths=(), returns=(), **snapshots):
    return set(deaths), set(returns), {int(k[1:]): set(v) for k, v in snapshots.items()}


def test_a_link_dropped_after_its_target_returned_is_dead(spark):
    history = [step(returns=[1, 2]), step(f1=[2]), step(deaths=[2]), step(returns=[2]), step(f1=[])]
    assert ask(spark, history, {1: "a", 2: "b"}) == [(1, 2, 2, 3), (1, 2, 4, 5)]


def test_every_death_of_a_target_ends_its_links(spark):
    history = [step(returns=[1, 2]), step(f1=[2]), step(deaths=[2]), step(returns=[2]), step(deaths=[2])]
    assert ask(spark, history, {1: "a", 2: "b"}) == [(1, 2, 2, 3), (1, 2, 4, 5)]


def test_a_return_opens_links_of_living_sources_only(spark):
    history = [step(returns=[1, 2, 3]), step(f1=[2], f3=[2]), step(deaths=[2]), step(deaths=[1], f3=[]), step(returns=[2]), step(returns=[1])]
    assert ask(spark, history, {1: "a", 2: "b", 3: "c"}) == [(1, 2, 2, 3), (3, 2, 2, 3), (3, 2, 5, None)]


@pytest.mark.parametrize("seed", range(6))
def test_intervals_equal_a_replay(spark, seed):
    r = random.Random(seed)
    files = list(range(1, 9))
    paths = {f: r.choice("abcdefgh") + str(f) for f in files}
    live, known, history = set(), set(), []
    for _ in range(150):
        deaths = {f for f in live if r.random() < 0.06}
        live -= deaths
        returns = {f for f in files if f not in live and f not in deaths and r.random() < 0.2} | {f for f in deaths if r.random() < 0.1}
        live |= returns
        # A file is read when it first appears or returns, and now and then.
        read = {f for f in live if r.random() < 0.15 or f in returns and r.random() < 0.7}
        history.append((deaths, returns, {f: {t for t in live if t != f and r.random() < 0.35} for f in read}))
        known |= live
    got = ask(spark, history, paths)
    assert got == sorted(replay(history, paths), key=repr) and len(got) > 100


def test_without_deaths_both_operators_agree(spark):
    r = random.Random(40)
    snaps = spark.createDataFrame([(f, c) for c in range(1, 60) for f in range(5) if r.random() < 0.4], "src long, commit_id long")
    said = snaps.collect()
    targets = spark.createDataFrame([(x["src"], t, 0, x["commit_id"]) for x in said for t in range(5) if t != x["src"] and r.random() < 0.5], "src long, dst long, kind int, commit_id long")
    shape = "file_id long, commit_id long, path string"
    spans = life_spans(spark.createDataFrame([(f, 0, "p") for f in range(5)], shape), spark.createDataFrame([], shape))
    a = intervals_with_deaths(snaps, targets, spans)
    b = build_intervals(snaps, targets).select("src", "dst", "kind", "born", "died")
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
