"""The pipeline's stages against brute force, on repeated, blank, very long and tied rows and clashing columns."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from driftline.llm import langid, pii, queries, simhash  # noqa: E402
from driftline.llm.common import materialise, small_batches  # noqa: E402

from .test_operators import DOCS, OWN, WORDS, brute_components, brute_print, brute_spans, by_id, make_docs, reference, water_fill, words_of  # noqa: E402, F401


@pytest.fixture(scope="module")
def rows():
    import random

    r = random.Random(3)
    prose = [" ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(40)) for _ in range(30)]
    out = [(i, t, "en" if i % 2 else "fr", f"src{i % 5}") for i, t in enumerate(prose)]
    out += [(50, prose[3], "en", "src1"), (51, None, "en", "src1"), (52, "?? 12", None, None), (53, prose[4] + " mail me at a.b@c.example now", None, None)]
    # A repeated row, an id on two texts, null ids, a long text, an address in a tie of equal texts.
    out += [(54, prose[9][::-1], "fr", "src0")] * 2 + [(55, prose[7][::-1], "en", "src2"), (55, prose[8][::-1], "en", "src2"), (None, prose[5][::-1], "en", None), (None, prose[6][::-1], None, "src3")]
    out += [(56, " ".join(r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(20000)), "en", "src0"), (57, "ping 10.0.0.1 or +1 (212) 555-0199 now", "en", "src1"), (58, "ping 10.0.0.1 or +1 (212) 555-0199 now", "en", "src1")]
    return out


def own(df):
    return [tuple(r[:4]) for r in df.collect()]


def brute_language(docs, rows):
    """The rows that the model, applied text by text, calls a language with enough confidence."""
    model = langid.fit(docs)
    kept = []
    for row in rows:
        lang, score = (x[0] for x in langid._decide(model, [row[1]]))
        if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            kept.append(row)
    return kept


def brute_near(rows):
    prints = [brute_print(t) for _, t, *_ in rows]
    root = brute_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    groups = {}
    for i, c in enumerate(root):
        groups.setdefault(c, []).append(rows[i])
    # Any row with the smallest id may stay.
    return [{r for r in g if r[0] == min((x[0] for x in g if x[0] is not None), default=None)} for g in groups.values()]


def brute_redacted(text):
    if text is None:
        return None
    out, end = "", 0
    for k, a, b in brute_spans(text):
        if a >= end:
            out, end = out + text[end:a] + f"[{pii.KINDS[k].upper()}]", b
        else:
            end = max(end, b)
    return out + text[end:]


def brute_mix(rows):
    """Rows of the mix: budgets by filling, then the seeded order of each leaf."""
    import hashlib

    p = corpus_pipeline.ONE_EPOCH
    domain = {None: "none"} | {s: "crawl" if s == "src0" else "curated" if len(s) == 4 else "reference" for _, _, _, s in rows if s}
    leaf = [(domain[s], lang or "und", s or "none") for _, _, lang, s in rows]
    n = [len(words_of(t)) for _, t, *_ in rows]
    supply = {}
    for x, c in zip(leaf, n):
        supply[x] = supply.get(x, 0) + c

    def cap(prefix):
        return sum(p.max_epochs * v for k, v in supply.items() if k[: len(prefix)] == prefix)

    alloc = {}
    for d, b in water_fill(sum(n) * p.budget_permille // 1000, [(d, p.domains.get(d, 1), cap((d,))) for d in sorted({x[0] for x in supply})]).items():
        for g, c in water_fill(b, [(g, p.langs.get(g, 1), cap((d, g))) for g in sorted({x[1] for x in supply if x[0] == d})]).items():
            for s, a in water_fill(c, [(s, p.sources.get(s, 1), cap((d, g, s))) for s in sorted({x[2] for x in supply if x[:2] == (d, g)})]).items():
                alloc[d, g, s] = a
    out = []
    for x, total in supply.items():
        full, rest = divmod(alloc.get(x, 0), total) if total else (0, 0)
        mine = [(hashlib.md5(f"{p.seed}:{full}:{'null' if row[0] is None else row[0]}".encode()).hexdigest(), row, c) for row, y, c in zip(rows, leaf, n) if y == x]
        for key, row, c in mine:
            if c:
                out += [row] * (full + (sum(z for k, _, z in mine if k <= key) <= rest))
    return out


def test_stages(spark, rows, reference):  # noqa: F811
    small_batches(spark)
    docs, now = make_docs(spark, rows).repartition(3), rows
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, ""))
        if name == "language_id":
            want = brute_language(docs, now)
            assert by_id(own(out)) == by_id(want) and not {51, 52} & {r[0] for r in want} and 56 in {r[0] for r in want}
        elif name == "near_duplicates":
            left = own(out)
            groups = brute_near(now)
            assert len(left) == len(groups) and all(sum(row in g for row in set(left)) == 1 for g in groups)
            assert 50 not in {r[0] for r in left} and sum(r[0] == 54 for r in left) == 1
        elif name == "personal_data":
            want = [(i, brute_redacted(t), lang, s) for i, t, lang, s in now]
            assert by_id(own(out)) == by_id(want) and any("[EMAIL]" in t for _, t, *_ in want) and any("[IP] or [PHONE]" in t for _, t, *_ in want)
            assert out.where(F.col("n_chars") != F.char_length("text")).count() == 0
        elif name == "source_mix":
            assert by_id(own(out)) == by_id(brute_mix(now)) and out.count() < len(now)
        if name != "byte_bpe":
            assert out.columns == DOCS.names and {tuple(r)[5:] for r in out.collect()} == {OWN}
            docs, now = out, own(out)
        else:
            enc = reference[1]
            want = [(i, lang, s, len(x := enc.encode_ordinary(t or "")), x, True) for i, t, lang, s in now]
            assert isinstance(enc, tiktoken.Encoding) and by_id(map(tuple, out.collect())) == by_id(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "source_mix", "byte_bpe"]
    assert re.search("crawl", queries.DOMAIN_SQL) and public_tokenizers.PATTERN


def test_near_duplicates_sends_no_signatures_through_the_driver(spark, rows, monkeypatch):
    tables = []
    monkeypatch.setattr(simhash, "materialise", lambda df: tables.append(df) or materialise(df))
    corpus_pipeline.near_duplicates(spark, make_docs(spark, rows), "").count()
    (pairs,) = (df for df in tables if df.columns == ["a", "b"])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_empty(spark):
    docs = make_docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""))
        assert docs.count() == 0
