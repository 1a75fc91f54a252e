"""Each operator against a brute-force version or an exact round trip, on awkward small tables."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm import bpe, embed, fingerprint, langid, mixing, pii, sharding, simhash, substring, toxicity
from driftline.llm.common import materialise, small_batches
from driftline.llm.components import connected_components

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Columns whose names the operators use themselves.
    T.StructField("size", T.StringType()), T.StructField("score", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("row", T.LongType()),
    T.StructField("_id", T.StringType()), T.StructField("_hash", T.StringType()), T.StructField("_extra", T.StringType()), T.StructField("_judged", T.StringType()), T.StructField("_row", T.StringType()),
])
#: What those columns hold; whatever returns the columns of its table must return these.
OWN = ("x", "y", 1, 2, 3, "a", "b", "c", "d", "e")
WORDS = "the cat sat on a mat and dogs ran over hills while rain fell softly upon grey stones near old rivers".split()


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *OWN) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a shared passage, blanks, nulls, a repeated row, a long text."""
    r = random.Random(4)

    def prose(n):
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    passage, base = prose(70), prose(160)
    near = base.split()
    near[3] = "changed"
    out = [(i, prose(r.randrange(1, 120)), "en", f"src{i % 4}") for i in range(40)]
    out += [(40 + i, base, "en", "src0") for i in range(12)] + [(60, " ".join(near), "en", "src1"), (61, f"{prose(30)} {passage} {prose(20)}", "fr", None), (62, f"{passage}\n{prose(60)}", None, "src2")]
    out += [(70, "", "en", "src0"), (71, None, "en", "src0"), (72, " \t\n ", None, None), (None, "no id here at all", "en", "src3"), (73, prose(20000), "en", "src0"), (74, "1234 !!", "en", "src1")]
    out += [(75, "twice the same row", "en", "src1")] * 2
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    small_batches(spark)
    return make_docs(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return make_docs(spark, [])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 1 toxicity


def brute_kneser_ney(counts, k, discount):
    """P(letter | context) of class k from the definition, with nothing remembered."""
    def types(size):
        return {g[-size:] for g in counts}

    def lower(context, letter):
        low = lower(context[1:], letter) if context else 1 / len(types(1))
        # How many letters precede each continuation of the context.
        n = {x: sum(g[1:] == context + x for g in types(len(context) + 2)) for x in sorted({g[-1] for g in counts})}
        total = sum(n.values())
        return (max(n.get(letter, 0) - discount, 0) + discount * sum(c > 0 for c in n.values()) * low) / total if total else low

    def prob(context, letter):
        n = {g[-1]: c[k] for g, c in counts.items() if g[:-1] == context and c[k]}
        total = sum(n.values())
        low = lower(context[1:], letter)
        return (max(n.get(letter, 0) - discount, 0) + discount * len(n) * low) / total if total else low

    return prob


def test_kneser_ney_sums_to_one_and_equals_its_definition():
    r = random.Random(21)
    text = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    counts = {}
    for k, words in enumerate((text[:25], text[25:])):
        for w in words:
            for g in toxicity.grams_of(w, 3):
                c = list(counts.get(g, (0, 0)))
                c[k] += 1
                counts[g] = tuple(c)
    model = toxicity.KneserNey(counts, 0.75)
    contexts = {g[:-1] for g in counts} | {"zz", "az", "ba"}
    for k in (0, 1):
        brute = brute_kneser_ney(counts, k, 0.75)
        for ctx in contexts:
            p = [model.prob(ctx + x, k) for x in model.letters]
            assert math.isclose(sum(p), 1) and min(p) > 0
            assert np.allclose(p, [brute(ctx, x) for x in model.letters])
    grams, backoff = toxicity.log_ratios(counts, 0.75)
    scorer = toxicity.Scorer(grams, backoff, toxicity.ToxicityParams(order=3, passage=2))
    words = ["abca", "zq", "dd", "cab"]
    each = [sum(math.log(model.prob(g, 0) / model.prob(g, 1)) for g in toxicity.grams_of(w, 3)) for w in words]
    got = scorer.text(" ".join(words))
    assert np.allclose(got, (sum(each) / 4, max(sum(each[i : i + 2]) for i in range(3)) / 2, 4))
    assert np.allclose(scorer.text("dd"), (each[2], each[2] / 2, 1)) and scorer.text(None) == (0, 0, 0)


def test_toxicity_scores_each_row_as_the_model_says(spark, docs, rows):
    """Repeated rows, a very long text, ids labelled both ways, null labels; scores against the curve by hand."""
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(1, 1), (1, 0), (2, None), (None, 1), (5, 1), (5, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.ToxicityParams(calibrate=0.5))
    scorer = toxicity.Scorer(model.grams, model.backoff, model.params)
    want = [(i, 1 / (1 + math.exp(-float(np.dot(toxicity._features(*scorer.text(t)), model.curve))))) for i, t, *_ in rows]
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    for a, b in zip(by_id(got), by_id(want)):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9)
    assert len({r["score"] for r in got if r["doc_id"] == 75}) == 1


def test_toxicity_held_out(spark, empty):
    r = random.Random(1)
    data, labels = [], []
    for i in range(600):
        words = [r.choice(WORDS) for _ in range(r.randrange(20, 60))]
        if i % 3 == 0:
            words[3] = words[9] = r.choice(["vilescum", "dirtclown", "trashface"])
        data.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(i % 3 == 0)))
    d, y = make_docs(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [(got[i], t) for i, t in labels if i % 4 == 2]
    assert all((s >= 0.3) == bool(t) for s, t in held)
    odd = toxicity.score(make_docs(spark, [(1, None, None, None), (1, "", None, None), (None, "12", None, None)]), model).collect()
    assert len(odd) == 3 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.fit(empty, y) is None and toxicity.fit(d, y.where("toxic = 0")) is None
    assert toxicity.score(d, None).where("score = 0").count() == 600 and toxicity.score(empty, model).count() == 0


# --- 2 language


def test_language_held_out(spark, docs, empty):
    r = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "cfxyz"}
    data = [(i, " ".join("".join(r.choice(alphabets[k]) for _ in range(5)) for _ in range(30)), k, "s") for i in range(450) for k in [list(alphabets)[i % 3]]]
    d = make_docs(spark, data)
    model = langid.fit(d.where("doc_id % 5 <> 1"))
    assert 0.25 <= model.temperature <= 8 and (model.weights == 0).mean() > 0.5
    got = {r["doc_id"]: r for r in langid.predict(d, model).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, _, k, _ in data if i % 5 == 1]) > 0.98
    for x in langid.predict(docs, model).collect():
        assert 0 <= x["score"] <= 1
        assert (x["lang_pred"] == "und") == (x["doc_id"] in (70, 71, 72, 74))
    assert langid.fit(empty) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert docs.withColumn("j", langid.judged(docs, model)).where("j.lang_pred = 'und'").count() == 4


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50])
def test_pieces_of_long_texts_change_no_count(monkeypatch, piece):
    r = random.Random(13)
    texts = ["".join(r.choice("abÄß İ1, \n") for _ in range(n)) for n in (1, 2, 3, 5, 20, 99, 100, 150)] + ["   ", "12 34", "a   ", "   a"]
    p = langid.LangParams(dims=1 << 10)

    def brute(t):
        x = re.sub(r"[^a-zäßi\u0307İ]+", " ", "".join(c.lower() if len(c.lower()) == 1 else c for c in t))
        return sum(max(0, len(x) - n + 1) for n in p.orders) if re.search(r"[^ ]", x) else None

    whole = [langid.term_counts(t, p) for t in texts]
    monkeypatch.setattr(langid, "_PIECE", piece)
    for t, want in zip(texts, whole):
        got = langid.term_counts(t, p)
        assert (None if got is None else got.sum()) == brute(t)
        assert (got is None) == (want is None) and (got is None or (got == want).all())


def test_language_scores_equal_dense_arithmetic(spark, docs, rows):
    """Predictions against the model's definition, on repeated, blank and very long texts; a tie goes to the first name."""
    p = langid.LangParams(dims=1 << 12)
    data = [(i, t, k, "s") for i, (t, k) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("ein und aus", "und")] * 25)]
    model = langid.fit(make_docs(spark, data), p)
    assert model.langs == ["de", "en", "fr", "und"]
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.predict(docs, model).collect()}
    for i, t, *_ in rows:
        tf = langid.term_counts(t, p)
        if tf is None:
            assert (i, "und", 0.0) in got
            continue
        v = np.where(tf > 0, np.log(1 + tf) * model.idf, 0)
        z = (v / np.sqrt((v * v).sum()) @ model.weights + model.bias) / model.temperature
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert (i, model.langs[int(q.argmax())], round(float(q.max()), 9)) in got
    flat = langid.LangModel(["b", "c"], np.ones(p.dims), np.zeros((p.dims, 2)), np.zeros(2), 1.0, p)
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs.where("doc_id = 60"), flat).collect()} == {("b", 0.5)}


def test_language_sample_is_thinned_to_its_bytes(spark):
    data = [(i, f"{'ab' if i % 2 else 'cd'} {i}", "x" if i % 2 else "y", "s") for i in range(400)]
    model = langid.fit(make_docs(spark, data), langid.LangParams(sample_bytes=2000))
    assert model.langs == ["x", "y"]


def test_every_language_is_learnt(spark):
    data = [(2 * i + k, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} text", f"l{i:03}", "s") for i in range(410) for k in (0, 1)]
    assert len(langid.fit(make_docs(spark, data)).langs) == 410


# --- 3 substring


def brute_kept(rows):
    first, out = {}, []
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    for i, t, *_ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=repr)


def test_substring(docs, rows, empty):
    assert by_id(substring.remove_repeats(docs).collect()) == by_id(brute_kept(rows))
    assert substring.remove_repeats(empty).count() == 0
    texts = substring.remove_repeats(docs, digest=False).where("doc_id = 41").first()
    assert texts["n_removed"] == texts["n_words"] and texts["text"] == ""


def test_substring_in_small_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 50)
    assert by_id(substring.remove_repeats(docs).collect()) == by_id(brute_kept(rows))


def test_substring_full_sketch_loses_nothing(docs, rows, monkeypatch):
    """A sketch of 64 cells estimates every window as repeated; the second pass still tells them apart."""
    monkeypatch.setattr(substring, "BLOCK", 4)
    monkeypatch.setattr(substring, "sketch_bits", lambda _: 6)
    assert all(np.unpackbits(b).all() for b in substring.sketch(docs.select("text"), 6).values())
    assert by_id(substring.remove_repeats(docs).collect()) == by_id(brute_kept(rows))


def test_sketch_never_underestimates(spark):
    """Every key that two documents hold is marked, at any size of the sketch."""
    r = random.Random(31)
    shared = [f"s{r.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join([f"w{r.randrange(10**6)}" for _ in range(40)] + shared * (i % 2) + [f"v{r.randrange(10**6)}" for _ in range(40)]) for i in range(12)]
    win, holders = substring.Windows(), {}
    for i, t in enumerate(texts):
        for k in win.keys(win.words(t.encode().split())).tolist():
            holders.setdefault(k, set()).add(i)
    repeated = np.array([k for k, x in holders.items() if len(x) > 1], np.uint64)
    assert len(repeated)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for bits in (20, 21):
        for row, bitmap in substring.sketch(df, bits).items():
            assert np.unpackbits(bitmap, bitorder="little")[substring._cells(repeated, row, bits).astype(np.int64)].all()


def test_substring_rows_of_one_id_keep_their_own_words(spark):
    r = random.Random(17)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = [(1, words[:80]), (2, words[100:180]), (2, words[:60] + words[200:300]), (2, words[:60] + words[200:300]), (2, words[:55]), (3, words[100:170]), (None, words[:80])]
    table = [(i, " ".join(w), "en", "s") for i, w in texts]
    assert by_id(substring.remove_repeats(make_docs(spark, table)).collect()) == by_id(brute_kept(table))


def test_word_digests_are_independent_and_bounded():
    words = [b"a", b"b" * 100, b"a", b"c"]
    w = substring.Windows(keep=2)
    for _ in range(3):
        d = w.words(words)
        assert [int(h) << 64 | int(x) for h, x in zip(d.high, d.low)] == [xxhash.xxh3_128_intdigest(x) for x in words]
        assert b"b" * 100 not in w.known and len(w.known) <= 4


def test_window_keys_are_the_least_span_hash():
    w = substring.Windows()
    h = w.words([b"%d" % (i % 37) for i in range(130)])
    spans = substring._mix(w._roll(h.low, w.p1, w.i1, substring.SPAN))
    assert (w.keys(h) == [spans[i : i + 35].min() for i in range(81)]).all()


# --- 4 tokens


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(reference):
    path, enc = reference
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    r = random.Random(3)
    pieces = [" ", "  ", "\n", "\t", "a", "the", "'s", "'ll", "1", "½", "é", "日本", "▁", "\x00", "👩‍👩‍👧", "<|endoftext|>", ".", "x" * 40, " ", " ", "\x1c"]
    for text in ["", *("".join(r.choice(pieces) for _ in range(r.randrange(1, 40))) for _ in range(3000))]:
        ids = codec.encode(text)
        assert ids.tolist() == enc.encode_ordinary(text), repr(text)
        assert codec.decode_bytes(ids) == text.encode()


def test_bpe_decodes_through_the_pieces(reference):
    path, _ = reference
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    assert codec.bytes == bpe.read_ranks(path) and len(bpe._BYTE) == 256
    assert all(bytes(bpe._BYTE[c] for c in codec.sp.id_to_piece(i)) == b for i, b in enumerate(codec.bytes))
    long = "x" * 5000 + " " + "y9" * 300 + "\n" + "é" * 100
    for _ in range(2):
        assert codec.decode_bytes(codec.encode(long)).decode() == long
        assert max(map(len, [*codec.parts, *codec.chunks])) <= bpe.LONGEST


def test_bpe_frames(docs, rows, reference, empty):
    path, enc = reference
    got = bpe.digests(docs, path, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_id(got) == by_id(want)
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("source", "text"))
    assert coded.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0 and coded.count() == len(rows)
    assert bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0


# --- 5 SimHash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_simhash(docs, rows, empty):
    prints = [brute_print(t) for _, t, *_ in rows]
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    near = [sum(i in x for x in links) for i in range(n)]
    root = brute_components(n, links)
    low = {}
    for i, c in enumerate(root):
        if rows[i][0] is not None:
            low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    want = [(rows[i][0], f"{prints[i]:016x}", near[i], low.get(root[i])) for i in range(n)]
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "n_near", "component_id").collect()
    assert by_id(got) == by_id(want)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert {tuple(r)[5:] for r in kept.collect()} == {OWN}


def test_one_of_each_keeps_a_row_of_every_component(spark):
    r = random.Random(15)
    texts = [" ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(40)) for _ in range(9)]
    # Components of null ids only, two with the same smallest id, one with a null and another id, and copies.
    table = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[4]), (5, texts[4]), (None, texts[5]), (7, texts[5]), (8, texts[6]), (9, texts[6]), (None, None), (-(1 << 63), texts[7]), (None, texts[7])]
    docs = make_docs(spark, [(i, t, "en", "s") for i, t in table])
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()), key=repr)
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[5]), (8, texts[6]), (None, None), (-(1 << 63), texts[7])]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("crowd", [1024, 1, 3])
def test_simhash_finds_every_pair_at_distance_two(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(6)
    seeds = [r.getrandbits(64) for _ in range(40)]
    prints = sorted({s ^ sum(1 << b for b in r.sample(range(64), k)) for s in seeds for k in (0, 1, 1, 2, 3)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {frozenset((x["a"], x["b"])) for x in simhash.linked_pairs(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {frozenset((signed[i], signed[j])) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("crowd", [1024, 1])
def test_simhash_broadcasts_no_variants(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(16)
    seeds = [r.getrandbits(63) for _ in range(300)]
    prints = sorted({s ^ (1 << b) for s in seeds for b in r.sample(range(63), 2)} | set(seeds))
    # Read from a file, whose size Spark knows and takes for that of the variants.
    pairs = simhash.linked_pairs(materialise(spark.createDataFrame([(p,) for p in prints], "fp long")))
    want = {(a, b) for i, b in enumerate(prints) for a in prints[:i] if (a ^ b).bit_count() <= 2}
    assert {tuple(x) for x in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(30)] + [(7, 7), (5, 4)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    root = brute_components(160, edges)
    assert got == {n: min(m for m in nodes if root[m] == root[n]) for n in nodes}


# --- 6 fingerprints


def test_sketches_merge_and_estimate():
    s = fingerprint.Sketcher()
    a, b = " ".join(map(str, range(3000))), " ".join(map(str, range(1500, 4500)))
    x, y = s.sketch(a), s.sketch(b)
    assert len(x) == fingerprint.K and (fingerprint.decode(fingerprint.encode(x)) == x).all()
    assert abs(fingerprint.resemblance(x, y) - 1 / 3) < 0.15 and abs(fingerprint.containment(x, y) - 0.5) < 0.2
    assert abs(fingerprint.distinct(x) / 2998 - 1) < 0.3
    whole = s.sketch(" ".join(map(str, range(4500))))
    assert (fingerprint.merge(x, y) == whole).all()
    none = s.sketch(None)
    assert fingerprint.resemblance(none, none) == 1 and fingerprint.resemblance(none, x) == 0 and fingerprint.encode(none) == ""
    assert len(s.sketch("same " * 50000)) == 1


def shingles(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_likeness(a, b):
    """Resemblance of two texts by the bottom-k rule over hashes taken one shingle at a time."""
    def hashes(text):
        w = (text or "").split()
        out = set()
        for i in range(max(1, len(w) - 2) if w else 0):
            h = 0x51ED270B
            for x in w[i : i + 3]:
                h = (h ^ xxhash.xxh64_intdigest(x.encode())) * 0x9E3779B97F4A7C15 % (1 << 64)
                h ^= h >> 31
            out.add((h * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 16)
        return sorted(out)[: fingerprint.K]

    x, y = hashes(a), hashes(b)
    u = sorted({*x, *y})[: fingerprint.K]
    return sum(h in x and h in y for h in u) / len(u) if u else 1.0


def test_neighbours_are_as_like_as_their_shingles(docs, rows):
    """near_next and near_edited against the bottom-k rule, and against true resemblance within sampling error."""
    order = sorted((r for r in rows if r[0] is not None and r[0] != 75), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprint.neighbours(docs.where("doc_id IS NOT NULL AND doc_id <> 75"), parts=3).collect()}
    for k, (i, t, *_) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        assert math.isclose(got[i]["near_next"], brute_likeness(t, following)) and math.isclose(got[i]["near_edited"], brute_likeness(t, edited))
        for field, other in (("near_next", following), ("near_edited", edited)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got[i][field] - true) < 0.2


def test_neighbours_of_hot_and_huge_ids(spark):
    """An id and the null id that many rows share are cut by the hash of the text; ids differ beyond 2^53."""
    big = (1 << 62) + 5
    ids = [None] * 40 + [7] * 60 + [big, big - 1, big - 2, -big, -(1 << 63), (1 << 63) - 1, 8, 6]
    r = random.Random(23)
    table = [(i, " ".join(r.choice(WORDS) for _ in range(12)), "en", "s") for i in ids]
    d = make_docs(spark, table).repartition(3)
    hashes = {r["text"]: r["h"] for r in d.select("text", F.shiftrightunsigned(F.xxhash64("text"), 33).alias("h")).collect()}
    order = sorted(table, key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]], x[1]))
    want = []
    for k, (i, t, *_) in enumerate(order):
        following, m = order[(k + 1) % len(order)][1], len(t) // 3
        want.append((i, hashlib.sha256((t[: len(t) - m] + following[:m]).encode()).hexdigest()))
    for parts in (1, 8, 20):
        got = fingerprint.neighbours(d, parts=parts).select("doc_id", "edited_sha256")
        assert by_id(got.collect()) == by_id(want)
    ranges = fingerprint.Ranges(d.select("doc_id"), 20)
    at = ranges.of(np.array([7] * 60), np.zeros(60, bool), np.linspace(0, (1 << 31) - 1, 60).astype(np.int64))
    assert len(set(at.tolist())) > 5 and ranges.of_nulls > 3


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_neighbours(docs, rows, empty, parts):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t, *_ in order]
    want = []
    for k, (i, *_) in enumerate(order):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        m = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - m] + following[:m]).encode()).hexdigest()))
    got = fingerprint.neighbours(docs, parts=parts).collect()
    assert by_id((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == by_id(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] and 40 <= r["doc_id"] < 52}) == 1
    assert fingerprint.neighbours(empty).count() == 0 and fingerprint.sketches(docs).count() == len(rows)


# --- 7 personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    def digits(m):
        return re.sub(r"[^0-9]", "", m[0])

    def luhn(d):
        return sum(n - 9 if n > 9 else n for i, c in enumerate(reversed(d)) for n in [int(c) * (1 + i % 2)]) % 10 == 0

    ok = [lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15]
    return sorted(((k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t) if ok[k](m)), key=lambda s: (s[1], s[0]))


def test_base_spans():
    r = random.Random(9)
    parts = ["a", "@", ".", "1", "255", "0255", "-", " ", "+", "(", "b.c", "@x.y", "4111 1111 1111 1111", "1.2.3.4", "é", "_", "٣"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert pii.base_spans(t) == brute_spans(t), repr(t)
    assert pii.base_spans(None) == [] and pii.base_spans("9" * 50000) == [] and pii.base_spans("a" * 50000 + "@") == []


def test_bootstrap_finds_what_shares_a_context(spark, docs, rows, empty):
    seeds = [(i, f"write to account no. user{i}@mail.example.com today", "en", "s") for i in range(8)]
    new = [(100, "write to account no. KX-99-1234, then", "en", "s"), (101, "version 3.14159 of nothing", "en", "s")]
    d = make_docs(spark, seeds + new)
    got = {r["doc_id"]: r for r in pii.find(d).collect()}
    assert got[100]["spans"] == "identifier:21:31" and got[100]["n_identifier"] == 1 and got[101]["spans"] == ""
    assert got[3]["n_email"] == 1 and got[3]["spans"] == "email:21:43" and got[3]["base_sha256"] == hashlib.sha256(b"email:21:43").hexdigest()
    clean = {r["text"] for r in pii.redact(d).where("doc_id IN (3, 100)").collect()}
    assert clean == {"write to account no. [EMAIL] today", "write to account no. [IDENTIFIER], then"}
    all_rows = pii.find(docs)
    assert all_rows.count() == len(rows) and pii.find(empty).count() == 0
    back = pii.redact(docs)
    assert back.columns == docs.columns and back.count() == len(rows) and back.where("text IS NULL").count() == 1
    assert {tuple(r)[5:] for r in back.collect()} == {OWN}


def test_bootstrap_goes_on_until_nothing_is_added(spark):
    # Each context shares its instances with the next one, ten contexts away from the seeds.
    edges = [(f"p{k}", f"i{k}-{j}", k == 0) for k in range(10) for j in range(9)]
    edges += [(f"p{k}", f"i{k + 1}-{j}", False) for k in range(9) for j in range(4)] + [(f"q{k}", f"i{k}-{j}", k == 0) for k in range(10) for j in range(9)]
    edges += [("other", f"x{j}", False) for j in range(9)]
    got = pii._bootstrap(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"), pii.PiiParams(pattern_conf=0.2, instance_conf=0.25))
    assert {r["pattern"] for r in got.collect()} == {f"{x}{k}" for x in "pq" for k in range(10)}


def brute_bootstrap(edges, p):
    """Confident patterns by the definition, over plain sets."""
    pairs = {(a, b) for a, b, _ in edges}
    known = {b for _, b, seed in edges if seed}
    while True:
        conf = {}
        for pattern in {a for a, _ in pairs}:
            mine = [b for a, b in pairs if a == pattern]
            hits = sum(b in known for b in mine)
            c = hits / len(mine) * (1 - 2 ** -math.log2(hits + 1))
            if hits >= p.min_seeds and c >= p.pattern_conf:
                conf[pattern] = c
        grown = set(known)
        for b in {b for _, b in pairs}:
            miss = math.prod(1 - 0.999 * conf[a] for a, x in pairs if x == b and a in conf)
            if 1 - miss >= p.instance_conf:
                grown.add(b)
        if grown == known:
            return conf
        known = grown


@pytest.mark.parametrize("small", [500_000, 0])
def test_bootstrap_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(pii, "SMALL", small)
    r = random.Random(19)
    edges = [(f"p{r.randrange(25)}", f"i{(k := r.randrange(90))}", k < 25) for _ in range(700)]
    for conf in (0.15, 0.3):
        p = pii.PiiParams(min_seeds=2, pattern_conf=conf, instance_conf=0.4)
        got = {x["pattern"]: x["conf"] for x in pii._bootstrap(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"), p).collect()}
        want = brute_bootstrap(edges, p)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_long_identifiers_and_distant_contexts_are_found(spark):
    """Identifiers and white space of any length, on both sides of the former bounds."""
    seeds = [(i, f"write to account no. user{i}@mail.example.com today", "en", "s") for i in range(40)]
    cases = {n: "K9" * (n // 2) + "7" * (n % 2) for n in (127, 128, 129, 5000)}
    new = [(100 + k, f"write to account no. {x} then", "en", "s") for k, x in enumerate(cases.values())]
    new += [(200 + k, f"write to account{' ' * n}no.{' ' * n}KX-99-12{k}", "en", "s") for k, n in enumerate((20, 70, 3000))]
    got = {r["doc_id"]: r["spans"] for r in pii.find(make_docs(spark, seeds + new)).collect()}
    for k, n in enumerate(cases):
        assert got[100 + k] == f"identifier:21:{21 + n}"
    for k, n in enumerate((20, 70, 3000)):
        assert got[200 + k] == f"identifier:{19 + 2 * n}:{28 + 2 * n}"


def test_patterns_of_words_of_any_length():
    assert pii.patterns_of("see ref no: X1", 12) == ["no: ", "ref no: "]
    assert pii.patterns_of("a id=X1", 5) == ["id=", "a id="] and pii.patterns_of("X1", 0) == [] and pii.patterns_of("  X1", 2) == []
    assert pii.patterns_of("w 12ab X1", 7) == ["w 0ab "]
    assert pii.patterns_of("no " + "z" * 100 + " X1", 104, 64) == ["z" * 64 + " "]
    assert pii.patterns_of("y" * 100 + " no X1", 104, 64) == ["y" * 64 + " no "]


# --- 8 sharding


def test_karmarkar_karp():
    r = random.Random(5)
    sizes = [r.randrange(1, 1000) for _ in range(500)]
    parts = sharding.karmarkar_karp(sizes, 7)
    sums = [sum(s for s, p in zip(sizes, parts) if p == k) for k in range(7)]
    assert max(sums) - min(sums) <= 2
    assert sharding.karmarkar_karp([], 3) == [] and sorted(sharding.karmarkar_karp([5, 4, 3], 3)) == [0, 1, 2]
    assert sharding.combine([]) == []


def test_sharding_joins_many_buckets_in_levels(spark, monkeypatch):
    """Thousands of buckets, joined a few at a time; sums stay as near as in one go."""
    monkeypatch.setattr(sharding, "PER_BUCKET", 60)
    monkeypatch.setattr(sharding, "PER_JOIN", 4)
    r = random.Random(29)
    sizes = [r.randrange(150, 250) for _ in range(3000)]
    got = sharding.shard(make_docs(spark, [(i, f"{i}" + "x" * n, "en", "s") for i, n in enumerate(sizes)]), shards=3).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(3000))
    sums = [sum(x["size"] for x in got if x["shard"] == k) for k in range(3)]
    assert max(sums) - min(sums) <= 40


@pytest.mark.parametrize("per_bucket", [100_000, 9])
def test_sharding(docs, rows, empty, monkeypatch, per_bucket):
    monkeypatch.setattr(sharding, "PER_BUCKET", per_bucket)
    monkeypatch.setattr(sharding, "PER_CHUNK", 5)
    got = sharding.shard(docs.where("doc_id <> 73 OR doc_id IS NULL"), shards=4).collect()
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows if i != 73]
    assert by_id((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == by_id(want)
    sums = [sum(r["size"] for r in got if r["shard"] == k) for k in range(4)]
    assert max(sums) - min(sums) < 0.2 * sum(sums) / 4
    for k in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    homes = {}
    for r in got:
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    quarter = sum(sums) / 16
    weight = {k: k[0] * sum((r["size"], r["text_crc32"]) == k for r in got) for k in homes}
    assert all(len(s) == 1 for k, s in homes.items() if weight[k] <= quarter)
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("per_bucket", [100_000, 150])
def test_sharding_keeps_groups_up_to_a_fair_share_whole(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(sharding, "PER_BUCKET", per_bucket)
    r = random.Random(12)
    small = ["".join(r.choice("abcdef") for _ in range(r.randrange(20, 200))) for _ in range(1500)]
    total = 4 * sum(len(t) + 8 for t in small) // 3
    # Shares of one of 8 shards: by copies, and by one long text repeated twice.
    made = [(0.3, 40), (0.5, 50), (0.75, 2), (0.95, 60)]
    copies = [(chr(65 + k) * (int(part * total / 8 / n) - 8), n) for k, (part, n) in enumerate(made)]
    texts = small + [t for t, n in copies for _ in range(n)]
    got = sharding.shard(make_docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3), shards=8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    at = {r["doc_id"]: r["shard"] for r in got}
    sums = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert all((len(t) + 8) * n * 4 > sum(sums) / 8 > (len(t) + 8) * n for t, n in copies)
    assert all(len({at[i] for i, x in enumerate(texts) if x == t}) == 1 for t, _ in copies)
    assert max(sums) - min(sums) < 0.01 * sum(sums) / 8


def test_sharding_divides_what_exceeds_a_fair_share(spark):
    texts = ["A" * 192] * 50 + ["b" * k for k in range(100, 140)]
    got = sharding.shard(make_docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), shards=8).collect()
    sums = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert len({r["shard"] for r in got if r["size"] == 200}) > 1 and max(sums) < 1.3 * sum(sums) / 8


# --- 9 mixing


def water_fill(budget, nodes):
    """(name -> alloc) by filling the node that fills first."""
    out, left, share = {}, budget, sum(w for _, w, _ in nodes if w)
    live = sorted((c / w, n, w, c) for n, w, c in nodes if w)
    for k, (_, n, w, c) in enumerate(live):
        if c * share <= left * w:
            out[n], left, share = c, left - c, share - w
        else:
            return out | {m: max(left, 0) * v // share for _, m, v, _ in live[k:]}
    return out


def test_mixing(docs, rows, empty):
    p = mixing.MixParams(domains={"a": 3}, langs={"en": 2, "fr": 0}, sources={"src1": 4}, budget_permille=700, max_epochs=2)
    domain = F.when(F.col("source") == "src0", "a").when(F.col("source").isNotNull(), "b")
    got = mixing.mix(docs, domain, p).collect()
    leaf = [(("a" if s == "src0" else "b" if s else "none"), lang or "und", s or "none") for _, _, lang, s in rows]
    n = [len(words_of(t)) for _, t, *_ in rows]
    supply = {}
    for x, c in zip(leaf, n):
        supply[x] = supply.get(x, 0) + c

    def cap(prefix):
        return sum(2 * v for k, v in supply.items() if k[: len(prefix)] == prefix)

    top = water_fill(sum(n) * 700 // 1000, [(d, p.domains.get(d, 1), cap((d,))) for d in sorted({x[0] for x in supply})])
    alloc = {}
    for d, b in top.items():
        for g, c in water_fill(b, [(g, p.langs.get(g, 1), cap((d, g))) for g in sorted({x[1] for x in supply if x[0] == d})]).items():
            for s, a in water_fill(c, [(s, p.sources.get(s, 1), cap((d, g, s))) for s in sorted({x[2] for x in supply if x[:2] == (d, g)})]).items():
                alloc[d, g, s] = a
    want = []
    for x, total in supply.items():
        full, rest = divmod(alloc.get(x, 0), total) if total else (0, 0)
        mine = [(hashlib.md5(f"{p.seed}:{full}:{'null' if i is None else i}".encode()).hexdigest(), i, c) for (i, *_), y, c in zip(rows, leaf, n) if y == x]
        for key, i, c in mine:
            upto = sum(z for k, _, z in mine if k <= key)
            want.append((i, *x, c, full + (upto <= rest) if c else 0))
    assert by_id(got) == by_id(want)
    picked = mixing.select(docs, domain, p)
    assert picked.columns == docs.columns and picked.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty, domain, p).count() == 0 and mixing.select(empty, domain, p).count() == 0


# --- 10 embeddings


@pytest.mark.parametrize(("block", "product", "visits"), [(4096, 1 << 20, 4), (12, 1, 4), (12, 30, 0.3), (40, 1, 4)])
def test_embeddings(spark, monkeypatch, block, product, visits):
    # Small blocks make cells with visitors, small products make the traversal descend, few visits make copies of blocks.
    monkeypatch.setattr(embed, "BLOCK", block)
    monkeypatch.setattr(embed, "PRODUCT", product)
    monkeypatch.setattr(embed, "VISITS", visits)
    r = np.random.default_rng(7)
    data = []
    for k in range(12):
        centre = r.normal(size=8)
        for j in range(8):
            v = centre + r.normal(size=8) * 0.22
            data.append((len(data), v.astype(np.float32).tolist(), k % 2))
    data += [(200 + i, data[0][1], 0) for i in range(20)] + [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] + [1.0] * 7, 0), (303, [None] + [1.0] * 7, 0), (304, data[0][1], None), (305, data[0][1][:5], 0), (306, [], 1), (307, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("part", F.lit("z"))
    ok = {i: np.array(v, float) for i, v, g in data if g is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    label = {i: g for i, _, g in data}
    ids = [i for i, *_ in data]
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if a in ok and b in ok and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.sqrt(ok[a] @ ok[a]) * np.sqrt(ok[b] @ ok[b])) >= 0.93]
    at = {v: k for k, v in enumerate(ids)}
    root = brute_components(len(ids), [(at[a], at[b]) for a, b in links])
    want = []
    for i in ids:
        c = min(j for j in ids if root[at[j]] == root[at[i]])
        want.append((i, sum(i in x for x in links), c, c == i))
    assert len(links) > 100 and near_duplicate_trees(data, ok, label, links)
    assert by_id(embed.near_duplicates(df).collect()) == by_id(want)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def near_duplicate_trees(data, ok, label, links):
    """The traversal alone, within one tree and between two, finds the links of a label."""
    ids = [i for i in ok if label[i] == 0 and len(ok[i]) == 8]
    index = {v: k for k, v in enumerate(ids)}
    want = np.zeros(len(ids), int)
    for a, b in links:
        if a in index and b in index:
            want[index[a]] += 1
            want[index[b]] += 1
    tree, half = embed.CoverTree(np.array([ok[i] for i in ids])), len(ids) // 2
    one = np.ones(len(ids), np.int64)
    whole = embed.Traversal(tree, tree, one, one).links_a
    parts = [embed.CoverTree(np.array([ok[i] for i in x])) for x in (ids[:half], ids[half:])]
    inner = np.concatenate([embed.Traversal(t, t, one[: len(t.unit)], one[: len(t.unit)]).links_a for t in parts])
    cross = embed.Traversal(*parts, one[:half], one[half:])
    return (whole == want).all() and (inner + np.concatenate([cross.links_a, cross.links_b]) == want).all()


def test_embeddings_with_null_ids_and_any_magnitude(spark):
    data = [(None, [1.0, 0.0], 0), (4, [1.0, 0.01], 0), (None, [0.0, 1.0], 0), (None, [0.01, 1.0], 0), (7, [3e200, 1e200], 1), (8, [3e-200, 1e-200], 1), (9, [-3.0, 1.0], 1), (None, None, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    want = [(None, 1, 4, False), (4, 1, 4, True), (None, 1, None, True), (None, 1, None, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True), (None, 0, None, True)]
    assert by_id(embed.near_duplicates(df).collect()) == by_id(want)


def test_embeddings_of_one_id_are_vectors_of_their_own(spark):
    # Id 1 is on vectors of two labels and on two of one label; 5 and 6 are near one each.
    data = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (1, [0.0, 0.0, 1.0], 1), (5, [1.0, 0.01, 0.0], 0), (6, [0.0, 1.0, 0.01], 0), (7, [0.0, 0.01, 1.0], 1), (0, [0.0, 1.0, 0.02], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    want = [(1, 1, 1, True), (1, 2, 0, False), (1, 1, 1, True), (5, 1, 1, False), (6, 2, 0, False), (7, 1, 1, False), (0, 2, 0, True)]
    assert by_id(embed.near_duplicates(df).collect()) == by_id(want)
