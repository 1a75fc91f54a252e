"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate step sizes, elastic
net), then calibrated by one temperature on texts kept out of the training.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_columns, materialise, uniform

UNKNOWN = "und"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_VECTOR = T.StructType([T.StructField("lang", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("pick", T.DoubleType())])


@dataclass(frozen=True)
class LangParams:
    """`per_lang`: expected number of training texts of each language (the bound of the sample).

    `sample_bytes`: most bytes of feature vectors that the driver trains on; a larger
    sample is thinned evenly. `dims`: hashed features. `orders`: n-gram lengths.
    `alpha`, `beta`: step sizes; `l1`, `l2`: elastic net; `seed`: sample and order.
    """

    per_lang: int = 300
    sample_bytes: int = 256 << 20
    dims: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    epochs: int = 6
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    calibrate: float = 0.2
    seed: int = 11


@dataclass
class LangModel:
    """Languages, inverse document frequencies, weights (dims x languages) and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    params: LangParams


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter; 32 for anything that is no letter. Single-character folds only."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


#: Characters counted at once; what precedes a piece is carried into it.
_PIECE = 1 << 22


def _letters(text: str, before: np.ndarray) -> np.ndarray:
    """Lower-case code points after those in `before`, each run of anything but letters as one space."""
    cps = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    cps = np.concatenate([before, cps])
    keep = np.ones(len(cps), bool)
    keep[1:] = (cps[1:] != 32) | (cps[:-1] != 32)
    return cps[keep]


def term_counts(text: str | None, p: LangParams) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None when it is null or has no letter.

    Runs of anything but letters count as one space. Long texts are counted in
    pieces, each after the last letters of the one before, so no n-gram is lost
    or counted twice where they meet.
    """
    if not text:
        return None
    total, any_letter = np.zeros(p.dims), False
    shift = np.uint64(64 - int(math.log2(p.dims)))
    longest = max(p.orders)
    tail = np.zeros(0, np.uint32)
    for i in range(0, len(text), _PIECE):
        seen = len(tail)
        whole = _letters(text[i : i + _PIECE], tail)
        x = whole.astype(np.uint64)
        any_letter = any_letter or bool((whole != 32).any())
        for n in p.orders:
            # n-grams that end in this piece.
            y = x[max(0, seen - n + 1) :]
            if len(y) < n:
                continue
            h = np.full(len(y) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ y[k : len(y) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            total += np.bincount(((h * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64), minlength=p.dims)
        tail = whole[max(0, len(whole) - max(1, longest - 1)) :]
    return total if any_letter else None


def _vectors(docs: DataFrame, p: LangParams, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    def make():
        def run(langs, texts, picks):
            out = ([], [], [], [])
            for lang, text, pick in zip(langs, texts, picks, strict=True):
                tf = term_counts(text, p)
                if tf is not None:
                    at = np.flatnonzero(tf)
                    for o, v in zip(out, (lang, at.astype("<i4").tobytes(), np.log1p(tf[at]).astype("<f4").tobytes(), pick), strict=True):
                        o.append(v)
            return out

        return run

    return map_columns(docs, [docs[lang_col].cast("string"), docs[text_col], uniform(id_col, text_col, seed=p.seed + 2).alias("pick")], make, _VECTOR)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_langs: int, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; the last feature of the state is the bias, which isn't penalised."""
    z, n = np.zeros((p.dims + 1, n_langs)), np.zeros((p.dims + 1, n_langs))

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        l1 = np.where(at == p.dims, 0.0, p.l1)[:, None]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((p.beta + np.sqrt(nn)) / p.alpha + p.l2))

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            y, at, x = rows[i]
            w = weights(at)
            err = _softmax(x @ w)
            err[y] -= 1
            g = x[:, None] * err[None, :]
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / p.alpha * w
            n[at] = nn + g * g
    all_w = weights(np.arange(p.dims + 1))
    return all_w[:-1], all_w[-1]


def fit(docs: DataFrame, p: LangParams = LangParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel | None:
    """Fit on an expected `per_lang` texts of each language.

    Rows are picked by a hash of their id, so the sample doesn't depend on order
    or partitioning; repeated ids are picked together. Null languages and texts
    without letters teach nothing; a language named `und` is learnt like any other.
    Returns None when nothing is left to learn from.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = known.groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, p.per_lang / r["count"]))])
    picked = known.where(uniform(id_col, seed=p.seed) < F.coalesce(share[F.col(lang_col).cast("string")], F.lit(0.0)))
    vectors = materialise(_vectors(picked, p, id_col, text_col, lang_col))
    size = vectors.agg(F.coalesce(F.sum(F.octet_length("at") + F.octet_length("value")), F.lit(0))).first()[0]
    if size > p.sample_bytes:
        vectors = vectors.where(F.col("pick") < p.sample_bytes / size)
    place = {lang: k for k, lang in enumerate(langs)}
    rows = [(place[r["lang"]], np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in vectors.toLocalIterator()]
    discard(vectors)
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    df = np.zeros(p.dims)
    for _, at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    data = []
    for y, at, x in rows:
        v = x * idf[at]
        data.append((y, np.append(at, p.dims), np.append(v / np.linalg.norm(v), 1.0)))
    test = np.random.default_rng(p.seed + 1).random(len(data)) < p.calibrate
    w, b = _ftrl([r for r, t in zip(data, test, strict=True) if not t], len(langs), p)
    held = [r for r, t in zip(data, test, strict=True) if t]
    temperature = 1.0
    if held:
        z = np.array([x[:-1] @ w[at[:-1]] + b for _, at, x in held])
        y = np.array([r[0] for r in held])
        grid = np.exp(np.linspace(math.log(0.25), math.log(8), 91))
        nll = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-300)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(nll))])
    return LangModel(langs, idf, w, b, temperature, p)


def _decide(m: LangModel | None, texts) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for text in texts:
        tf = term_counts(text, m.params) if m else None
        if tf is None:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        at = np.flatnonzero(tf)
        v = np.log1p(tf[at]) * m.idf[at]
        q = _softmax(((v / np.linalg.norm(v)) @ m.weights[at] + m.bias) / m.temperature)
        k = int(np.argmax(q))
        langs.append(m.langs[k])
        scores.append(float(q[k]))
    return langs, scores


def predict(docs: DataFrame, model: LangModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row, from the text alone.

    Null texts and texts without a letter get `und` and score 0; so does every
    row if the model is None. Of languages equally likely the first by name wins.
    Ids may repeat or be null; each row is kept. The model (dims x languages
    doubles) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda ids, texts: (ids, *_decide(shared.value, texts))

    return map_columns(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col]], make, SCHEMA)


def judged(docs: DataFrame, model: LangModel | None, text_col: str = "text") -> Column:
    """A column of structs (lang_pred, score), as `predict` gives them, beside the rows' own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType(SCHEMA.fields[1:]))
    def judge(texts: pd.Series) -> pd.DataFrame:
        langs, scores = _decide(shared.value, [None if pd.isna(t) else t for t in texts])
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    return judge(docs[text_col])
