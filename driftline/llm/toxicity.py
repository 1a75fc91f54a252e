"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class has its own counts of the longest n-grams (a letter after the letters
before it, words padded at both ends). Below that both classes share one
Kneser-Ney back-off built from continuation counts, so an expression that is
rare in both costs both the same, and only what one class has truly seen more
often moves the score. The log-likelihoods under the two classes are compared per
word: over the whole text, and over its most toxic passage of a few words, since a
long text may be toxic in one place only. A logistic curve fitted on labelled texts
outside the counts makes the differences a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, materialise, uniform

_WORDS = re.compile(r"[^\W\d_]+").findall
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
_GRAMS = T.StructType([T.StructField("gram", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("plain", T.LongType())])
_RATIOS = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("ratio", T.DoubleType()), T.StructField("passage", T.DoubleType()), T.StructField("words", T.LongType())])
_PAD, _END = "\x02", "\x03"


@dataclass(frozen=True)
class ToxicityParams:
    """`per_class`: expected number of labelled texts used of each class (the bound of the sample).

    `order`: letters of the longest n-grams; `min_count`: rarer ones are left to
    the back-off; `passage`: words of a passage; `calibrate`: share of the sample
    that fits the curve.
    """

    per_class: int = 6000
    order: int = 4
    passage: int = 5
    min_count: int = 1
    discount: float = 0.75
    calibrate: float = 0.25
    seed: int = 5


@dataclass
class ToxicityModel:
    """Log ratios of seen n-grams, of the back-off after seen contexts, and the curve."""

    grams: dict[str, float]
    backoff: dict[str, float]
    curve: np.ndarray
    params: ToxicityParams


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; none for a null."""
    return _WORDS(text.lower()) if text else []


def grams_of(word: str, order: int) -> list[str]:
    padded = _PAD * (order - 1) + word + _END
    return [padded[i : i + order] for i in range(len(word) + 1)]


class KneserNey:
    """Two classes' n-gram models over one back-off. `counts`: n-gram -> (toxic, ordinary).

    A class discounts its own counts of the longest n-grams and gives what that
    frees to the shared lower orders, which are interpolated Kneser-Ney over the
    n-gram types of both classes and end in a uniform distribution over the
    letters seen. After a context each class's probabilities sum to 1.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], discount: float) -> None:
        self.counts, self.discount = counts, discount
        self.levels = []
        types = set(counts)
        while types and len(next(iter(types))) > 1:
            cont = Counter(g[1:] for g in types)
            total, kinds = Counter(), Counter()
            for g, c in cont.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels.append((cont, total, kinds))
            types = set(cont)
        self.letters = sorted(types)
        self._known: dict[str, float] = {}
        self.total = defaultdict(lambda: [0, 0])
        self.kinds = defaultdict(lambda: [0, 0])
        for g, c in counts.items():
            for k in (0, 1):
                self.total[g[:-1]][k] += c[k]
                self.kinds[g[:-1]][k] += c[k] > 0

    def shared(self, g: str, level: int = 0) -> float:
        """Probability of the last letter after the others under the back-off."""
        if level == len(self.levels):
            return 1 / max(1, len(self.letters))
        if (p := self._known.get(g)) is None:
            cont, total, kinds = self.levels[level]
            low = self.shared(g[1:], level + 1)
            t = total[g[:-1]]
            p = self._known[g] = (max(cont[g] - self.discount, 0) + self.discount * kinds[g[:-1]] * low) / t if t else low
        return p

    def weight(self, context: str, k: int) -> float:
        """What class k gives to the back-off after a context; all of it after one it never saw."""
        total = self.total[context][k] if context in self.total else 0
        return self.discount * self.kinds[context][k] / total if total else 1.0

    def prob(self, g: str, k: int) -> float:
        """Probability of the last letter after the others in class k (0 toxic, 1 ordinary)."""
        context = g[:-1]
        own = max(self.counts[g][k] - self.discount, 0) / self.total[context][k] if g in self.counts and self.total[context][k] else 0.0
        return own + self.weight(context, k) * self.shared(g[1:])


def log_ratios(counts: dict[str, tuple[int, int]], discount: float) -> tuple[dict[str, float], dict[str, float]]:
    """(log ratio of each n-gram, log ratio of the back-off weight of each context), toxic over ordinary.

    An unseen n-gram has the ratio of its context's weights, as the back-off is the same.
    """
    model = KneserNey(counts, discount)
    grams = {g: math.log(model.prob(g, 0) / model.prob(g, 1)) for g in counts}
    return grams, {ctx: math.log(model.weight(ctx, 0) / model.weight(ctx, 1)) for ctx in list(model.total)}


class Scorer:
    """Log-likelihood differences of words, remembered up to a bound of words and, as words may be of any length, of letters."""

    def __init__(self, grams: dict[str, float], backoff: dict[str, float], p: ToxicityParams, keep: int = 400_000, longest: int = 64) -> None:
        self.grams, self.backoff, self.p, self.keep, self.longest, self.known = grams, backoff, p, keep, longest, {}

    def word(self, w: str) -> float:
        """Log-likelihood of a word and its end, toxic less ordinary."""
        grams, backoff = self.grams, self.backoff
        total = 0.0
        for g in grams_of(w, self.p.order):
            r = grams.get(g)
            total += backoff.get(g[:-1], 0.0) if r is None else r
        return total

    def text(self, text: str | None) -> tuple[float, float, int]:
        """(difference per word, the same of the most toxic passage, words). A shorter text is one passage, divided by the length of a whole one."""
        words = words_of(text)
        if not words:
            return 0.0, 0.0, 0
        if len(self.known) > self.keep:
            self.known.clear()
        known, rare = self.known, {}
        for w in set(words):
            if w not in known:
                (known if len(w) <= self.longest else rare)[w] = self.word(w)
        n, k = len(words), self.p.passage
        of = known.__getitem__ if not rare else lambda w: rare[w] if w in rare else known[w]
        sums = np.cumsum(np.fromiter(map(of, words), float, n))
        most = sums[-1] if n <= k else max(sums[k - 1], (sums[k:] - sums[:-k]).max())
        return float(sums[-1]) / n, float(most) / k, n


def _count(sample: DataFrame, p: ToxicityParams) -> dict[str, tuple[int, int]]:
    def make():
        def run(labels, texts):
            words = (Counter(), Counter())
            for y, t in zip(labels, texts, strict=True):
                words[1 - y].update(words_of(t))
            out = (Counter(), Counter())
            for w, c in zip(words, out, strict=True):
                for word, n in w.items():
                    for g in grams_of(word, p.order):
                        c[g] += n
            grams = list(out[0].keys() | out[1].keys())
            return grams, [out[0][g] for g in grams], [out[1][g] for g in grams]

        return run

    rows = map_columns(sample, ["toxic", "text"], make, _GRAMS).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    return {r["gram"]: (r["toxic"], r["plain"]) for r in rows.where(F.col("toxic") + F.col("plain") >= p.min_count).toLocalIterator()}


def _features(ratio: float, passage: float, words: int) -> list[float]:
    """What the curve weighs; the noise of the whole text's difference falls with the root of its length."""
    return [ratio, ratio * math.sqrt(words), passage, 1.0]


def _curve(a: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression of y on the columns of a by Newton steps, lightly penalised."""
    scale = np.maximum(np.abs(a).max(axis=0), 1e-9)
    a = a / scale
    beta = np.zeros(a.shape[1])
    for _ in range(300):
        q = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        g = a.T @ (w * (q - y)) + 1e-3 * beta
        h = (a * (w * q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """Fit on an expected `per_class` labelled texts of either class; `labels` holds the rows to learn from.

    Labels are picked by a hash of their id. Null ids, labels and texts teach
    nothing; an id labelled both ways teaches both, a label said twice counts once,
    and of documents that repeat an id each teaches. Returns None unless both
    classes have texts in the counts and for the curve.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("toxic")).distinct()
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    share = {y: min(1.0, p.per_class / c) for y, c in n.items()}
    picked = known.where(uniform("_id", seed=p.seed) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # At most about 2 x per_class rows of two integers, whatever the size of the labels.
    sample = materialise(
        docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(picked), "_id").withColumn("curve", uniform("_id", seed=p.seed + 1) < p.calibrate)
    )
    grams, backoff = log_ratios(_count(sample.where(~F.col("curve")), p), p.discount)
    if not grams:
        return None
    shared = docs.sparkSession.sparkContext.broadcast((grams, backoff))

    def make():
        s = Scorer(*shared.value, p)

        def run(ys, texts):
            out = [s.text(t) for t in texts]
            return ys, *([x[i] for x in out] for i in range(3))

        return run

    rows = map_columns(sample.where("curve"), ["toxic", "text"], make, _RATIOS).collect()
    y = np.array([r["toxic"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    curve = _curve(np.array([_features(r["ratio"], r["passage"], r["words"]) for r in rows]), y, weight / weight.mean())
    return ToxicityModel(grams, backoff, curve, p)


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row, from the text alone; one narrow stage.

    Null and wordless texts get the score of differences of 0. Without a model every
    score is 0. Null and repeated ids keep a row each. The model's size depends
    on the bounded sample, not on the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        s = Scorer(m.grams, m.backoff, m.params) if m else None

        def run(ids, texts):
            if not m:
                return ids, [0.0] * len(ids)
            z = np.array([_features(*s.text(t)) for t in texts]) @ m.curve
            return ids, (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()

        return run

    return map_columns(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col]], make, SCHEMA)
