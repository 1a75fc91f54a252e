"""Ranked text search: postings as a DataFrame and BM25 over a document's fields together.

Queries hold terms (all must match), "phrases", prefix*, ^first, column:what,
NEAR(a b, 5), parentheses, AND, OR and NOT. Terms next to each other bind
tightest, then NOT, AND, OR. Anything else is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.sources.store import shared_table

K1, B = 1.2, 0.75
_TOKEN = r"[\p{L}\p{N}]+"
_LEXEME = re.compile(r'\s*(?:(NEAR)\s*(?=\()|"([^"]*)"|([():,^+])|([^\s":(),^+]+))')


class QueryError(ValueError):
    """The search expression can't be read."""


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; the last may be a prefix, the first may have to open its field."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Near:
    """Phrases of one field with at most `gap` tokens between them."""

    phrases: tuple[Phrase, ...]
    gap: int = 10


@dataclass(frozen=True)
class Join:
    """`op` is AND, OR or NOT (the left side without the right)."""

    op: str
    left: Expr
    right: Expr


Expr = Phrase | Near | Join


@dataclass
class Index:
    """Postings (term, id, field, pos) and lengths (id, len) of all documents, whether or not they have a posting."""

    terms: DataFrame
    lengths: DataFrame


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def _scan(docs: DataFrame, id_col: str, fields: list[str], wanted: Callable[[Column], Column]) -> Index:
    """One pass over the texts: each document's length and those of its postings that are wanted."""
    def places(field: str) -> Column:
        return F.transform(tokens(F.col(field)), lambda t, i: F.struct(F.lit(field).alias("field"), i.alias("pos"), t.alias("term")))

    each = [places(f) for f in fields]
    found = docs.select(F.col(id_col).alias("id"), F.concat(*each).alias("all"))
    found = shared_table(found.select("id", F.size("all").cast("long").alias("len"), F.filter("all", lambda p: wanted(p["term"])).alias("some")))
    lengths = found.groupBy("id").agg(F.sum("len").alias("len")).where("len > 0")
    return Index(found.select("id", F.explode("some").alias("p")).select(F.col("p.term").alias("term"), "id",
        F.col("p.field").alias("field"), F.col("p.pos").alias("pos")), lengths)


def build(docs: DataFrame, id_col: str, fields: list[str]) -> Index:
    """The whole index, written in order of term and id: a search reads its terms' row groups only, and a common term spans many."""
    all_of = _scan(docs, id_col, fields, lambda _: F.lit(True))
    return Index(shared_table(all_of.terms.repartitionByRange("term", "id").sortWithinPartitions("term", "id")), shared_table(all_of.lengths))


def lookup(docs: DataFrame, id_col: str, fields: list[str], query: str) -> Index:
    """What one query needs of documents that have no index, in one pass over them."""
    phrases = list(_phrases(parse(query)))
    exact = sorted({t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)})
    starts = sorted({p.terms[-1] for p in phrases if p.prefix})
    return _scan(docs, id_col, fields, lambda t: reduce(lambda a, s: a | t.startswith(s), starts, t.isin(*exact) if exact else F.lit(False)))


def parse(query: str) -> Expr:
    words: list[tuple[str, str]] = []
    at = 0
    while query[at:].strip():
        m = _LEXEME.match(query, at)
        if not m:
            raise QueryError(f"can't read {query[at:]!r}")
        near, quoted, mark, word = m.groups()
        at = m.end()
        kind = "near" if near else "mark" if mark else "text" if quoted is not None else word if word in ("AND", "OR", "NOT") else "text"
        words.append((kind, near or mark or (quoted if quoted is not None else word)))
    read = _Reader(words)
    out = read.either(None)
    if read.at < len(words):
        raise QueryError(f"can't read {words[read.at][1]!r}")
    return out


class _Reader:
    """Recursive descent over the words of a query; `field` is the column that what is read is confined to."""

    def __init__(self, words: list[tuple[str, str]]) -> None:
        self.words, self.at = words, 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.words[self.at + ahead] if self.at + ahead < len(self.words) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str:
        k, v = self.peek()
        if k != kind or value is not None and v != value:
            raise QueryError(f"expected {value or kind}, found {v or 'the end'!r}")
        self.at += 1
        return v

    def chain(self, op: str, part: Callable[[str | None], Expr], field: str | None) -> Expr:
        out = part(field)
        while self.peek()[0] == op:
            self.at += 1
            out = Join(op, out, part(field))
        return out

    def either(self, field: str | None) -> Expr:
        return self.chain("OR", self.both, field)

    def both(self, field: str | None) -> Expr:
        return self.chain("AND", self.without, field)

    def without(self, field: str | None) -> Expr:
        return self.chain("NOT", self.beside, field)

    def beside(self, field: str | None) -> Expr:
        out = self.one(field)
        while self.peek()[0] in ("text", "near") or self.peek() in (("mark", "("), ("mark", "^")):
            out = Join("AND", out, self.one(field))
        return out

    def one(self, field: str | None) -> Expr:
        kind, value = self.peek()
        if kind == "text" and self.peek(1) == ("mark", ":"):
            self.at += 2
            return self.one(value)
        if (kind, value) == ("mark", "("):
            self.at += 1
            out = self.either(field)
            self.take("mark", ")")
            return out
        if kind == "near":
            self.at += 1
            self.take("mark", "(")
            phrases = [self.phrase(field)]
            while self.peek()[0] == "text":
                phrases.append(self.phrase(field))
            gap = 10
            if self.peek() == ("mark", ","):
                self.at += 1
                text = self.take("text")
                if not text.isdigit():
                    raise QueryError(f"no distance in {text!r}")
                gap = int(text)
            self.take("mark", ")")
            return Near(tuple(phrases), gap)
        return self.phrase(field)

    def phrase(self, field: str | None) -> Phrase:
        first = self.peek() == ("mark", "^")
        self.at += first
        terms: list[str] = []
        prefix = False
        while True:
            text = self.take("text")
            found = re.findall(r"[^\W_]+", text.lower())
            if not found or "*" in text.rstrip("*") or prefix:
                raise QueryError(f"no term in {text!r}")
            terms += found
            prefix = text.endswith("*")
            if self.peek() != ("mark", "+"):
                return Phrase(tuple(terms), prefix, first, field)
            self.at += 1


def _phrases(e: Expr, wanted_only: bool = False) -> Iterator[Phrase]:
    """The phrases of a query; with `wanted_only` not those on the right of NOT."""
    if isinstance(e, Phrase):
        yield e
    elif isinstance(e, Near):
        yield from e.phrases
    else:
        yield from _phrases(e.left, wanted_only)
        if e.op != "NOT" or not wanted_only:
            yield from _phrases(e.right, wanted_only)


def _is_term(p: Phrase, i: int) -> Column:
    return F.col("term").startswith(p.terms[i]) if p.prefix and i == len(p.terms) - 1 else F.col("term") == p.terms[i]


def _occurrences(terms: DataFrame, p: Phrase) -> DataFrame:
    """(id, field, pos) where a phrase begins: the places that all its terms point back to."""
    rows = terms.where(F.col("field") == p.field) if p.field else terms
    if p.first:
        rows = rows.where(F.col("pos") < len(p.terms))
    parts = F.filter(F.array(*[F.when(_is_term(p, i), F.lit(i)) for i in range(len(p.terms))]), lambda x: x.isNotNull())
    back = rows.select("id", "field", "pos", F.explode(parts).alias("nth")).select("id", "field", (F.col("pos") - F.col("nth")).alias("pos"), "nth")
    found = back.groupBy("id", "field", "pos").agg(F.count_distinct("nth").alias("n")).where(F.col("n") == len(p.terms)) if len(p.terms) > 1 else back
    return (found.where("pos = 0") if p.first else found).select("id", "field", "pos")


def _near(terms: DataFrame, e: Near) -> DataFrame:
    """(id) of documents where some field has all phrases close together."""
    size = len(e.phrases)
    each = [_occurrences(terms, p).select("id", "field",
        F.struct(F.lit(k).alias("k"), F.col("pos").alias("a"), (F.col("pos") + len(p.terms) - 1).alias("b")).alias("o")) for k, p in enumerate(e.phrases)]
    lists = reduce(lambda a, b: a.union(b), each).groupBy("id", "field").agg(F.collect_list("o").alias("places"))

    def follows(k: int, x: Column) -> Column:
        return F.exists("places", lambda y: (y["k"] == k) & (y["b"] >= x["b"]) & (y["a"] <= x["b"] + e.gap + 1))

    def together(x: Column) -> Column:
        """Whether every phrase is there with x as the one that ends first."""
        return reduce(lambda a, b: a & b, [follows(k, x) for k in range(size)])

    return lists.where(F.exists("places", together)).select("id")


def _condition(e: Expr, seen: dict[Expr, int]) -> Column:
    """The query over `met`, the numbers of the phrases that a document has."""
    if isinstance(e, Join):
        left, right = _condition(e.left, seen), _condition(e.right, seen)
        return left & right if e.op == "AND" else left | right if e.op == "OR" else left & ~right
    return F.array_contains("met", seen.setdefault(e, len(seen)))


def bm25(index: Index, query: str) -> DataFrame:
    """(id, score) of the documents that match; the score sums over the query's positive terms.

    The postings of the query's terms are read once for what each document has, and
    once for the frequencies; nothing else of the corpus but its lengths is read.
    """
    e = parse(query)
    seen: dict[Expr, int] = {}
    fits = _condition(e, seen)
    ask = reduce(lambda a, b: a | b, [_is_term(p, i) for p in _phrases(e) for i in range(len(p.terms))])
    terms = index.terms.where(ask)
    met = [(_near(terms, x) if isinstance(x, Near) else _occurrences(terms, x).select("id")).select("id", F.lit(k).alias("k")) for x, k in seen.items()]
    hits = reduce(lambda a, b: a.union(b), met).groupBy("id").agg(F.collect_set("k").alias("met")).where(fits).select("id")
    keys = sorted({(t, p.prefix and i == len(p.terms) - 1) for p in _phrases(e, True) for i, t in enumerate(p.terms)})
    which = F.filter(F.array(*[F.when(F.col("term").startswith(t) if prefix else F.col("term") == t, F.lit(k)) for k,
        (t, prefix) in enumerate(keys)]), lambda x: x.isNotNull())
    freq = terms.select("id", F.explode(which).alias("key")).groupBy("id", "key").agg(F.count("*").alias("tf"))
    df = freq.groupBy("key").agg(F.count("*").alias("df"))
    corpus = index.lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # One row a term of the query, and one of the corpus.
    scored = freq.join(hits, "id", "left_semi").join(F.broadcast(df), "key").join(index.lengths, "id").join(F.broadcast(corpus))
    return scored.groupBy("id").agg(F.sum(idf * tf).alias("score"))
