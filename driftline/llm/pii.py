"""Personal data: fixed forms, and identifiers found by their contexts.

The fixed forms (e-mail, IPv4, card, phone) are always reported. They are also
the seeds of a bootstrap. A mention is a token that looks like an identifier; the
words before it make its lexical patterns. Patterns and the distinct instances
they extract form a bipartite graph. In each round a pattern's confidence is the
known share of its instances (log-weighted by how many are known), an instance's
is the noisy-or of its confident patterns, and instances above a threshold become
known. Mentions that a confident pattern extracts are then reported as kind
`identifier`. Copies of a text don't count twice: the graph's edges are distinct.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_columns, materialise

KINDS = ("email", "ip", "card", "phone", "identifier")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPACE = re.compile(r"\s")
_EDGES = ".,;:!?\"'()[]{}<>|=#"

_MENTION = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("instance", T.StringType()), T.StructField("seed", T.BooleanType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("mentions", T.ArrayType(_MENTION)), T.StructField("text_hash", T.LongType())])


@dataclass(frozen=True)
class PiiParams:
    """`min_seeds`: distinct known instances a pattern needs; `pattern_conf`, `instance_conf`: thresholds.

    `min_digits`, `min_length`: what looks like an identifier; it may be of any
    length. `word_chars`: of a longer word before a mention its last characters
    make the pattern, alone. An instance of over `instance_chars` characters is
    known by its SHA-256, so long ones stay exact and small.
    """

    min_seeds: int = 3
    pattern_conf: float = 0.5
    instance_conf: float = 0.6
    min_digits: int = 3
    min_length: int = 5
    word_chars: int = 64
    instance_chars: int = 128


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap, found from each @; the run before it can hold no other."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms by start, then kind; code points, end exclusive."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def _word_before(text: str, end: int, most: int) -> tuple[str, int, bool]:
    """(word that ends at `end`, where it starts, whether it is whole): its last `most` characters if it is longer."""
    low = max(0, end - most)
    a = end
    while a > low and not text[a - 1].isspace():
        a -= 1
    return text[a:end], a, a == 0 or text[a - 1].isspace()


def patterns_of(text: str, start: int, most: int = 64) -> list[str]:
    """Lexical patterns of what starts here: the two words before it, and the word before if it ends in `:`, `=` or `#`.

    Words are lower-cased and their digits become 0. White space between them may
    be of any length. A word of over `most` characters counts by its last ones and
    has none before it.
    """
    mark, end = "", start
    while end and text[end - 1].isspace():
        mark, end = " ", end - 1
    if not end:
        return []
    last, at, whole = _word_before(text, end, most)
    last = _DIGITS.sub("0", last).lower()
    out = [last + mark] if last.endswith((":", "=", "#")) or not whole else []
    while whole and at and text[at - 1].isspace():
        at -= 1
    if whole and at:
        out.append(f"{_DIGITS.sub('0', _word_before(text, at, most)[0]).lower()} {last}{mark}")
    return out


def mentions(text: str | None, base: list[tuple[int, int, int]], p: PiiParams) -> list[tuple[int, int, str, bool, list[str]]]:
    """(start, end, instance, whether a fixed form, patterns) of whatever looks like an identifier."""
    if not text:
        return []

    def instance(a: int, b: int) -> str:
        return text[a:b] if b - a <= p.instance_chars else hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()

    out = [(a, b, instance(a, b), True, x) for _, a, b in base if (x := patterns_of(text, a, p.word_chars))]
    spans = sorted((a, b) for _, a, b in base)
    k, done = 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        a = m.start()
        while a > done and not text[a - 1].isspace() and text[a - 1] not in "=:":
            a -= 1
        space = _SPACE.search(text, m.end())
        b = done = space.start() if space else len(text)
        while a < b and text[a] in _EDGES:
            a += 1
        while b > a and text[b - 1] in _EDGES:
            b -= 1
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < b or b - a < p.min_length:
            continue
        if sum(c.isdigit() for c in text[a:b]) >= p.min_digits and (x := patterns_of(text, a, p.word_chars)):
            out.append((a, b, instance(a, b), False, x))
    return out


#: Rows of the smaller side of a join that are broadcast; beyond that the larger side's keys are salted.
SMALL, SALTS = 500_000, 16


def _meet(large: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that `small` has once; no task gets all rows of a key that many of `large` share."""
    if small.count() <= SMALL:
        return large.join(F.broadcast(small), key)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def _bootstrap(edges: DataFrame, p: PiiParams) -> DataFrame:
    """Confident patterns (pattern, conf). `edges`: distinct (pattern, instance, seed).

    Rounds go on until none adds an instance; known instances only grow, so they end.
    """
    known = materialise(edges.where("seed").select("instance").distinct())
    patterns = None
    while True:
        marked = edges.select("pattern", "instance").distinct().join(known.withColumn("known", F.lit(1)), "instance", "left")
        scored = marked.groupBy("pattern").agg(F.sum(F.coalesce("known", F.lit(0))).alias("hits"), F.count("*").alias("n"))
        conf = F.col("hits") / F.col("n") * (1 - F.pow(F.lit(2.0), -F.log2(F.col("hits") + 1)))
        new = materialise(scored.where(F.col("hits") >= p.min_seeds).withColumn("conf", conf).where(F.col("conf") >= p.pattern_conf).select("pattern", "conf"))
        instances = _meet(edges.select("pattern", "instance").distinct(), new, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf") * 0.999)))).alias("conf"))
        grown = materialise(known.union(instances.where(F.col("conf") >= p.instance_conf).select("instance")).distinct())
        same = grown.count() == known.count()
        for old in (known, *([patterns] if patterns else [])):
            discard(old)
        known, patterns = grown, new
        if same:
            return patterns


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def _scan(docs: DataFrame, p: PiiParams, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(fixed forms and mentions by row, spans that confident patterns add by row); texts are scanned once."""
    def make():
        def run(ids, texts, hashes):
            base = [base_spans(t) for t in texts]
            return ids, [[dict(kind=k, start=a, end=b) for k, a, b in x] for x in base], [
                [dict(start=a, end=b, instance=i, seed=s, patterns=q) for a, b, i, s, q in mentions(t, x, p)] for t, x in zip(texts, base, strict=True)
            ], hashes

        return run

    columns = [docs[id_col].cast("long").alias("doc_id"), docs[text_col], F.xxhash64(docs[text_col])]
    found = materialise(map_columns(docs, columns, make, _FOUND).withColumn("row", F.monotonically_increasing_id()))
    said = found.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m"))
    edges = materialise(said.select(F.explode("m.patterns").alias("pattern"), F.col("m.instance").alias("instance"), F.col("m.seed").alias("seed")).distinct())
    confident = _bootstrap(edges, p)
    new = said.where(~F.col("m.seed")).select("row", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.explode("m.patterns").alias("pattern"))
    new = _meet(new, confident.select("pattern"), "pattern")
    return found, materialise(new.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("extra")))


def find(docs: DataFrame, p: PiiParams = PiiParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_identifier, base_sha256, spans) for each row.

    Null and empty texts have no spans; ids may repeat or be null. The bootstrap
    works on mentions alone, which are few, and its aggregates combine before the
    shuffle, so a context that a third of all documents share is no hot key.
    """
    found, extra = _scan(docs, p, id_col, text_col)
    joined = found.select("row", "doc_id", "base").join(extra, "row", "left").select("doc_id", "base", "extra")

    def shape():
        def run(ids, bases, extras):
            cols = [[] for _ in KINDS]
            base_out, span_out = [], []
            for base, extra in zip(bases, extras, strict=True):
                b = [(x["kind"], x["start"], x["end"]) for x in base]
                spans = sorted(b + [(4, x["start"], x["end"]) for x in extra or []], key=lambda s: (s[1], s[0], s[2]))
                for k, c in enumerate(cols):
                    c.append(sum(s[0] == k for s in spans))
                base_out.append(hashlib.sha256(_text_of(b).encode()).hexdigest())
                span_out.append(_text_of(spans))
            return ids, *cols, base_out, span_out

        return run

    return map_columns(joined, ["doc_id", "base", "extra"], shape, _RESULT)


def redact(docs: DataFrame, p: PiiParams = PiiParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs`, each span of `find` in the text replaced by its kind in brackets.

    Only spans that patterns added are joined to the texts, by id and text hash;
    fixed forms are found again where the text is.
    """
    found, extra = _scan(docs, p, id_col, text_col)
    least = F.lit(-(1 << 63))
    added = found.select("row", F.coalesce("doc_id", least).alias("_id"), F.col("text_hash").alias("_hash")).join(extra, "row")
    added = materialise(added.select("_id", "_hash", F.transform("extra", lambda x: F.concat_ws(":", x["start"], x["end"])).alias("_extra")).dropDuplicates(["_id", "_hash"]))

    @F.pandas_udf(T.StringType())
    def rewritten(texts: pd.Series, extras: pd.Series) -> pd.Series:
        out = []
        for text, extra in zip(texts, extras, strict=True):
            if text is None:
                out.append(None)
                continue
            more = [(4, *map(int, x.split(":"))) for x in extra] if extra is not None else []
            out.append(redacted(text, sorted(base_spans(text) + more, key=lambda s: (s[1], s[0], s[2]))))
        return pd.Series(out, dtype=object)

    # The rows' own columns travel in one struct, whatever their names.
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(docs[id_col].cast("long"), least).alias("_id"), F.xxhash64(docs[text_col]).alias("_hash"))
    own = F.col("_row")
    return keyed.join(added, ["_id", "_hash"], "left").select(*[rewritten(own[c], F.col("_extra")).alias(c) if c == text_col else own[c].alias(c) for c in docs.columns])


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by `[KIND]`; of overlapping spans the first to start wins."""
    if not text or not spans:
        return text
    out, end = [], 0
    for k, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
            end = b
        else:
            end = max(end, b)
    return "".join([*out, text[end:]])
