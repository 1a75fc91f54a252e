"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the k smallest hashes of a text's distinct shingles. Sketches of
parts merge into the sketch of the whole; two of them estimate resemblance and
containment, one the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

K = 128
SHINGLE = 3
#: Hashes are cut to so many bytes: 2^48 values.
WIDTH = 6
_TOP = float(1 << (8 * WIDTH))
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("n_shingles", T.DoubleType()),
])


class Sketcher:
    """Sketches of texts; hashes of words are remembered up to a bound, those of very long words never."""

    def __init__(self, k: int = K, keep: int = 400_000, longest: int = 64) -> None:
        self.k, self.keep, self.longest, self.known = k, keep, longest, {}

    def sketch(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes, k at most. A text of 1 or 2 words has one shingle, one without words none."""
        words = text.split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        w = np.array([known[x] for x in words], np.uint64)
        for x in {x for x in words if len(x) > self.longest}:
            del known[x]
        n = max(1, len(w) - SHINGLE + 1)
        h = np.full(n, 0x51ED270B, np.uint64)
        for i in range(min(SHINGLE, len(w))):
            h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 8 * WIDTH)
        if n > 8 * self.k:
            h = h[h <= np.partition(h, 4 * self.k)[4 * self.k]]
            if len(cut := np.unique(h)) >= self.k:
                return cut[: self.k]
            return self._whole(w, n)
        return np.unique(h)[: self.k]

    def _whole(self, w: np.ndarray, n: int) -> np.ndarray:
        """For texts that repeat themselves so much that the short way finds too few."""
        h = np.full(n, 0x51ED270B, np.uint64)
        for i in range(SHINGLE):
            h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 8 * WIDTH))[: self.k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / _TOP)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared share of the union, 1 for two sketches without shingles."""
    u = merge(a, b, k)
    if not len(u):
        return 1.0
    return float(np.isin(u, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(u))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too, 1 if a has none."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * distinct(merge(a, b, k), k) / distinct(a, k))


def encode(a: np.ndarray) -> str:
    """Text form: base64 of the hashes in order, six bytes each."""
    return base64.b64encode(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()).decode()


def decode(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, WIDTH)
    return np.pad(raw, ((0, 0), (0, 8 - WIDTH))).copy().view("<u8").ravel().astype(np.uint64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, fingerprint, n_shingles) for each row; one narrow stage. Null and blank texts: '' and 0."""
    from .common import map_columns

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())])

    def make():
        s = Sketcher(k)

        def run(ids, texts):
            out = [s.sketch(t) for t in texts]
            return ids, [encode(x) for x in out], [distinct(x, k) for x in out]

        return run

    return map_columns(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col]], make, schema)


class Ranges:
    """Consecutive ranges of the order of documents, about equal in rows.

    Rows are ordered by id, descending, rows without one last; rows of one id by
    the hash of their text. Cuts are quantiles of the ids. An id that takes
    several quantiles, and the rows without an id, are cut further by the hash.
    """

    def __init__(self, rows: DataFrame, parts: int) -> None:
        wanted = [1 - i / parts for i in range(1, parts)] or [0.5]
        at, n, known = rows.agg(F.percentile_approx("doc_id", wanted, 100 * parts), F.count("*"), F.count("doc_id")).first()
        times = Counter((at or [])[: parts - 1])
        self.cuts = np.array(sorted(times), np.int64)
        # Range k is the ids below k of the cuts but not below the next one, which is the last id in it.
        repeated = [times[c] if times[c] > 1 else 0 for c in self.cuts[::-1].tolist()]
        self.pieces = np.array([*repeated, 0])
        self.first = np.concatenate([[0], np.cumsum(1 + self.pieces)])
        self.of_nulls = max(1, math.ceil((n - known) * parts / max(1, n)))
        self.count = int(self.first[-1]) + self.of_nulls

    def of(self, ids: np.ndarray, none: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Range of each row; `h` has 31 bits of the text's hash."""
        k = len(self.cuts) - np.searchsorted(self.cuts, ids, side="right")
        last = np.append(self.cuts[::-1], 0)[k]
        pieces = np.where((k < len(self.cuts)) & (ids == last), self.pieces[k], 0)
        at = self.first[k] + np.where(pieces > 0, 1 + (h * pieces >> 31), 0)
        return np.where(none, self.first[-1] + (h * self.of_nulls >> 31), at)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Sketch of every text, of its edited text, and how like they and the next document's are.

    The next document is the one after in descending id, after the last the
    first; equal ids are ordered by the hash of their text, null ids come last.
    The edited text has its last floor(n/3) code points replaced by the first as
    many (or all) of the next document's. Null texts count as empty; no row is
    lost or added.

    Rows are cut into ranges of that order; each range also receives the first
    row of the range after it, so every text moves once, and a range is read in
    order with two texts in memory. Only one key per range is collected. Only rows
    equal in id and text can't be parted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ranges = Ranges(rows.select("doc_id"), parts)
    shared = spark.sparkContext.broadcast(ranges)

    @F.pandas_udf(T.IntegerType())
    def range_of(ids: pd.Series, none: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(ids.to_numpy(), none.to_numpy(), h.to_numpy()).astype("int32"))

    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 33))
    placed = rows.withColumn("at", range_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("h")))
    # The complement reverses the order of all longs.
    place = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "h")
    found = placed.select("doc_id", "h", "at").groupBy("at").agg(F.min_by(F.struct("doc_id", "h"), place).alias("head")).collect()
    heads = {r["at"]: tuple(r["head"]) for r in found}
    order = sorted(heads)
    if not order:
        return spark.createDataFrame([], SCHEMA)
    # One row for each range.
    visits = spark.createDataFrame([(*heads[order[(i + 1) % len(order)]], at) for i, at in enumerate(order)], "head long, head_h long, to int")
    on = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h"))
    visitors = rows.join(F.broadcast(visits), on).select("doc_id", "text", "h", F.col("to").alias("at"), F.lit(1).alias("visitor"))
    moved = placed.withColumn("visitor", F.lit(0)).unionByName(visitors)
    moved = moved.repartitionById(ranges.count, F.col("at")).sortWithinPartitions(F.asc("visitor"), F.desc_nulls_last("doc_id"), F.asc("h"), F.asc("text"))
    target = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketcher()
        last, done = None, False
        for b in batches:
            out = []
            for i, text, visitor in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if done:
                    break
                now = (i, text, s.sketch(text))
                if last:
                    out.append(_row(s, last, now))
                last, done = now, bool(visitor)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return moved.select("doc_id", "text", "visitor").mapInArrow(run, SCHEMA)


def _row(s: Sketcher, a: tuple, b: tuple) -> tuple:
    (i, text, sketch), (_, following, after) = a, b
    n, m = len(text), len(text) // 3
    edited = text[: n - m] + following[:m] if m else text
    other = s.sketch(edited)
    return i, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(sketch), encode(other), resemblance(sketch, other), resemblance(sketch, after), distinct(sketch)
