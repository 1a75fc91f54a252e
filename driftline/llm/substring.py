r"""Removal of repeated passages: 50-word windows, a count-min prefilter and an exact second pass.

A window is 50 consecutive words of one text. It is removed where the same words
also start in a document with a smaller id.

First pass. Every window is keyed by the smallest hash among the 16-word spans in
it, which is the same for equal windows and, along a text, changes only about
every 18 words. Each task counts, per document, the distinct keys of its windows
in a two-row count-min sketch; the tasks' sketches are merged, cells saturating
at two. A key's estimate is at least the number of documents that hold it, so at
least the number that hold any of its windows.

Second pass. Windows whose key is estimated in two documents or more are grouped
exactly. Equal are windows whose 128-bit digests are: two 64-bit sums over the
words, each over a half of the words' own 128-bit digests that the other doesn't
use, so a collision must happen in both at once. A task first settles what its own
documents decide (all but the smallest id of a window go, as someone smaller is
there) and sends on only the smallest, so a passage that a third of all
documents share adds one row a task, not one a document.

The sketch has at most 2 x 2^28 bits, which is what is broadcast. Beyond about
10^10 words it fills up and lets more windows through to the exact pass; the
result stays the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ascii_words

WINDOW, SPAN = 50, 16
BLOCK = 20
MAX_BITS = 28
#: Windows a task gathers before it settles them and sends on the rest.
CHUNK = 1 << 20
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ROWS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_U = np.uint64

_SKETCH = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("more", T.BinaryType())])
_BITMAP = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("bits", T.BinaryType())])
_SEEN = T.StructType([
    T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()),
    T.StructField("pos", T.IntegerType()), T.StructField("gone", T.BinaryType()),
])
_GONE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("gone", T.BinaryType())])
_KEPT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
])
_KEPT_TEXT = T.StructType([*_KEPT.fields[:3], T.StructField("text", T.StringType())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Two independent 64-bit digests of each word of a text."""

    __slots__ = ("low", "high")

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.high = low, high


class Windows:
    """Rolling hashes of a text's windows; word digests are remembered up to a bound, those of very long words never."""

    def __init__(self, keep: int = 400_000, longest: int = 64) -> None:
        self.keep, self.longest, self.size = keep, longest, 0
        self._forget()
        self._grow(1 << 12)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.digests = np.zeros((1 << 12, 2), _U)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = 1 << (n - 1).bit_length()
            for name, base in (("p1", _B1), ("p2", _B2), ("i1", pow(_B1, -1, 1 << 64)), ("i2", pow(_B2, -1, 1 << 64))):
                steps = np.full(self.size, base, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def _roll(self, w: np.ndarray, powers: np.ndarray, inverse: np.ndarray, size: int) -> np.ndarray:
        n = len(w)
        sums = np.zeros(n + 1, _U)
        np.cumsum(w * powers[:n], out=sums[1:])
        return (sums[size:] - sums[:-size]) * inverse[: n - size + 1]

    def words(self, words: list[bytes]) -> Words:
        if len(self.known) > self.keep:
            self._forget()
        known = self.known
        new = [w for w in set(words) if w not in known]
        # Very long words come last; their digests are overwritten by the next text's.
        new.sort(key=lambda w: len(w) > self.longest)
        if len(known) + len(new) > len(self.digests):
            self.digests = np.concatenate([self.digests, np.zeros((len(new) + len(self.digests), 2), _U)])
        n = len(known)
        self.digests[n : n + len(new)] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), ">u8").reshape(-1, 2)
        place = dict(zip(new, range(n, n + len(new)), strict=True))
        if new and len(new[-1]) > self.longest:
            known.update((w, k) for w, k in place.items() if len(w) <= self.longest)
            at = [place[w] if w in place else known[w] for w in words]
        else:
            known.update(place)
            at = map(known.__getitem__, words)
        self._grow(len(words))
        both = self.digests[np.fromiter(at, np.int64, len(words))]
        return Words(np.ascontiguousarray(both[:, 1]), np.ascontiguousarray(both[:, 0]))

    def keys(self, w: Words) -> np.ndarray:
        """For each window, the smallest hash of the spans in it."""
        spans = _mix(self._roll(w.low, self.p1, self.i1, SPAN))
        width, step, low = WINDOW - SPAN + 1, 1, spans
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        return np.minimum(low[: len(low) - (width - step)], low[width - step :]) if step < width else low

    def hashes(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each window, in two halves that share nothing."""
        return _mix(self._roll(w.low, self.p1, self.i1, WINDOW)), _mix(self._roll(w.high, self.p2, self.i2, WINDOW))


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (keys * _U(_ROWS[row])) >> _U(64 - bits)


def sketch_bits(docs: DataFrame) -> int:
    """Cells of a sketch row as a power of two: about one for each 8 bytes of the input as Spark estimates it."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(BLOCK, min(MAX_BITS, math.ceil(math.log2(max(2, size / 8)))))


def sketch(docs: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """For each row of the sketch, a bitmap of the cells counted twice or more. Reads the columns (text)."""
    schema = to_arrow_schema(_SKETCH)

    def flush(kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(kept)
        for row in range(len(_ROWS)):
            cells, n = np.unique(_cells(keys, row, bits), return_counts=True)
            block = (cells >> _U(BLOCK)).astype(np.int64)
            low = (cells & _U((1 << BLOCK) - 1)).astype("<u4")
            names, starts = np.unique(block, return_index=True)
            stops = np.append(starts[1:], len(block))
            once, more = [], []
            for a, b in zip(starts, stops, strict=True):
                single = n[a:b] == 1
                once.append(low[a:b][single].tobytes())
                more.append(low[a:b][~single].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(names), pa.int32()), pa.array(names, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, kept, n = Windows(), [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                words = ascii_words(text)
                if len(words) >= WINDOW:
                    kept.append(np.unique(win.keys(win.words(words))))
                    n += len(kept[-1])
            if n > CHUNK:
                yield from flush(kept)
                kept, n = [], 0
        if kept:
            yield from flush(kept)

    out_schema = to_arrow_schema(_BITMAP)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, more = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())], schema=out_schema)

        for b in batches:
            for row, block, singles, several in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (row, block):
                    if at:
                        yield done()
                    at, once, more = (row, block), np.zeros(1 << BLOCK, bool), np.zeros(1 << BLOCK, bool)
                x = np.frombuffer(singles, "<u4")
                more[x[once[x]]] = True
                once[x] = True
                x = np.frombuffer(several, "<u4")
                more[x] = True
                once[x] = True
        if at:
            yield done()

    parts = docs.select("text").mapInArrow(count, _SKETCH).repartition("row", "block").sortWithinPartitions("row", "block")
    out = {r: np.zeros(1 << (bits - 3), np.uint8) for r in range(len(_ROWS))}
    for r in parts.mapInArrow(merge, _BITMAP).toLocalIterator():
        start = r["block"] << (BLOCK - 3)
        out[r["row"]][start : start + (1 << (BLOCK - 3))] = np.frombuffer(r["bits"], np.uint8)
    return out


def _pack(doc: np.ndarray, text: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Positions by document: ids, text hashes and packed positions."""
    order = np.lexsort((pos, text, doc))
    doc, text, pos = doc[order], text[order], pos[order].astype("<u4")
    starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])))
    return doc[starts], text[starts], [x.tobytes() for x in np.split(pos, starts[1:])]


def _suspects(docs: DataFrame, bits: int, shared) -> DataFrame:
    """What each task can't settle (rows with a window) and what it can (rows with packed positions)."""
    schema = to_arrow_schema(_SEEN)

    def settle(h1, h2, doc, text, pos) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, text, pos = map(np.concatenate, (h1, h2, doc, text, pos))
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, text, pos = h1[order], h2[order], doc[order], text[order], pos[order]
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        smallest = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
        stay = doc == smallest
        for a in range(0, len(at := np.flatnonzero(stay)), 100_000):
            x = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(h1[x].view(np.int64)), pa.array(h2[x].view(np.int64)), pa.array(doc[x]), pa.array(text[x]), pa.array(pos[x]), pa.nulls(len(x), pa.binary()),
            ], schema=schema)
        if not stay.all():
            d, t, packed = _pack(doc[~stay], text[~stay], pos[~stay])
            n = len(d)
            # The first half only spreads these rows over the partitions.
            yield pa.RecordBatch.from_arrays([pa.array(_mix(d.view(_U)).view(np.int64)), pa.nulls(n, pa.int64()), pa.array(d), pa.array(t), pa.nulls(n, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, maps = Windows(), shared.value
        found, n = [[] for _ in range(5)], 0
        for b in batches:
            for i, code, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = ascii_words(text)
                if i is None or len(words) < WINDOW:
                    continue
                w = win.words(words)
                keys = win.keys(w)
                hit = np.ones(len(keys), bool)
                for row, bitmap in maps.items():
                    cells = _cells(keys, row, bits)
                    hit &= (bitmap[(cells >> _U(3)).astype(np.int64)] >> (cells & _U(7)).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(hit)
                if len(at):
                    h1, h2 = win.hashes(w)
                    for x, y in zip(found, (h1[at], h2[at], np.full(len(at), i, np.int64), np.full(len(at), code, np.int64), at.astype(np.int32)), strict=True):
                        x.append(y)
                    n += len(at)
            if n > CHUNK:
                yield from settle(*found)
                found, n = [[] for _ in range(5)], 0
        if n:
            yield from settle(*found)

    return docs.mapInArrow(run, _SEEN)


def _resolve(seen: DataFrame) -> DataFrame:
    """Packed positions of the windows to remove. Rows arrive sorted by window and id; memory is bounded by CHUNK."""
    schema = to_arrow_schema(_GONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept, n = None, [[] for _ in range(3)], 0

        def flush() -> pa.RecordBatch:
            d, t, packed = _pack(*map(np.concatenate, kept))
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(packed, pa.binary())], schema=schema)

        for b in batches:
            settled = b.filter(b.column(5).is_valid())
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([settled.column(2), settled.column(3), settled.column(5)], schema=schema)
            b = b.filter(b.column(5).is_null())
            if not b.num_rows:
                continue
            h1, h2, doc, text, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            starts = np.flatnonzero(new)
            smallest = doc[starts].copy()
            if last and (h1[0], h2[0]) == last[:2]:
                smallest[0] = last[2]
            last = (h1[-1], h2[-1], smallest[-1])
            go = doc > smallest[np.cumsum(new) - 1]
            if go.any():
                for x, y in zip(kept, (doc[go], text[go], pos[go]), strict=True):
                    x.append(y)
                n += int(go.sum())
                if n > CHUNK:
                    yield flush()
                    kept, n = [[] for _ in range(3)], 0
        if n:
            yield flush()

    return seen.repartition("h1").sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(run, _GONE)


def kept_words(text: str | None, gone: list[bytes] | None) -> tuple[list[bytes], list[bytes]]:
    """(all words, words left) when the windows that start at the packed positions go."""
    words = ascii_words(text)
    if not gone:
        return words, words
    at = np.concatenate([np.frombuffer(x, "<u4") for x in gone])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    stay = np.cumsum(edge[:-1]) == 0
    return words, [words[i] for i in np.flatnonzero(stay).tolist()]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row, or with `digest=False` the text left instead of its hash.

    Null texts have no words; texts under 50 words lose nothing. Windows are
    judged on the input. Rows that share an id don't remove each other's words and
    are told apart by the 64-bit hash of their text (equal rows lose the same);
    a null id neither removes nor loses words. Every text moves once, to meet
    its own positions; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    bits = sketch_bits(docs.select(id_col, text_col))
    maps = sketch(rows, bits)
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    del maps
    gone = _resolve(_suspects(rows, bits, shared)).groupBy("doc_id", "text_hash").agg(F.collect_list("gone").alias("gone"))
    joined = rows.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", "gone")
    target = _KEPT if digest else _KEPT_TEXT
    schema = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, m, out = [], [], [], []
            for i, text, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, left = kept_words(text, g)
                kept = b" ".join(left)
                ids.append(i)
                n.append(len(words))
                m.append(len(words) - len(left))
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, n, m, out), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, target)
