"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits are linked at 2 or fewer differing bits. The 64 bits are
cut into two segments only; of two linked fingerprints, one segment then differs
by at most one bit. Each distinct fingerprint is indexed under the 32 variants
of either segment with one position left out, an equality join on (variant,
remaining bits) finds every such pair, and the whole distance verifies it.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, materialise
from .components import connected_components

BITS, SEGMENTS, MAX_DISTANCE = 64, 2, 2
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("text_hash", T.LongType())])
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16
#: Fingerprints under one variant and remainder beyond which these are told apart further.
CROWD = 1024


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles; 0 for a text without words."""
    # Both lower() and split() of bytes know ASCII only.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(body[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, _BLOCK):
        part = h[i : i + _BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) for each row; fp is the fingerprint's bits as a signed long. One narrow stage."""
    def make():
        def run(ids, texts, hashes):
            return ids, np.array([fingerprint(t) for t in texts], dtype="<u8").view("<i8").tolist(), hashes

        return run

    return map_columns(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col], F.xxhash64(docs[text_col])], make, SCHEMA)


def _masks() -> list[int]:
    """The bits that each variant keeps, as signed longs: one segment without one position."""
    width = BITS // SEGMENTS
    out = []
    for s in range(SEGMENTS):
        segment = ((1 << width) - 1) << (s * width)
        for i in range(width):
            m = segment & ~(1 << (s * width + i))
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b) with a < b for all distinct fingerprints (column fp) at distance 1 or 2.

    A fingerprint has at most 2,080 others within that distance, so the pairs
    grow in proportion to the fingerprints however many documents share them.
    Remainders that many fingerprints share are told apart further, losing none.
    """
    variants = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in _masks()])).alias("variant", "mask")).select(
        "fp", "variant", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest")
    )
    # Counted where the join needs the rows anyway: one exchange serves both.
    variants = variants.withColumn("crowd", F.count("*").over(Window.partitionBy("variant", "rest")) > CROWD)
    # Where many share a remainder, the other segment is cut in three: at most two of its bits differ, so one part is equal.
    width = BITS // SEGMENTS
    other = F.when(F.col("variant") < width, F.shiftrightunsigned("fp", width)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << width) - 1)))
    cuts = [((1 << 11) - 1), ((1 << 11) - 1) << 11, ((1 << 10) - 1) << 22]
    split = variants.where("crowd").select("fp", "variant", "rest", F.posexplode(F.array(*[other.bitwiseAND(F.lit(c)) for c in cuts])).alias("part", "same"))
    few = variants.where("NOT crowd").select("fp", "variant", "rest")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_DISTANCE

    def meet(side: DataFrame, keys: list[str]) -> DataFrame:
        # Never by broadcast: Spark's estimate leaves out what an explode adds, so it would send 64 rows a fingerprint through the driver.
        on = F.col("a.fp") < F.col("b.fp")
        for k in keys:
            on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
        return side.alias("a").hint("merge").join(side.alias("b").hint("merge"), on & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    return meet(few, ["variant", "rest"]).union(meet(split, ["variant", "rest", "part", "same"])).distinct()


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, text_hash, n_near, component_id, root) for each row; root is the smallest fingerprint of the row's component.

    Rows are grouped by fingerprint first, so copies are never paired with each
    other: the join and the components see distinct fingerprints only.
    """
    prints = materialise(fingerprints(docs, id_col, text_col))
    groups = materialise(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")))
    pairs = materialise(linked_pairs(groups.select("fp")))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = groups.select(F.col("fp").alias("b"), "n")
    around = both.join(sizes, "b").groupBy("a").agg(F.sum("n").alias("around")).withColumnRenamed("a", "fp")
    parts = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    member = groups.join(parts.withColumnRenamed("node", "fp"), "fp")
    roots = member.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = member.join(roots, "component").join(around, "fp").select("fp", "component_id", (F.col("n") - 1 + F.col("around")).alias("n_near"), F.col("component").alias("root"))
    alone = groups.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_anti").select(
        "fp", F.col("low").alias("component_id"), (F.col("n") - 1).alias("n_near"), F.col("fp").alias("root")
    )
    info = materialise(linked.union(alone))
    return prints.join(info, "fp").select("doc_id", "fp", "text_hash", "n_near", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash, n_near, component_id) for each row.

    n_near counts the other rows linked directly, component_id is the smallest
    id reachable by links. Null, empty and blank texts have fingerprint 0 and are
    linked to each other like any others. Rows that share an id are rows of
    their own. A null id is counted as a neighbour; a component of null ids only
    has a null component_id.
    """
    return _components(docs, id_col, text_col).drop("root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component, one whose id is the smallest there.

    Of rows of a component that share that id, the one with the smallest text hash
    stays, and of equal rows one. A component of null ids keeps one of its rows.
    Components are told apart by their own key, so those that have an id in
    common, or null ids only, keep a row each.
    """
    least = F.lit(-(1 << 63))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = _components(docs, id_col, text_col).groupBy("root").agg(F.min(order).alias("first"))
    # Equal texts are of one component, so id and text hash lead back to it.
    keep = keep.select(F.coalesce("first.doc_id", least).alias("_id"), F.col("first.text_hash").alias("_hash"))
    # The rows' own columns travel in one struct, whatever their names.
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(docs[id_col].cast("long"), least).alias("_id"), F.xxhash64(docs[text_col]).alias("_hash"), docs[id_col].isNull().alias("_none"))
    first = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_none"))
    return keyed.join(keep, ["_id", "_hash"]).withColumn("_n", first).where("_n = 1").select("_row.*")
