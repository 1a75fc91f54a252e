"""Shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups.

Equal texts are one group and go to one shard together. Groups are dealt to
buckets by a hash; in each bucket, differencing repeatedly takes the two partial
partitions with the largest spread and joins them oppositely ordered (largest
part with smallest) until one is left. The buckets' partitions are then joined
in the same way, from their sums alone. Groups too heavy to be evened out within
one of several buckets are differenced first, and every bucket starts from its
share of their sums.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Groups that one task differences at once.
PER_BUCKET = 100_000
#: Partitions that one task (or at last the driver) joins at once.
PER_JOIN = 1000
#: Rows of a shard numbered by one task.
PER_CHUNK = 200_000
_MOVED = T.StructType([T.StructField(n, T.LongType()) for n in ("bucket", "part", "to")])
_PLACED = T.StructType([T.StructField("unit", T.BinaryType()), T.StructField("bucket", T.LongType()), T.StructField("part", T.IntegerType())])


def karmarkar_karp(sizes: list[int], parts: int, start: list[int] | None = None) -> list[int]:
    """A part number for each size; the sums of the parts are made near equal.

    `start` has what each part holds already. Ties are broken by position, so the
    result depends on the order of `sizes` and on `start` alone.
    """
    n = len(sizes)
    after = [-1] * (n + parts)
    heap = [(-s, i, [(s, i, i)] + [(0, -1, -1)] * (parts - 1)) for i, s in enumerate(sizes)]
    if start is not None:
        # Part k's sum is an item n + k, all of them in one partition.
        held = sorted(((s, n + k, n + k) for k, s in enumerate(start)), key=lambda x: -x[0])
        heap.append((held[-1][0] - held[0][0], n, held))
    heapq.heapify(heap)
    serial = n + 1
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = []
        for (s, first, last), (t, head, tail) in zip(a, reversed(b), strict=True):
            if first < 0:
                first, last = head, tail
            elif head >= 0:
                after[last] = head
                last = tail
            joined.append((s + t, first, last))
        joined.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], serial, joined))
        serial += 1
    out = [0] * n
    for k, (_, i, _) in enumerate(heap[0][2] if heap else []):
        chain = []
        while i >= 0:
            chain.append(i)
            i = after[i]
        for i in chain:
            k = i - n if i >= n else k
        for i in chain:
            if i < n:
                out[i] = k
    return out


def combine(partitions: list[list[int]]) -> list[list[int]]:
    """For each partition (its parts' sums), the final part that each of its parts joins."""
    if not partitions:
        return []
    k = len(partitions[0])

    def start(i: int) -> list[tuple[int, list[tuple[int, int]]]]:
        return sorted(((s, [(i, j)]) for j, s in enumerate(partitions[i])), key=lambda x: -x[0])

    heap = []
    for i in range(len(partitions)):
        p = start(i)
        heap.append((p[-1][0] - p[0][0], i, p))
    heapq.heapify(heap)
    serial = len(partitions)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = []
        for (s, x), (t, y) in zip(a, reversed(b), strict=True):
            long, short = (x, y) if len(x) >= len(y) else (y, x)
            long.extend(short)
            joined.append((s + t, long))
        joined.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], serial, joined))
        serial += 1
    out = [[0] * k for _ in partitions]
    for part, (_, members) in enumerate(heap[0][2]):
        for i, j in members:
            out[i][j] = part
    return out


def _joined(placed: DataFrame, buckets: int, shards: int) -> DataFrame:
    """(bucket, part, shard): the shard that each part of each bucket's partition joins.

    Partitions are joined PER_JOIN at a time in tasks, those that result again,
    until few enough are left for the driver: shards x PER_JOIN rows at most,
    however many groups there are.
    """
    spark = placed.sparkSession

    def final(sums: DataFrame) -> list[tuple[int, int, int]]:
        held: dict[int, list[int]] = {}
        for r in sums.collect():
            held.setdefault(r["bucket"], [0] * shards)[r["part"]] = r["bytes"]
        order = sorted(held)
        return [(b, j, f) for b, row in zip(order, combine([held[b] for b in order]), strict=True) for j, f in enumerate(row)]

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list[int]] = {}
        for b, j, n in zip(pdf["bucket"].tolist(), pdf["part"].tolist(), pdf["bytes"].tolist(), strict=True):
            held.setdefault(b, [0] * shards)[j] = n
        order = sorted(held)
        rows = [(b, j, f) for b, row in zip(order, combine([held[b] for b in order]), strict=True) for j, f in enumerate(row)]
        return pd.DataFrame(rows, columns=_MOVED.names)

    sums = placed.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    steps = []
    while buckets > PER_JOIN:
        sums = materialise(sums)
        upper = F.floor(F.col("bucket") / PER_JOIN).cast("long")
        steps.append(materialise(sums.groupBy(upper.alias("_upper")).applyInPandas(together, _MOVED)))
        sums = sums.join(steps[-1], ["bucket", "part"]).groupBy(upper.alias("bucket"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
        buckets = math.ceil(buckets / PER_JOIN)
    out = spark.createDataFrame(final(sums), "bucket long, part long, shard int")
    for step in reversed(steps):
        below = step.select(F.col("bucket").alias("_b"), F.col("part").alias("_p"), F.floor(F.col("bucket") / PER_JOIN).cast("long").alias("bucket"), F.col("to").alias("part"))
        out = below.join(out, ["bucket", "part"]).select(F.col("_b").alias("bucket"), F.col("_p").alias("part"), "shard")
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row.

    size is the text's UTF-8 bytes plus 8; slots count from 0 without gaps in
    each shard. Null and empty texts are one group (size 8 a row); ids may repeat
    or be null. Only a group whose bytes exceed a shard's fair share is divided,
    by a hash of the id and row size, into pieces of about a quarter share: no
    shard could hold it and be near equal to the others. There are fewer than
    `shards` such groups, so their keys fit in the plan.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("unit"),
    ))
    groups = materialise(rows.groupBy("unit").agg(F.sum("size").alias("bytes")))
    n_groups, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    quarter = max(1, total // (4 * shards))
    large = groups.where(F.col("bytes") * shards > total).collect() if total else []
    if large:
        pieces = F.create_map(*[F.lit(x) for r in large for x in (F.lit(bytes(r["unit"])), F.lit(math.ceil(r["bytes"] / quarter)))])
        spread = F.coalesce(F.pmod(F.xxhash64("doc_id", "size"), pieces[F.col("unit")].cast("long")), F.lit(0)).cast("int")
        rows = rows.withColumn("unit", F.when(spread > 0, F.concat("unit", F.encode(spread.cast("string"), "utf-8"))).otherwise(F.col("unit")))
        groups = rows.groupBy("unit").agg(F.sum("size").alias("bytes"))
    buckets = max(1, math.ceil(n_groups / PER_BUCKET))
    # Above a quarter of a part's share of one bucket: fewer than 4 x shards x buckets groups.
    cut = total // (4 * shards * buckets)
    heavy = groups.where(F.col("bytes") > cut).collect() if buckets > 1 else []
    heavy.sort(key=lambda r: (-r["bytes"], bytes(r["unit"])))
    heavy_at = karmarkar_karp([r["bytes"] for r in heavy], shards)
    held = [0] * shards
    for r, k in zip(heavy, heavy_at, strict=True):
        held[k] += r["bytes"]
    rest = total - sum(held)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "unit"], ascending=[False, True], kind="stable")
        sizes = pdf["bytes"].tolist()
        start = [h * sum(sizes) // rest for h in held] if heavy else None
        return pd.DataFrame({"unit": pdf["unit"], "bucket": pdf["bucket"], "part": karmarkar_karp(sizes, shards, start)})

    dealt = (groups.where(F.col("bytes") <= cut) if heavy else groups).withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets)))
    placed = materialise(dealt.groupBy("bucket").applyInPandas(place, _PLACED).join(groups, "unit"))
    if heavy:
        kept = docs.sparkSession.createDataFrame([(bytes(r["unit"]), k) for r, k in zip(heavy, heavy_at, strict=True)], "unit binary, shard int")
        home = placed.select("unit", F.col("part").alias("shard")).unionByName(kept)
    else:
        home = placed.join(_joined(placed, buckets, shards), ["bucket", "part"]).select("unit", "shard")
    n_rows = rows.count()
    chunks = max(1, math.ceil(n_rows / shards / PER_CHUNK))
    at = materialise(rows.join(home, "unit").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)).alias("chunk")))
    before = at.groupBy("shard", "chunk").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("count")
    ).drop("count")
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    return at.withColumn("rank", F.row_number().over(inside)).join(before, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot")
    )
