"""Embedding near-duplicates by dual traversal of cover trees.

Vectors of one label are linked at cosine >= 0.93, which on unit vectors is a
distance of at most sqrt(2 - 2 * 0.93). A cover tree's nested levels halve their
radius; of a pair of nodes at distance d with covering radii R and S, nothing
links if d > R + S + r, and everything does if d + R + S <= r, without looking
further. What is left to single pairs is decided by their cosine in double
precision.

Labels too large for one task are cut into cells around pivots. A vector is
compared in its own cell and in those later cells whose pivot is within the
cell's covering radius + r; cells are cut further into blocks of bounded size,
whose visitors are streamed. A block with many visitors is copied, and each copy
receives a part of them. Vectors that are equal are one with a weight, so a group
of copies of any size costs one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise, uniform
from .components import connected_components

THRESHOLD = 0.93
#: Distinct vectors in a block; the most pivots of all labels together; leaf size of a tree; single pairs
#: decided at once; pairs of two nodes that one product decides sooner than a descent.
BLOCK, MAX_PIVOTS, LEAF, BATCH, PRODUCT = 4096, 20_000, 16, 1 << 16, 1 << 20
#: Blocks' worth of visitors that one copy of a block receives.
VISITS = 4
#: Bounds are only trusted beyond this, far more than rounding can move a distance.
SLACK = 1e-6

_SENT = T.StructType([
    T.StructField("task", T.StringType()), T.StructField("home", T.BooleanType()), T.StructField("rep", T.LongType()), T.StructField("weight", T.LongType()),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
])
_VISITS = T.StructType([T.StructField("part", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())])
_LINKS = T.StructType([T.StructField("rep", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])


class Node:
    """Members of a node (rows of the tree's vectors), its centre, covering radius and children."""

    __slots__ = ("centre", "members", "radius", "children", "child_centres", "child_radii", "child_small", "child_starts", "child_members")

    def __init__(self, centre: int, members: np.ndarray, radius: float) -> None:
        self.centre, self.members, self.radius, self.children = centre, members, radius, []

    def finish(self) -> None:
        """What a traversal needs of all children at once."""
        self.child_centres = np.array([c.centre for c in self.children])
        self.child_radii = np.array([c.radius for c in self.children])
        sizes = np.array([len(c.members) for c in self.children])
        self.child_small = sizes <= LEAF
        self.child_starts = np.concatenate([[0], np.cumsum(sizes)])
        self.child_members = np.concatenate([c.members for c in self.children])


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row over its largest component, so that no square overflows or vanishes; the cosine stays."""
    return vectors / np.abs(vectors).max(axis=1)[:, None]


def matrix(vectors: pa.Array, at: np.ndarray | None = None) -> np.ndarray:
    """The lists of an Arrow column (or those at some places), all of one length, as rows; no Python objects are made."""
    part = vectors if at is None else vectors.take(pa.array(at))
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class CoverTree:
    """Nested levels with halving radii over unit vectors."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.raw = vectors = scaled(vectors)
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / self.norms[:, None]
        members = np.arange(len(vectors))
        d = self._distances(0, members)
        self.root = Node(0, members, float(d.max(initial=0.0)))
        todo = [(self.root, 1.0)]
        while todo:
            node, radius = todo.pop()
            if len(node.members) <= LEAF or node.radius <= 1e-3:
                continue
            while radius >= node.radius:
                radius /= 2
            rest, centre = node.members, node.centre
            while len(rest):
                d = self._distances(centre, rest)
                inside = d <= radius
                child = Node(centre, rest[inside], float(d[inside].max()))
                node.children.append(child)
                if len(child.members) > LEAF:
                    todo.append((child, radius / 2))
                rest = rest[~inside]
                centre = int(rest[0]) if len(rest) else -1
            node.finish()

    def _distances(self, centre: int, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.unit[to] @ self.unit[centre])))


def _alone(n: Node) -> Node:
    """A leaf as the only child of itself."""
    out = Node(n.centre, n.members, n.radius)
    out.children = [n]
    out.finish()
    return out


def _products(x: Node, p: np.ndarray, y: Node, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vector of x's child p[k] with every one of y's child q[k], for all k."""
    across = np.diff(y.child_starts)[q]
    sizes = np.diff(x.child_starts)[p] * across
    k = np.repeat(np.arange(len(p)), sizes)
    nth = np.arange(len(k)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return x.child_members[x.child_starts[p][k] + nth // across[k]], y.child_members[y.child_starts[q][k] + nth % across[k]]


class Traversal:
    """Links between the vectors of two trees, or within one: counts by weight and a union of linked vectors."""

    def __init__(self, a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float = THRESHOLD) -> None:
        self.a, self.b, self.same, self.threshold = a, b, a is b, threshold
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.wa, self.wb = weight_a, weight_b
        self.links_a = np.zeros(len(weight_a), np.int64)
        self.links_b = self.links_a if self.same else np.zeros(len(weight_b), np.int64)
        self.shift = 0 if self.same else len(weight_a)
        self.label = np.arange(self.shift + len(weight_b))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0
        d = float(np.sqrt(max(0.0, 2 - 2 * float(a.unit[0] @ b.unit[0]))))
        todo = [(a.root, b.root, d)]
        while todo:
            x, y, d = todo.pop()
            gap = x.radius + y.radius
            if d > gap + self.reach + SLACK:
                continue
            if d + gap <= self.reach - SLACK:
                self._all(x, y)
            elif not x.children and not y.children or len(x.members) * len(y.members) <= PRODUCT:
                self._leaves(x, y)
            else:
                todo.extend(self._split(x, y))
        self._decide()

    def _split(self, x: Node, y: Node) -> list[tuple[Node, Node, float]]:
        x, y = (n if n.children else _alone(n) for n in (x, y)) if x is not y else (x, x)
        cx, rx, cy, ry = x.child_centres, x.child_radii, y.child_centres, y.child_radii
        out = []
        for i in range(0, len(x.children), 512):
            part = slice(i, i + 512)
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.a.unit[cx[part]] @ self.b.unit[cy].T)))
            near = d <= rx[part, None] + ry[None, :] + self.reach + SLACK
            if x is y:
                near &= np.arange(len(cy))[None, :] >= np.arange(i, i + len(d))[:, None]
            # Pairs of different leaves need no descent; their vectors are paired here.
            small = near & x.child_small[part, None] & y.child_small[None, :]
            p, q = np.nonzero(small)
            if x is y:
                same = q == i + p
                out += [(x.children[k], x.children[k], 0.0) for k in q[same].tolist() if len(x.children[k].members) > 1]
                p, q = p[~same], q[~same]
            for k in range(0, len(p), step := max(1, BATCH // LEAF)):
                self._wait(*_products(x, i + p[k : k + step], y, q[k : k + step]))
            out += [(x.children[i + p], y.children[q], float(d[p, q])) for p, q in zip(*np.nonzero(near & ~small), strict=True)]
        return out

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Give linked vectors one label, the smallest of both; labels point to labels of their own."""
        label = self.label
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (up := label[label]).tobytes() != label.tobytes():
                label[:] = up

    def _all(self, x: Node, y: Node) -> None:
        if x is y:
            w = self.wa[x.members]
            self.links_a[x.members] += w.sum() - w
        else:
            self.links_a[x.members] += self.wb[y.members].sum()
            self.links_b[y.members] += self.wa[x.members].sum()
        every = np.concatenate([x.members, self.shift + y.members])
        self._join(every, np.full(len(every), every[0]))

    def _leaves(self, x: Node, y: Node) -> None:
        """Decide the pairs of two nodes by one product, or put a few by to be decided with others in one go."""
        a, b = x.members, y.members
        if len(a) * len(b) > 64:
            cos = (self.a.raw[a] @ self.b.raw[b].T) / (self.a.norms[a][:, None] * self.b.norms[b][None, :])
            hit = np.triu(cos >= self.threshold, 1) if x is y else cos >= self.threshold
            p, q = np.nonzero(hit)
            self._link(a[p], b[q])
        elif x is y:
            p, q = np.triu_indices(len(a), 1)
            self._wait(a[p], a[q])
        else:
            self._wait(np.repeat(a, len(b)), np.tile(b, len(a)))

    def _wait(self, i: np.ndarray, j: np.ndarray) -> None:
        self.waiting.append((i, j))
        self.n_waiting += len(i)
        if self.n_waiting >= BATCH:
            self._decide()

    def _decide(self) -> None:
        waiting, self.waiting, self.n_waiting = self.waiting, [], 0
        if not waiting:
            return
        i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
        for k in range(0, len(i), BATCH):
            p, q = i[k : k + BATCH], j[k : k + BATCH]
            cos = np.einsum("ij,ij->i", self.a.raw[p], self.b.raw[q]) / (self.a.norms[p] * self.b.norms[q])
            hit = cos >= self.threshold
            self._link(p[hit], q[hit])

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links_a, i, self.wb[j])
        np.add.at(self.links_b, j, self.wa[i])
        self._join(i, self.shift + j)

    def rows(self, reps_a: np.ndarray, reps_b: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(rep, links, a linked rep that stands for the component) of every vector with a link."""
        reps = reps_a if self.same else np.concatenate([reps_a, reps_b])
        links = self.links_a if self.same else np.concatenate([self.links_a, self.links_b])
        for i in np.flatnonzero(links).tolist():
            yield int(reps[i]), int(links[i]), int(reps[self.label[i]])


def _send(reps: DataFrame, threshold: float) -> DataFrame:
    """(task, home, rep, weight, vec): where each distinct vector is at home and where it visits."""
    spark = reps.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    sizes = reps.groupBy("part").count()
    large = sizes.where(F.col("count") > BLOCK)
    n_large = large.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    small = reps.join(large.select("part"), "part", "left_anti").select(F.concat("part", F.lit("/0")).alias("task"), F.lit(True).alias("home"), "rep", "weight", "vec")
    if not n_large:
        return small
    per = max(BLOCK, math.ceil(n_large / MAX_PIVOTS))
    # About n / per pivots a label, MAX_PIVOTS in all.
    picked = reps.join(large, "part").where(uniform("rep", seed=3) < F.lit(1.0 / per))
    pivots: dict[str, list] = {}
    for r in picked.select("part", "rep", "vec").orderBy("part", "rep").collect():
        pivots.setdefault(r["part"], []).append(r["vec"])
    first = spark.sparkContext.broadcast({k: unit_rows(np.array(v)) for k, v in pivots.items()})
    placed_schema = T.StructType([*_SENT.fields[2:], T.StructField("part", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    schema = to_arrow_schema(placed_schema)

    def by_part(parts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        names = np.array(parts, dtype=object)
        for p in set(parts):
            yield p, np.flatnonzero(names == p)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, parts = b.column(2), b.column(3).to_pylist()
            cells, away = np.zeros(len(parts), np.int32), np.full(len(parts), 2.0)
            for p, at in by_part(parts):
                if (centres := first.value.get(p)) is not None:
                    cos = unit_rows(matrix(vecs, at)) @ centres.T
                    cells[at] = cos.argmax(axis=1)
                    away[at] = np.sqrt(np.maximum(0.0, 2 - 2 * cos.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells), pa.array(away)], schema=schema)

    placed = materialise(reps.join(large.select("part"), "part", "left_semi").select("rep", "weight", "vec", "part").mapInArrow(place, placed_schema))
    # One row a cell: at most MAX_PIVOTS.
    cells = {(r["part"], r["cell"]): (r["n"], r["radius"]) for r in placed.groupBy("part", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    plan = {}
    for part in {p for p, _ in cells}:
        ids = sorted(c for p, c in cells if p == part)
        plan[part] = (np.array(ids), np.array([cells[part, c][1] for c in ids]), np.array([math.ceil(cells[part, c][0] / BLOCK) for c in ids]))
    second = spark.sparkContext.broadcast(plan)

    def near(part: str, vecs: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each vector, which of the label's later cells may hold something linked to it."""
        ids, radii, _ = second.value[part]
        centres = first.value.get(part)
        if centres is None:
            return np.zeros((len(vecs), len(ids)), bool)
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (unit_rows(vecs) @ centres[ids].T)))
        return (ids[None, :] > cells[:, None]) & (d <= radii[None, :] + reach + SLACK)

    visits_schema = to_arrow_schema(_VISITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, parts, cells = b.column(0), b.column(1).to_pylist(), b.column(2).to_numpy()
            out = []
            for p, at in by_part(parts):
                n = near(p, matrix(vecs, at), cells[at]).sum(axis=0)
                out += [(p, int(second.value[p][0][k]), int(n[k])) for k in np.flatnonzero(n).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, f.type) for z, f in zip(zip(*out, strict=True), visits_schema, strict=True)], schema=visits_schema)

    # One row a cell again. A cell's blocks also visit each other; those are at most as many as its vectors.
    visits = {(r["part"], r["cell"]): r["n"] for r in placed.select("vec", "part", "cell").mapInArrow(count, _VISITS).groupBy("part", "cell").agg(F.sum("n").alias("n")).collect()}
    copies = {k: max(1, math.ceil((visits.get(k, 0) + n) / (VISITS * BLOCK))) for k, (n, _) in cells.items()}
    third = spark.sparkContext.broadcast(copies)
    sent_schema = to_arrow_schema(_SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, parts, cells, spread = b.column(2), *(b.column(c).to_pylist() for c in (3, 4, 5))
            out = []

            def flush() -> pa.RecordBatch:
                tasks, home, at = zip(*out, strict=True)
                at = pa.array(at)
                return pa.RecordBatch.from_arrays([pa.array(tasks), pa.array(home), *(b.column(c).take(at) for c in range(3))], schema=sent_schema)

            for p, at in by_part(parts):
                ids, _, blocks = second.value[p]
                later = near(p, matrix(vecs, at), np.array([cells[i] for i in at.tolist()]))
                for i, row in zip(at.tolist(), later, strict=True):
                    cell, salt = cells[i], spread[i] // 1024
                    own = int(blocks[np.searchsorted(ids, cell)])
                    mine = spread[i] % own
                    n = third.value[p, cell]
                    out += [(f"{p}/{cell}/{mine}/{s}", True, i) for s in range(n)]
                    out += [(f"{p}/{cell}/{k}/{salt % n}", False, i) for k in range(mine + 1, own)]
                    for k in np.flatnonzero(row).tolist():
                        n = third.value[p, ids[k]]
                        out += [(f"{p}/{ids[k]}/{j}/{salt % n}", False, i) for j in range(blocks[k])]
                    if len(out) >= 2000:
                        yield flush()
                        out = []
            if out:
                yield flush()

    block = F.pmod(F.xxhash64(F.lit(9), "rep"), F.lit(1 << 30)).cast("long")
    return small.unionByName(placed.select("rep", "weight", "vec", "part", "cell", block.alias("block")).mapInArrow(send, _SENT))


def _compare(sent: DataFrame, threshold: float) -> DataFrame:
    schema = to_arrow_schema(_LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, home, visit, n_visit, tree = None, [], [], 0, None

        def tables(rows: list) -> tuple[np.ndarray, np.ndarray, CoverTree]:
            reps, weights, vecs = (np.concatenate(x) for x in zip(*rows, strict=True))
            return reps, weights, CoverTree(vecs)

        def emit(rows: Iterator[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
            cols = list(zip(*rows, strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=schema)

        def settle() -> Iterator[pa.RecordBatch]:
            """The home block against itself, once all of it is here; of its copies one does that."""
            nonlocal tree
            if home and tree is None:
                tree = tables(home)
                if not task.endswith("/0"):
                    return
                yield from emit(Traversal(tree[2], tree[2], tree[1], tree[1], threshold).rows(tree[0], tree[0]))

        def visitors() -> Iterator[pa.RecordBatch]:
            nonlocal visit, n_visit
            if visit and tree:
                reps, weights, other = tables(visit)
                yield from emit(Traversal(tree[2], other, tree[1], weights, threshold).rows(tree[0], reps))
            visit, n_visit = [], 0

        for b in batches:
            tasks, homes = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((tasks[1:] != tasks[:-1]) | (homes[1:] != homes[:-1])) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(tasks)], strict=True):
                if i == j:
                    continue
                if tasks[i] != task:
                    yield from settle()
                    yield from visitors()
                    task, home, tree = tasks[i], [], None
                part = b.slice(i, j - i)
                rows = (part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4)))
                if homes[i]:
                    home.append(rows)
                else:
                    yield from settle()
                    visit.append(rows)
                    n_visit += j - i
                    if n_visit >= BLOCK:
                        yield from visitors()
        yield from settle()
        yield from visitors()

    return sent.repartition("task").sortWithinPartitions("task", F.desc("home")).select("task", "home", "rep", "weight", "vec").mapInArrow(run, _LINKS)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Only rows of one label and one length are compared. A null label, and a
    vector that is null, empty, all zero or holds a null or non-finite component
    links with nothing: 0 links, its own component, kept. Components of any finite
    size count, as vectors are scaled first. Rows that share an id are vectors of
    their own. A null id links like any other and counts in others' n_links; a
    component of null ids only has a null component_id, and its rows are kept.
    """
    x = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = (
        F.col("label").isNotNull() & x.isNotNull() & F.exists(x, lambda v: v != 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("part", F.concat_ws("~", F.size("vec").cast("string"), "label"))
    rows = rows.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), F.reverse("vec")))
    key = ["part", "k1", "k2"]
    # rep stands for equal vectors: an id may be on different ones.
    reps = rows.where("ok").groupBy(*key).agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()))
    found = materialise(_compare(_send(reps, threshold), threshold))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    member = reps.select("rep", "low").join(parts.withColumnRenamed("node", "rep"), "rep")
    lows = member.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = member.join(lows, "component").select("rep", "component_id")
    info = reps.select(*key, "rep", "low", "weight").join(links, "rep", "left").join(ids, "rep", "left").select(
        *key, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")
    )
    linked = rows.where("ok").select("vec_id", *key).join(info, key).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
