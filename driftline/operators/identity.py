"""File identity through renames, deletions and returns.

Order matters from one commit to the next, so this is a fold. It runs over change
metadata only. Paths that no rename ties together don't concern each other, so each
group of tied paths is folded by itself, in a stream that keeps only which of its
paths live and died; ids are given out afterwards, in order of first appearance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.operators.components import components
from driftline.sources.store import clock, shared_table, small, tasks

#: A deleted path that returns within so many days is the same file, whatever it holds.
RETURN_DAYS = 90
_PHASE = {"D": 0, "R": 1, "M": 2, "A": 3}
#: A file of the tree before the first commit, among changes.
_SEED = "S"
#: Rows handed on at once.
_BATCH = 10_000

EVENTS = T.StructType([
    T.StructField("history", T.StringType()), T.StructField("table", T.StringType()), T.StructField("file_id", T.LongType()),
        T.StructField("commit_id", T.LongType()),
    T.StructField("path", T.StringType()), T.StructField("to_commit", T.LongType()), T.StructField("change", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    T.StructField("blob_oid", T.StringType()), T.StructField("lines_added", T.LongType()), T.StructField("lines_removed", T.LongType()),
])


#: What the fold reads of a change; nothing of its text.
METADATA = ("history", "commit_id", "author_time", "change", "path", "old_path", "new_blob", "lines_added", "lines_removed")


class Identity:
    """Live and dead paths after the commits folded so far."""

    def __init__(self, next_id: int = 1) -> None:
        self.live: dict[str, int] = {}
        self.dead: dict[str, tuple[int, int, str | None]] = {}
        self.blob: dict[int, str | None] = {}
        self.open: dict[int, list] = {}
        self.next_id = next_id
        self.rows: list[tuple] = []

    def _span(self, file: int, commit: int, path: str, confidence: float) -> None:
        self._end(file, commit)
        self.open[file] = ["file_paths", file, commit, path, None, None, confidence, None, None, None]

    def _end(self, file: int, commit: int) -> None:
        if file in self.open:
            row = self.open.pop(file)
            row[4] = commit
            self.rows.append(row)

    def finish(self) -> None:
        """Spans that are still open become rows as well."""
        self.rows.extend(self.open.values())
        self.open = {}

    def seed(self, path: str, blob: str | None) -> None:
        """A file of the tree before the first commit."""
        self._add(0, path, blob, 0)

    def _add(self, commit: int, path: str, blob: str | None, phase: int) -> int:
        file, self.next_id = self.next_id, self.next_id + 1
        self.live[path], self.blob[file] = file, blob
        self.rows.append(["files", file, commit, path, phase, "A", None, blob, None, None])
        self._span(file, commit, path, 1.0)
        return file

    def _enter(self, commit: int, time: int, path: str, blob: str | None, phase: int) -> int:
        """An addition: the old file if it returns in time or unchanged, else a new one."""
        old = self.dead.get(path)
        if old and (time - old[1] <= RETURN_DAYS * 86400 or (blob and blob == old[2])):
            del self.dead[path]
            self.live[path], self.blob[old[0]] = old[0], blob
            self.rows.append(["returns", old[0], commit, path, None, "A", None, blob, None, None])
            self._span(old[0], commit, path, 1.0)
            return old[0]
        return self._add(commit, path, blob, phase)

    def commit(self, commit: int, time: int, changes: list[dict]) -> None:
        """Apply one commit's changes: deletions, renames, modifications, additions, each in order of path."""
        ordered = sorted(changes, key=lambda c: (_PHASE[c["change"]], c["path"]))
        # All renamed files leave their old paths first, so chains and swaps work.
        moving = {}
        for c in ordered:
            if c["change"] == "D" and (file := self.live.pop(c["path"], None)) is not None:
                self.dead[c["path"]] = (file, time, self.blob.get(file))
                self._end(file, commit)
                self.rows.append(["deaths", file, commit, c["path"], None, "D", None, None, None, None])
                self._touch(file, commit, c)
            elif c["change"] == "R":
                moving[c["path"]] = self.live.pop(c["old_path"], None)
        for c in ordered:
            path, blob = c["path"], c.get("new_blob")
            if c["change"] == "R":
                file = moving[path]
                if file is None:
                    file = self._enter(commit, time, path, blob, 1)
                else:
                    self.live[path] = file
                    self._span(file, commit, path, rename_confidence(c["old_path"], path, self.blob.get(file), blob))
                    self.blob[file] = blob
            elif c["change"] == "M":
                file = self.live.get(path) or self._enter(commit, time, path, blob, 2)
                self.blob[file] = blob
            elif c["change"] == "A":
                file = self.live.get(path) or self._enter(commit, time, path, blob, 3)
                self.blob[file] = blob
            else:
                continue
            self._touch(file, commit, c)

    def _touch(self, file: int, commit: int, c: dict) -> None:
        self.rows.append(["touches", file, commit, c["path"], None, c["change"], None, c.get("new_blob"), c.get("lines_added"), c.get("lines_removed")])


def rename_confidence(old: str, new: str, old_blob: str | None, new_blob: str | None) -> float:
    """1 for the same content, 0.85 for the same folder or stem, else 0.6."""
    if old_blob and old_blob == new_blob:
        return 1.0
    (a, x), (b, y) = (p.rpartition("/")[::2] for p in (old, new))
    return 0.85 if a == b or x.split(".")[0] == y.split(".")[0] else 0.6


#: EVENTS within a group of paths: file_id counts there, and to_commit of a `files` row is the phase of its change.
_LOCAL = T.StructType([EVENTS["history"], T.StructField("part", T.LongType()), *EVENTS.fields[1:]])


def _parts(changes: DataFrame) -> DataFrame:
    """Adds `part`: one value for all paths of a history that renames tie together. Equal hashes would merely join two groups."""
    node = F.xxhash64("history", "path")
    renamed = changes.where("change = 'R'").select(node.alias("u"), F.xxhash64("history", "old_path").alias("v")).distinct()
    tied = small(components(renamed))
    return changes.withColumn("node", node).join(tied, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("node", "component")


def _stream(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Rows of _LOCAL from changes in order of part and commit; only one part's state is held."""
    schema = to_arrow_schema(_LOCAL)

    def changes() -> Iterator[dict]:
        for b in batches:
            names = b.schema.names
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield dict(zip(names, values, strict=True))

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out: list = []
    for (history, part), mine in groupby(changes(), key=lambda c: (c["history"], c["part"])):
        state = Identity()
        for (commit, time), step in groupby(mine, key=lambda c: (c["commit_id"], c["author_time"])):
            told = list(step)
            for c in told:
                if c["change"] == _SEED:
                    state.seed(c["path"], c["new_blob"])
            state.commit(commit, time, [c for c in told if c["change"] != _SEED])
            if len(state.rows) >= _BATCH:
                out += [(history, part, *r) for r in state.rows if r[0] in wanted]
                state.rows = []
            if len(out) >= _BATCH:
                yield batch(out)
                out = []
        state.finish()
        out += [(history, part, *r) for r in state.rows if r[0] in wanted]
        if len(out) >= _BATCH:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def fold(changes: DataFrame, seeds: DataFrame | None = None, wanted: frozenset[str] = frozenset(("files", "file_paths", "touches", "deaths", "returns"))) -> DataFrame:
    """Rows of EVENTS from changes (history, commit_id, author_time, change, path, old_path, new_blob, lines_added, lines_removed).

    table is files (first seen), file_paths (spans), touches, deaths or returns, of which
    `wanted` come back. `seeds` (history, path, blob) is the tree before the first
    commit, at commit 0. `changes` is read several times, so it should be written.
    """
    changes = changes.select(*METADATA)
    if seeds is not None:
        none, zero = F.lit(None), F.lit(0).cast("long")
        changes = changes.unionByName(seeds.select("history", zero.alias("commit_id"), zero.alias("author_time"), F.lit(_SEED).alias("change"), "path",
            none.cast("string").alias("old_path"), F.col("blob").alias("new_blob"), none.cast("long").alias("lines_added"), none.cast("long").alias("lines_removed")))
    n = tasks(changes.sparkSession, changes.count())
    ordered = _parts(changes).repartition(n, "part").sortWithinPartitions("history", "part", "commit_id", "author_time", "path", "change", "old_path", "new_blob")
    local = shared_table(ordered.mapInArrow(lambda batches: _stream(batches, wanted | {"files"}), _LOCAL))
    # Ids go by commit, phase and path, as one fold over the whole history would give them.
    births = local.where("table = 'files'").select("history", "commit_id", F.col("to_commit").alias("phase"), "path", "part", "file_id")
    ids = clock(births, "history", "commit_id", "phase", "path", "part", "file_id")
    first = ids.groupBy("history").agg(F.min("id").alias("first"))
    ids = ids.join(F.broadcast(first), "history").select("history", "part", "file_id", (F.col("id") - F.col("first") + 1).alias("id"))
    told = local.where(F.col("table").isin(*wanted)).join(small(ids), ["history", "part", "file_id"])
    return told.withColumn("file_id", F.col("id")).withColumn("to_commit", F.when(F.col("table") != "files", F.col("to_commit"))).select(*EVENTS.names)
