"""Tables of the change-history model, enum codes and flags.

Commit id 0 means "before the indexed history"; real ids start at 1. An open
interval has a null end. Links are identified by (src, dst, kind).
"""

from __future__ import annotations

from pyspark.sql import types as T

TOO_LARGE, MECHANICAL, VENDORED, MERGE = 1, 2, 4, 8
EDGE_KINDS = ("import", "call", "typeref", "docref", "reexport")
RESOLUTIONS = ("path-exact", "symbol-name", "heuristic")
CHANGES = ("A", "M", "D", "R")


def _schema(**fields: str) -> T.StructType:
    kinds = {"l": T.LongType(), "d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType(), "i": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()])


COMMITS = _schema(id="l", oid="s", parent_oid="s", author_time="l", author="s", subject="s", body="s", n_files="l", weight="d", excluded="l", is_merge="b")
FILES = _schema(id="l", current_path="s", lang="s", born_commit="l", died_commit="l", is_doc="b")
FILE_PATHS = _schema(file_id="l", path="s", from_commit="l", to_commit="l", confidence="d")
TOUCHES = _schema(commit_id="l", file_id="l", change="s", blob_oid="s", lines_added="l", lines_removed="l", import_only="b")
SYMBOLS = _schema(name="s", file_id="l", kind="s", first_commit="l", last_commit="l")
EDGES = _schema(src="l", dst="l", kind="i", resolution="i")
EDGE_INTERVALS = _schema(src="l", dst="l", kind="i", born="l", died="l")
COCHANGE = _schema(a="l", b="l", n="l", w_support="d", w_decayed="d", conf_ab="d", conf_ba="d", lift="d", first_commit="l", last_commit="l")
GHOSTS = _schema(src="l", dst="l", kind="i", severed_commit="l", lifetime_days="l", cochanges_since="l", conf_since="d", score="d")
META = _schema(key="s", value="s")

TABLES = {
    "commits": COMMITS, "files": FILES, "file_paths": FILE_PATHS, "touches": TOUCHES, "symbols": SYMBOLS, "edges": EDGES,
    "edge_intervals": EDGE_INTERVALS, "cochange": COCHANGE, "ghosts": GHOSTS,
}
