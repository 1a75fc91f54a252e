"""A git repository as change events, through the git command line.

Commits are listed on the driver (one line each); diffs and blobs are read in the
tasks, which need the repository at the same path.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMMITS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("oid", T.StringType()), T.StructField("parent_oid", T.StringType()),
        T.StructField("author_time", T.LongType()), T.StructField("author", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("body", T.StringType()), T.StructField("is_merge", T.BooleanType()),
])
CHANGES = T.StructType([
    T.StructField("commit_id", T.LongType()), T.StructField("author_time", T.LongType()), T.StructField("change", T.StringType()),
        T.StructField("path", T.StringType()), T.StructField("old_path", T.StringType()),
    T.StructField("old_blob", T.StringType()), T.StructField("new_blob", T.StringType()), T.StructField("lines_added", T.LongType()),
        T.StructField("lines_removed", T.LongType()), T.StructField("changed_lines", T.ArrayType(T.StringType())),
])
BLOBS = T.StructType([T.StructField("blob_oid", T.StringType()), T.StructField("content", T.BinaryType())])
#: Changed lines are kept only for files with at most so many.
MAX_LINES = 4000
_EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=True).stdout


def open_repo(path: str) -> str:
    """The top of the repository that holds a path."""
    try:
        return git(path, "rev-parse", "--show-toplevel").decode().strip()
    except subprocess.CalledProcessError as e:
        raise FileNotFoundError(f"no repository at {path}") from e


def list_commits(repo: str, rev: str = "HEAD", first_parent: bool = True, hide: str | None = None, since: int | None = None) -> list[tuple]:
    """Oldest first, topological: (oid, parent, time, author, subject, body, is_merge)."""
    args = ["log", "-z", "--reverse", "--topo-order", "--format=%H%x1f%P%x1f%at%x1f%an%x1f%s%x1f%b",
        *(["--first-parent"] if first_parent else []), rev, *([f"^{hide}"] if hide else [])]
    out = []
    for entry in git(repo, *args).decode("utf-8", "replace").split("\0"):
        if entry.strip():
            oid, parents, at, author, subject, body = entry.split("\x1f")
            if since is None or int(at) >= since:
                p = parents.split()
                out.append((oid.strip(), p[0] if p else None, int(at), author, subject, body.strip(), len(p) > 1))
    return out


def scan_commits(spark: SparkSession, listed: list[tuple], first_id: int = 1) -> DataFrame:
    """The commits of `list_commits`, numbered from `first_id`."""
    return spark.createDataFrame([(first_id + i, *r) for i, r in enumerate(listed)], COMMITS)


def diff(repo: str, oid: str, parent: str | None, rename: float = 0.5) -> list[dict]:
    """Changes of one commit against its first parent, or against nothing."""
    base = ["diff-tree", "-r", f"-M{round(rename * 100)}%", "--no-commit-id", parent or _EMPTY_TREE, oid]
    fields = git(repo, *base, "--raw", "-z", "--abbrev=40").decode("utf-8", "replace").split("\0")
    out: dict[str, dict] = {}
    i = 0
    while i < len(fields) and fields[i].startswith(":"):
        old_mode, new_mode, old_blob, new_blob, status = fields[i][1:].split()
        kind = {"T": "M", "C": "A"}.get(status[0], status[0])
        pair = status[0] in "RC"
        path = fields[i + 2] if pair else fields[i + 1]
        old = fields[i + 1] if status[0] == "R" else None
        i += 3 if pair else 2
        if "160000" in (old_mode, new_mode) or kind not in "AMDR":
            continue
        out[path] = {"change": kind, "path": path, "old_path": old, "old_blob": old_blob, "new_blob": None if kind == "D" else new_blob,
            "lines_added": 0, "lines_removed": 0, "changed_lines": []}
    path, lines = None, []
    for raw in git(repo, *base, "-p", "-U0", "--no-color", "--src-prefix=a/", "--dst-prefix=b/").decode("utf-8", "replace").split("\n"):
        if raw.startswith("diff --git "):
            path, body = None, False
        elif raw.startswith("@@"):
            body = True
        elif not raw or path is None and not raw.startswith(("+++ ", "--- ")):
            continue
        elif not body and raw.startswith(("+++ ", "--- ")):
            name = raw[4:].rstrip("\t")
            if name != "/dev/null":
                path = name.strip('"')[2:]
                lines = out.get(path, {}).get("changed_lines", [])
        elif raw[0] in "+-" and path in out:
            out[path]["lines_added" if raw[0] == "+" else "lines_removed"] += 1
            lines.append(raw[1:].rstrip())
    for c in out.values():
        if c["lines_added"] + c["lines_removed"] > MAX_LINES:
            c["changed_lines"] = []
    return list(out.values())


def scan_diffs(commits: DataFrame, repo: str, rename: float = 0.5) -> DataFrame:
    """Changes of every commit; commits are spread over the tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"commit_id": i, "author_time": t, **c} for i, o, p,
                t in zip(b["id"], b["oid"], b["parent_oid"], b["author_time"], strict=True) for c in diff(repo, o, p if isinstance(p, str) else None, rename)]
            yield pd.DataFrame(rows, columns=CHANGES.names)

    return commits.select("id", "oid", "parent_oid", "author_time").repartition("id").mapInPandas(run, CHANGES)


def scan_tree(spark: SparkSession, repo: str, rev: str) -> DataFrame:
    """(path, blob) of every file in a commit's tree."""
    rows = []
    for entry in git(repo, "ls-tree", "-r", "-z", rev).decode("utf-8", "replace").split("\0"):
        if entry:
            head, path = entry.split("\t", 1)
            mode, kind, oid = head.split()
            if kind == "blob":
                rows.append((path, oid))
    return spark.createDataFrame(rows, "path string, blob string")


def scan_blobs(oids: DataFrame, repo: str) -> DataFrame:
    """(blob_oid, content) for a column blob_oid; one `cat-file --batch` a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            wanted = list(b["blob_oid"])
            raw, at, out = git(repo, "cat-file", "--batch", data="\n".join([*wanted, ""]).encode()), 0, []
            for oid in wanted:
                end = raw.index(b"\n", at)
                head = raw[at:end].split()
                if head[1] == b"missing":
                    at = end + 1
                    continue
                size = int(head[2])
                out.append((oid, raw[end + 1 : end + 1 + size]))
                at = end + 2 + size
            yield pd.DataFrame(out, columns=BLOBS.names)

    return oids.select("blob_oid").mapInPandas(run, BLOBS)


def head(repo: str) -> str:
    return git(repo, "rev-parse", "HEAD").decode().strip()
