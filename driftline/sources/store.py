"""A history kept as a directory of Parquet tables with a small JSON side file, and tables in the shared folder."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.model import TABLES

VERSION = 2
_META = "_meta.json"
#: Rows of a shuffle that a task gets at most on average; rows of a table that goes to every task at most.
ROWS, FEW = 400_000, 1_000_000


class IndexMissing(FileNotFoundError):
    """There is no store at this place."""


class SchemaMismatch(ValueError):
    """The store was written by another version; build it again."""


class FileNotInHistory(KeyError):
    """No file of the history ever had this path."""


def shared_table(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared folder and read back, so nothing before is ever computed again."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"driftline-{spark.sparkContext.applicationId}")
    path = f"{at.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, rows: int) -> int:
    """Over how many tasks to spread so many rows: what one holds doesn't grow with the table."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // ROWS), min(usual, -(-rows // (ROWS // 20))))


def clock(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `id`: 1, 2, ... in that order, which should leave no ties.

    Rows are cut into ranges of the order, numbered within each as they are written
    and offset by the sizes of the ranges before; only those sizes reach the driver.
    """
    ranged = rows.repartitionByRange(tasks(rows.sparkSession, rows.count()), *order).sortWithinPartitions(*order)
    cut = shared_table(ranged.withColumn("_n", F.monotonically_increasing_id()))
    at = F.shiftright("_n", 33)
    sizes = dict(cut.groupBy(at).count().collect())
    before = list(accumulate((sizes.get(r, 0) for r in range(max(sizes, default=0))), initial=0))
    inside = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    return cut.withColumn("id", F.get(F.lit(before).cast("array<bigint>"), at.cast("int")) + inside + 1).drop("_n")


def small(df: DataFrame) -> DataFrame:
    """`df`, sent to every task if it has few rows; it should be cheap to count."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


class _Folder:
    """A folder on whatever file system Spark reads it from."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._at(""))]

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Store:
    """Tables by name in a generation under one folder; the side file names the generation that counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.folder = _Folder(spark, path)
        if not self.folder.has(_META):
            raise IndexMissing(path)
        self.meta: dict[str, str] = json.loads(self.folder.read(_META))
        if self.meta.get("schema_version") != str(VERSION):
            raise SchemaMismatch(f"{path} has schema {self.meta.get('schema_version')}, this is {VERSION}")

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return _Folder(spark, path).has(_META)

    @classmethod
    def write(cls, spark: SparkSession, path: str, tables: dict[str, DataFrame], meta: dict[str, str]) -> Store:
        """Write a new generation, then the side file that names it, in one put: a failed run leaves the old store.

        No folder is renamed, so object storage will do. The generation before stays
        for those who read it, until the next one comes.
        """
        folder, new = _Folder(spark, path), f"gen-{uuid.uuid4().hex}"
        before = json.loads(folder.read(_META)).get("generation") if folder.has(_META) else None
        for name, df in tables.items():
            df.write.parquet(f"{path}/{new}/{name}")
        folder.write(_META, json.dumps(meta | {"schema_version": str(VERSION), "generation": new}))
        for name in folder.names():
            if name.startswith("gen-") and name not in (new, before):
                folder.drop(name)
        return cls(spark, path)

    @staticmethod
    def find(start: str, name: str = ".driftline") -> str:
        """The nearest store upward of a folder."""
        at = os.path.abspath(start)
        while True:
            if os.path.exists(os.path.join(at, name, _META)):
                return os.path.join(at, name)
            if at == os.path.dirname(at):
                raise IndexMissing(start)
            at = os.path.dirname(at)

    def has(self, name: str) -> bool:
        return self.folder.has(f"{self.meta['generation']}/{name}")

    def table(self, name: str) -> DataFrame:
        if not self.has(name):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.parquet(f"{self.path}/{self.meta['generation']}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in TABLES}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` wins over `old` on the keys; within `new` the highest `seq` wins if there is one."""
    if "seq" in new.columns:
        rest = [c for c in new.columns if c not in (*keys, "seq")]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select(*keys, "_r.*")
    return old.join(new, keys, "left_anti").unionByName(new)


def missing_blobs(wanted: DataFrame, parsed: DataFrame, version: int) -> DataFrame:
    """Blobs that no parse of this version covers; each once, the all-zero id never."""
    have = parsed.where(F.col("parser_version") == version).select("blob_oid")
    return wanted.where(~F.col("blob_oid").rlike("^0*$")).dropDuplicates(["blob_oid"]).join(have, "blob_oid", "left_anti")


def resolve_paths(wanted: DataFrame, files: DataFrame, file_paths: DataFrame) -> DataFrame:
    """(path, file_id): the file that has a path now, else the last that had it; leading `./` is ignored."""
    ask = wanted.select("path", F.regexp_replace("path", r"^(\./)+", "").alias("_p"))
    now = files.where("current_path IS NOT NULL").groupBy(F.col("current_path").alias("_p")).agg(F.min("id").alias("now"))
    then = file_paths.groupBy(F.col("path").alias("_p")).agg(F.max_by("file_id", F.struct("from_commit", "file_id")).alias("then"))
    return ask.join(now, "_p", "left").join(then, "_p", "left").select("path", F.coalesce("now", "then").alias("file_id"))


def display_paths(files: DataFrame, file_paths: DataFrame) -> DataFrame:
    """(id, path): the current path, else the last one, else `<file N>`."""
    last = file_paths.groupBy(F.col("file_id").alias("id")).agg(F.max_by("path", "from_commit").alias("last"))
    return files.join(last, "id", "left").select("id", F.coalesce("current_path", "last", F.format_string("<file %d>", "id")).alias("path"))


def commit_as_of(commits: DataFrame, rev: str) -> int:
    """Id of the last commit on or before a date (YYYY-MM-DD), or of the one whose id starts with `rev`."""
    import re

    if re.fullmatch(r"\d{4}-\d\d-\d\d", rev):
        day = F.date_format(F.timestamp_seconds("author_time"), "yyyy-MM-dd")
        found = commits.where(day <= rev).agg(F.max("id")).first()[0]
        if found is None:
            raise LookupError(f"no commit on or before {rev}")
        return found
    hits = [r[0] for r in commits.where(F.col("oid").startswith(rev)).select("id").limit(2).collect()]
    if len(hits) != 1:
        raise LookupError(f"{rev} is {'ambiguous' if hits else 'unknown'}")
    return hits[0]
