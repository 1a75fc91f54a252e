"""Shared plumbing: reading tables, Arrow batch maps, shared-folder tables and text rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes handed to Python at once, whichever comes first; long texts make large rows.
ROWS_PER_BATCH, BYTES_PER_BATCH = 4096, 4 << 20

def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small for the Python operators that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: str | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` of a text as UTF-8; none for a null. `bytes.split` parts at just these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_columns(df: DataFrame, columns: list[str | Column], make: Callable[[], Callable], schema: StructType) -> DataFrame:
    """Apply a per-batch function of Python lists to the named columns only.

    `make` runs once in each task and returns a function that takes one list per
    column and returns one list (or Arrow array) per field of `schema`.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if b.num_rows:
                out = fn(*(c.to_pylist() for c in b.columns))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`; in local mode without it, a temporary one."""
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return "file://" + os.path.join(tempfile.gettempdir(), f"driftline-{spark.sparkContext.applicationId}")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write as Parquet to the shared folder and read that back.

    Executors may then be lost without recomputing what came before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of `materialise` that nothing reads any more."""
    if path := getattr(df, "_shared_path", None):
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % modulus


def uniform(*cols: str, seed: int = 7) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")
