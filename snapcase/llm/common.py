"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from snapcase.session import shared_dir

# ASCII white space [\x20\x09-\x0D], as bytes.
BLANKS = b" \t\n\x0b\x0c\r"
# Bytes of rows, before compression, that one task writes of a table of known size.
FILE_BYTES = 16 << 20
# Rows of an Arrow batch, unless the session sets another number.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if not any(f.endswith("/snapcase.zip") for f in sc.listFiles):
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="snapcase-zip-")) / "snapcase"
        sc.addPyFile(shutil.make_archive(str(to), "zip", package.parent, package.name))


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python a few megabytes at a time, unless the session sets their number.

    Python workers live on from stage to stage, so the largest batch of any of them counts.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that neither side refers to any more.

    Its cleaner waits for a garbage collection of the driver, which small drivers' plans
    seldom cause.
    """
    gc.collect()
    spark._jvm.System.gc()


def run_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, *partition_by: str, rows: int | None = None,
           width: int = 32) -> DataFrame:
    """Write a table once and read it back: lineage ends here and its size is known.

    With ``rows``, the most rows it can have, at about ``width`` bytes each, a small table
    is written by as few tasks as its bytes and the cores call for, not one per shuffle
    partition; that number grows with the rows.
    """
    if rows is not None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        df = df.coalesce(max(cores, math.ceil(rows * width / FILE_BYTES)))
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist()
                         for n in names), strict=True)


class Emitter:
    """Collects output rows and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, max_rows: int = 4096, max_bytes: int = 8 << 20):
        self.schema, self.max_rows, self.max_bytes = schema, max_rows, max_bytes
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.size += size

    @property
    def full(self) -> bool:
        return len(self.rows) >= self.max_rows or self.size >= self.max_bytes

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (shift-multiply finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signed(h: int) -> int:
    """An unsigned 64-bit number as Spark's LongType holds it."""
    return h - (1 << 64) if h >= 1 << 63 else h


def added(docs: DataFrame, of: str, name: str, kind: pa.DataType,
          function: Callable[[list], Sequence]) -> tuple[DataFrame, str]:
    """``docs`` with one more column, computed from lists of the values of column ``of``.

    The column is called ``name``, with underscores added while that name is taken.
    """
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    at = docs.columns.index(of)

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array(function(batch.column(at).to_pylist()), type=kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, new],
                                             names=[*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, from_arrow_type(kind))])
    return docs.mapInArrow(extend, schema), name
