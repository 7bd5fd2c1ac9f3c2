"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master, where it may be unset, one of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_sparkloom_root", None):
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc._sparkloom_root = f"file://{folder}"
    return sc._sparkloom_root


#: Where a session doesn't say how many bytes Python gets at once, this does, so that long texts don't make large batches.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


class Store:
    """Tables of one operator call. A lost executor costs a task's work only: what is saved here is read again from the shared folder.

    Operators drop what their results no longer read; the rest, in the folder sparkloom of the shared one, may go once the
    results are written.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        bound_batches(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/sparkloom/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns a frame that reads the written table."""
        df.write.parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(conf).delete(path, True)

    def bytes(self, name: str) -> int:
        """Size of a saved table as stored."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


#: A saved table is broadcast if its rows take up to this many bytes in memory; beyond, the same join shuffles.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32


def width(col: Column, kind: DataType) -> Column:
    """Bytes that a value takes in memory, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long") + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            each = F.transform(col, lambda x: width(x, kind.elementType))
            return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) + 24
        return F.greatest(F.size(col), F.lit(0)).cast("long") * 8 + 24
    if isinstance(kind, StructType):
        return sum((width(col[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def memory(df: DataFrame) -> int:
    """Bytes that the rows of df take in memory, about, as a broadcast would hold them."""
    each = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    return df.agg(F.sum(each)).first()[0] or 0


def small_side(df: DataFrame, store: Store, name: str) -> DataFrame:
    """df, the saved table of that name, with a broadcast hint if its size in memory allows that."""
    return F.broadcast(df) if store.bytes(name) <= BROADCAST_BYTES and memory(df) <= BROADCAST_BYTES else df


def parts(rows: int, per_task: int, least: int = 1) -> int:
    """Tasks for so many rows, so that a task's share has a bound at any size."""
    return max(least, -(-rows // per_task))


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function that in the end returns to the system what its worker has freed, as the worker lives on beside the JVM."""

    @wraps(run)
    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied
