"""Tables written to the cluster's shared folder, to cut lineage so that lost executors cost one stage at most; Arrow
batches of bounded size.

What a query writes lies in a folder of its application, which goes when the driver ends; tables that no later step reads
go before (`discard`).
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to a Python worker; one larger row travels alone.
BATCH_BYTES = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, in local tests a temporary folder set there once, on a
    cluster an error, as executors do not share their own folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def at(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path, as Hadoop knows them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


_record: ContextVar[list[str] | None] = ContextVar("record", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that `new_path` gives meanwhile in this thread."""
    mine: list[str] = []
    token = _record.set(mine)
    try:
        yield mine
    finally:
        _record.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    """A path that is not used yet, in the application's folder."""
    own = f"{shared_dir(spark)}/evtlake-{spark.sparkContext.applicationId}"
    system, where = at(spark, own)
    if not system.exists(where):
        system.mkdirs(where)
        system.deleteOnExit(where)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    if (record := _record.get()) is not None:
        record.append(path)
    return path


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        system, where = at(spark, path)
        system.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again; small row groups, as tasks hold one while they write."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.block.size", str(32 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` whose readers have all been written themselves."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/evtlake-" in folder:
                system, where = at(table.sparkSession, folder)
                system.delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded(df: DataFrame) -> DataFrame:
    """df, for mapInArrow: batches are cut by bytes as well as by rows (a setting of its session), as texts have any size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, for mapInArrow: at the end of a task its worker, which stays for later tasks, gives back the memory freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    """Returns the memory freed by this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
    if trim:
        trim(0)
