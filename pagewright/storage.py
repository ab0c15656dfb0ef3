"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where it is unset, a local session, which shares its disk, gets a temporary folder;
    on a cluster that would be each machine's own, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_on = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_on.get() if set_on.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_WRITTEN: list[str] = []
_OWN = threading.local()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clear`` removes what was written there."""
    path = f"{shared_folder(spark)}/pagewright-{name}-{uuid.uuid4().hex}"
    getattr(_OWN, "paths", _WRITTEN).append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What this thread writes inside goes at the end: for the batches of a stream, which would pile up."""
    before, _OWN.paths = getattr(_OWN, "paths", _WRITTEN), []
    try:
        yield
    finally:
        _remove(spark, _OWN.paths)
        _OWN.paths = before


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, never a recomputation,
    and the join strategy downstream is chosen by the size of what was written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many intermediate paths there are: what ``clear`` takes as ``since``."""
    return len(_WRITTEN)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Removes what was written from place ``since`` of the list on. Results that are still to be read from it go with it."""
    _remove(spark, _WRITTEN[since:])
    del _WRITTEN[since:]


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The JVM's file system of a path, and the path there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, where = _hadoop(spark, path)
        fs.delete(where, True)


def made(spark: SparkSession, path: str) -> str:
    """``path``, a folder that is there now."""
    fs, where = _hadoop(spark, path)
    fs.mkdirs(where)
    return path


def append_tables(rows: DataFrame, path: str, table: str) -> None:
    """Adds a Parquet file to the folder ``path`` for each value of the column ``table``, in its order, which streams of the folder keep: their times ascend, and their names. Tasks write them; the driver knows files by their names alone. Each appears whole; one caller at a time may add."""
    spark = rows.sparkSession
    fs, where = _hadoop(spark, path)
    new = f"{path}/_{uuid.uuid4().hex}"  # readers pass over names that begin so
    try:
        rows.repartition(table).sortWithinPartitions(table).write.partitionBy(table).parquet(new)
        there = [(int(f.getPath().getName().partition(".")[0]), f.getModificationTime()) for f in fs.listStatus(where) if not f.getPath().getName().startswith("_")]
        number = max((n for n, _ in there), default=-1) + 1
        time = max([spark._jvm.System.currentTimeMillis(), *(t + 1 for _, t in there)])
        files = [f.getPath() for f in fs.globStatus(_hadoop(spark, f"{new}/{table}=*/part-*")[1]) or ()]
        for i, file in enumerate(sorted(files, key=lambda f: int(f.getParent().getName().partition("=")[2]))):
            fs.setTimes(file, time + i, -1)
            if not fs.rename(file, _hadoop(spark, f"{path}/{number + i:09d}.parquet")[1]):
                raise OSError(f"{file.toString()} could not be moved")
    finally:
        _remove(spark, [new])


#: Rows go to Python tasks in batches of about so many bytes, unless the session has a limit of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python task and its JVM hold at a time by bytes; a row count bounds nothing where texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)
