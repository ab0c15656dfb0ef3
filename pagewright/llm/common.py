"""What the text operators share: tables of the input folder, stored tables, safe columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.storage import clear, saved, scratch, shared_folder, small_batches, written


__all__ = ["arrow_rows", "clear", "lower_ascii", "plain", "quoted", "row_key", "saved", "scratch", "shared_folder", "small_batches", "table", "unused", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Python stages planned and run inside get at most so many rows at a time: for rows that are large or come in pairs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator needs, so that extra columns with clashing names can do no harm."""
    small_batches(docs.sparkSession)
    return docs.select(*[docs[c] for c in columns])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(*columns: str | Column) -> Column:
    """A 64-bit key of a row's identity; nulls count as a value of their own."""
    return F.xxhash64(*columns)


def lower_ascii(text: str | Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
