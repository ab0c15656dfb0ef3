"""Sources: files by suffix, JSON-lines results, structured logs, base-64 payloads, native text lines."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions.text import separator
from pagewright.operators.assembly import joined
from pagewright.operators.filters import DOCUMENT_SUFFIXES, IMAGE_SUFFIXES
from pagewright.operators.order import numbered
from pagewright.sources.files import LISTED, list_files, open_file, spread
from pagewright.sources.sinks import HEADER
from pagewright.storage import append_tables, made, saved, small_batches, temporary

#: Rows of a table, or blocks, that a task hands on at a time.
ROWS = 4096

#: One block of a recognised page, as results carry it.
BLOCK = T.StructType([T.StructField("box", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("end", T.StringType())])
RESULT = "code INT, data STRING, score DOUBLE, time DOUBLE, timestamp DOUBLE, path STRING, fileName STRING, dir STRING, page INT"
LOG = "time STRING, level STRING, message STRING, filename STRING, lineno INT, module STRING, funcName STRING, exc_text STRING, stack_info STRING, thread LONG, threadName STRING, process LONG, processName STRING, name STRING"
SEVERITY = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def _of_family(found: DataFrame, family: str) -> DataFrame:
    """Files with a suffix of the family, in any case."""
    suffixes = IMAGE_SUFFIXES if family == "image" else DOCUMENT_SUFFIXES
    return found.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))


def find_files(spark: SparkSession, paths: str | Sequence[str], family: str = "image", recursive: bool = True) -> DataFrame:
    """path, length, modified of the files with a suffix of the family. Tasks list the folders below the given ones; no content is read."""
    found = list_files(spark, paths, recursive)
    return _of_family(found.withColumn("path", F.translate("path", "\\", "/")), family)


def note_files(spark: SparkSession, folder: str, log: str, family: str = "image", each: int = 1000) -> None:
    """Adds to ``log`` what ``find_files`` finds and the log doesn't have yet, older files first: a table of path, length and modified for each ``each`` files.

    Tasks list, compare and write; the driver sees the tables' names, no file. A file is
    noted once, by its path, and not while it lies in a writer's ``_temporary`` folder. One
    caller at a time may add to a log.
    """
    with temporary(spark):
        listed = list_files(spark, folder).filter(~F.substr("path", F.lit(len(folder.rstrip("/")) + 1)).contains("/_temporary"))
        found = saved(_of_family(listed.withColumn("path", F.translate("path", "\\", "/")), family), "listed")
        noted = spark.read.schema(LISTED).parquet(made(spark, log))
        # A broadcast would pass what has been noted through the driver.
        new = found.join(noted.select("path").hint("merge"), "path", "left_anti")
        batch = F.floor((F.col("place") - 1) / each)
        append_tables(numbered(new, [], ["modified", "path"], "place").select(*found.columns, batch.alias("batch")), log, "batch")


def watch_files(spark: SparkSession, folder: str, family: str = "image", each: int = 1000, log: str | None = None) -> DataFrame:
    """``find_files`` as a stream: at most ``each`` new files a batch.

    With ``log``, a folder of its own, what has come is noted there now (``note_files``), and
    the stream follows the log: the driver's memory grows with the batches alone. A run
    with the same log and checkpoint goes on after what has been taken. For files that come
    while the stream runs, ``note_files`` has to be called again.

    Without it this is Spark's stream of the folder, which looks by itself before each
    batch, and for stores that only Spark reads: its driver lists all files and remembers
    each path. Empty files and names that begin with _ or . aren't seen.
    """
    if log:
        note_files(spark, folder, log, family, each)
        return spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).parquet(log)
    schema = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", each).option("recursiveFileLookup", True).load(folder)
    return _of_family(found.select(F.translate("path", "\\", "/").alias("path"), "length", F.col("modificationTime").alias("modified")), family)


def discover(found: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, progressed: Callable[[int, int, str | None], None] | None = None, every: int | None = None) -> StreamingQuery:
    """Runs a stream of found files to its end. ``take`` gets each batch and its number; ``progressed`` then gets the batch's number, how many files have been found so far, and the last path of the batch.

    A batch is counted while it is taken, by an observation of its rows, not by reading it again.
    With ``every``, progress is told in steps of so many files (by path; a batch's last one may
    have fewer), numbered over all batches: a stream may take many steps in one batch, which costs far less
    than a batch for each.
    """
    so_far = step = 0

    def handle(batch: DataFrame, number: int) -> None:
        nonlocal so_far, step
        if every and progressed:
            kept = batch.persist()  # paths, sizes and times; the files are looked at once
            try:
                take(kept, number)
                with temporary(batch.sparkSession):
                    steps = numbered(kept.select("path"), [], ["path"], "place").groupBy(F.floor((F.col("place") - 1) / every).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("last")).collect()
            finally:
                kept.unpersist()
            for r in sorted(steps, key=lambda r: r["step"]):
                so_far += r["n"]
                progressed(step, so_far, r["last"])
                step += 1
            return
        seen = Observation()
        take(batch.observe(seen, F.count(F.lit(1)).alias("n"), F.max("path").alias("last")), number)
        so_far += seen.get["n"]
        if progressed:
            progressed(number, so_far, seen.get["last"])

    return found.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results from JSON lines; the union of block list and message is two columns."""
    r = spark.read.schema(RESULT).json(path)
    return r.select("*", F.when(F.col("code") == 100, F.from_json("data", T.ArrayType(BLOCK))).alias("blocks"), F.when(F.col("code") != 100, F.col("data")).alias("message")).drop("data")


def read_tables(spark: SparkSession, path: str, encodings: DataFrame, job: str = "job_id") -> DataFrame:
    """The rows of CSV tables as ``sinks.write_csv`` leaves them, each job's files by the encoding that ``encodings`` has for it; headers are left out. Files are read as streams, ``ROWS`` rows at a time, whatever their size."""
    files = spread(list_files(spark, path).select("path"))
    coded = files.select("path", F.regexp_extract("path", rf"/{job}=([^/]*)/", 1).alias("job")).join(encodings.select(F.col(job).cast("string").alias("job"), "encoding").hint("broadcast"), "job")

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for frame in frames:
            for name, path, encoding in zip(frame["job"], frame["path"], frame["encoding"]):
                with open_file(path) as file:
                    rows = ([name, *r] for r in csv.reader(io.TextIOWrapper(file, encoding=encoding, newline="")) if r != list(HEADER))
                    while some := list(islice(rows, ROWS)):
                        yield pd.DataFrame(some, columns=["job", *HEADER])

    out = coded.mapInPandas(parsed, "job string, " + ", ".join(f"{c} string" for c in HEADER))
    return out.select(F.col("job").cast(encodings.schema[job].dataType).alias(job), *HEADER)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def log_threshold(logs: DataFrame, least: str, ignored: DataFrame | None = None, by: str = "module") -> DataFrame:
    """Lines at or above a level, without those of ignored modules."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("level"))
    out = logs.filter(rank >= SEVERITY.index(least) + 1)
    return out if ignored is None else out.join(ignored.select(by), by, "left_anti")


def decode_payload(rows: DataFrame, column: str = "data") -> DataFrame:
    """bytes from base 64, and code 202 for what isn't base 64."""
    data = F.try_to_binary(column, F.lit("base64"))
    return rows.withColumn("bytes", data).withColumn("code", F.when(F.col(column).isNotNull() & F.col("bytes").isNull(), 202))


def native_lines(spans: DataFrame, page: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Lines from text spans (group, line_no, span_no, text): a line that isn't empty ends with a line end if it is its group's last line, else with what parts it from the next line of the page.

    "Last" counts empty lines too, so an empty last line leaves the one before without
    a line end.
    """
    lines = spans.groupBy(*page, "group", "line_no").agg(joined("text", F.col("span_no")).alias("text"))
    lines = lines.withColumn("__last", F.col("line_no") == F.max("line_no").over(Window.partitionBy(*page, "group"))).filter("text <> ''")
    after = F.lead("text").over(Window.partitionBy(*page).orderBy("group", "line_no"))
    sep = F.when(F.col("__last") | after.isNull(), "\n").otherwise(separator("text", after))
    return lines.withColumn("sep", sep).drop("__last").withColumns({"score": F.lit(1.0), "origin": F.lit("text")})


def recognise(files: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """Blocks of binary files by a recogniser that the user supplies.

    ``load`` makes the recogniser, once a partition; it takes the bytes of a page and
    returns dicts of text, score, x0, y0, x1, y1. A page it fails on is one row with
    code 902 and the message; a page without text is one row with code 101.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recogniser = load()
        columns, rows = ["path", "code", "message", "block_no", "text", "score", "x0", "y0", "x1", "y1"], []
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    found = recogniser(content)
                except Exception as error:  # the recogniser is foreign code; its failure is a result
                    rows.append((path, 902, f"[Error] {error}", None, None, None, None, None, None, None))
                    continue
                rows += [(path, 100, None, i, b["text"], b["score"], b["x0"], b["y0"], b["x1"], b["y1"]) for i, b in enumerate(found)] or [(path, 101, None, None, None, None, None, None, None, None)]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, code int, message string, block_no double, text string, score double, x0 double, y0 double, x1 double, y1 double").withColumn("block_no", F.col("block_no").cast("int"))
