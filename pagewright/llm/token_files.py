"""Operator 5: token ids in ORC files, for reading by stripe and by document.

``write`` sorts the documents by id into ranges, encodes them and writes one ORC
file a range: (doc_id, part, n_tokens, ids). ORC keeps the ids by integer
run-length encoding, row indexes with least and greatest doc_id every
``INDEX_ROWS`` rows, and a Bloom filter on doc_id for each of these, so that
readers split files by stripe and a look-up of one document reads one row group.

``index`` adds where each document starts: the sum of all before it, from one sum
for each file and a running sum inside each file.

Defined cases: null text counts as empty and holds the end token alone; null ids
come first; ties of ids are ordered by their text, and repeated rows follow each
other; extra columns are ignored; an empty table gives an empty result. A text of any
length is one row; it is encoded in parts (see ``tokens``), and its ids have to fit in
a task's memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import plain, scratch, table
from pagewright.llm.tokens import encoder, parts_of, vocabulary

END = 2
INDEX_ROWS = 1000
STRIPE_BYTES = 16 << 20
SCHEMA = "doc_id long, part int, row_no long, n_tokens long, ids array<int>"


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, row, base = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        for texts in parts_of(batch.column("text")):
            flat, at = encoder(path).encode_column(texts, end)
            n = len(texts)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int32)))
            ids = batch.column("doc_id").slice(row - base, n)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "part": pa.array(np.full(n, part, np.int32)), "row_no": pa.array(np.arange(row, row + n)), "n_tokens": pa.array(np.diff(at)), "ids": lists})
            row += n
        base = row


def write(docs: DataFrame, folder: str, path: str, end: int = END) -> None:
    """The token files of ``docs`` in ``folder``."""
    ranges = plain(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = ranges.mapInArrow(lambda b: _encode(b, path, end), SCHEMA)
    files.write.option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", INDEX_ROWS).option("orc.stripe.size", STRIPE_BYTES).option("orc.compress", "SNAPPY").orc(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(folder)


def look_up(spark: SparkSession, folder: str, doc_ids: Sequence[int]) -> DataFrame:
    """The rows of some documents: files and row groups whose least and greatest ids or Bloom filters exclude all of them aren't read."""
    return read(spark, folder).filter(F.col("doc_id").isin(*doc_ids))


def index(files: DataFrame) -> DataFrame:
    """part, row_no, start: how many ids stand before each document. The sums are read from the small columns only."""
    sizes = files.select("part", "row_no", "n_tokens")
    # One row a file, not a document, is summed in one task.
    sums = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("row_no")
    within = sizes.select("part", "row_no", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("inner"))
    return within.join(sums, "part").select("part", "row_no", (F.col("base") + F.col("inner")).alias("start"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, bounds = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.asarray(lists.offsets)
        view, bounds = memoryview(flat).cast("B"), bounds - bounds[0]
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "part": batch.column("part"), "row_no": batch.column("row_no"), "n_tokens": pa.array(np.diff(bounds).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})


def op5_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    folder = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder, path or vocabulary())
    files = read(spark, folder)
    digests = files.select("doc_id", "part", "row_no", "ids").mapInArrow(_digest, "doc_id long, part int, row_no long, n_tokens long, ids_crc32 long")
    return digests.join(index(files), ["part", "row_no"]).select("doc_id", "start", "n_tokens", "ids_crc32")
