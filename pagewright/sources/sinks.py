"""Sinks: results as text, plain text, Markdown, CSV and JSON lines, and any number of them for one run.

Each format is a column of rendered lines (``lines_*``), which can be tested as
data, and a writer. Writers deal rows into ranges of job and order: a job's lines are its
folder's files one after the other by name, a small job has one, a large one as many
as its size asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions.text import quoted_lines
from pagewright.sources.files import write_files


# How each format words a failure, before and after code and message.
FAILED, FAILED_LOCAL = "[Error] OCR failed. Code: ", "【异常】OCR识别失败。"


def error_line(kind: str, code: Column, message: Column) -> Column:
    """A failure as each format words it: txt and md in two lines, csv in one."""
    said = F.concat(F.lit(FAILED), code.cast("string"), F.lit(", Msg: "), F.coalesce(message, F.lit("")))
    if kind == "txt":
        return F.concat(said, F.lit("\n" + FAILED_LOCAL + "\n"))
    if kind == "md":
        return F.concat(F.lit("> "), said, F.lit("  \n> " + FAILED_LOCAL + "  \n"))
    return F.concat(said, F.lit(" .\n"))


def with_header(lines: DataFrame, started: str, quoted: bool = False) -> DataFrame:
    """A first line for each job with the time it started and a blank line, at seq -1."""
    head = lines.select("job_id").distinct().select("job_id", F.lit(-1).alias("seq"), F.lit(("> " if quoted else "") + started + "\n\n").alias("line"))
    return lines.select("job_id", "seq", "line").unionByName(head)


def lines_txt(results: DataFrame) -> DataFrame:
    """line: title and text, the title alone for a blank page, or the failure; then a blank line."""
    title = F.concat(F.lit("≦ "), "name", F.lit(" ≧\n"))
    body = F.when(F.col("code") == 100, F.concat("text", F.lit("\n"))).when(F.col("code") == 101, "").otherwise(error_line("txt", F.col("code"), F.col("message")))
    return results.withColumn("line", F.concat(title, body, F.lit("\n")))


def lines_plain(results: DataFrame) -> DataFrame:
    """Texts of pages that have one, each ending in a line end."""
    return results.filter("code = 100").withColumn("line", F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))))


def lines_md(results: DataFrame) -> DataFrame:
    """A rule, an image and a link line, and the text quoted."""
    link = F.replace("path", F.lit(" "), F.lit("%20"))
    head = F.concat(F.lit("\n---\n!["), "name", F.lit("]("), link, F.lit(")\n["), "name", F.lit("]("), link, F.lit(")\n\n"))
    body = F.when(F.col("code") == 100, F.concat(quoted_lines(F.col("text")), F.lit("\n"))).when(F.col("code") == 101, "").otherwise(error_line("md", F.col("code"), F.col("message")))
    return results.withColumn("line", F.concat(head, body))


def rows_csv(results: DataFrame) -> DataFrame:
    """Name, OCR, Path."""
    text = F.when(F.col("code") == 100, F.col("text")).when(F.col("code") == 101, "").otherwise(error_line("csv", F.col("code"), F.col("message")))
    return results.select("*", F.col("name").alias("Name"), text.alias("OCR"), F.col("path").alias("Path")) if "name" not in results.columns else results.select(*[c for c in results.columns if c not in ("name", "path")], F.col("name").alias("Name"), text.alias("OCR"), F.col("path").alias("Path"))


#: Fixed value: the encodings a table may be saved in, the first one that holds all its text. (What a system calls its own code page is unknown to a cluster.)
ENCODINGS = ("ascii", "gbk", "big5", "shift_jis", "euc-kr", "utf-8")
#: A mask with a bit for each encoding.
ALL = (1 << len(ENCODINGS)) - 1


def mask_of(char: str) -> int:
    """The encodings that have the character, bit by bit."""
    mask = 0
    for i, name in enumerate(ENCODINGS):
        try:
            char.encode(name)
            mask |= 1 << i
        except UnicodeEncodeError:
            pass
    return mask


def encoding_masks(rows: DataFrame, text: Column, job: str = "job_id") -> DataFrame:
    """job and mask: the encodings that hold all characters of its texts. Only the different characters beyond ASCII of each job, few as they are, are tried."""
    chars = rows.select(job, F.explode(F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7F]", ""), ""))).alias("char")).filter("char <> ''").distinct()
    masks_of = F.pandas_udf(lambda c: c.map({x: mask_of(x) for x in c.unique()}).astype("int32"), T.IntegerType())
    masks = chars.withColumn("mask", masks_of("char")).groupBy(job).agg(F.bit_and("mask").alias("mask"))
    return rows.select(job).distinct().join(masks, job, "left").select(job, F.coalesce("mask", F.lit(ALL)).alias("mask"))


def encoding_name(mask: Column) -> Column:
    """The first encoding of a mask."""
    name = F.lit(ENCODINGS[-1])
    for i, e in reversed(list(enumerate(ENCODINGS[:-1]))):
        name = F.when(mask.bitwiseAND(1 << i) != 0, e).otherwise(name)
    return name


def lines_json(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The whole result as one JSON object a line; blank pages stay."""
    return results.withColumn("line", F.to_json(F.struct(*columns)))


def write_lines(lines: DataFrame, path: str, job: str = "job_id", order: str = "seq") -> None:
    """One folder a job, lines in order over its files by name."""
    dealt = lines.repartitionByRange(job, order).sortWithinPartitions(job, order)
    # Lines bring their own line ends.
    dealt.select(job, F.regexp_replace("line", r"\n\z", "").alias("value")).write.partitionBy(job).text(path)


def lines_single(results: DataFrame, ignore_blank: bool = True, *more: str) -> DataFrame:
    """out_name and text of each page's own file: its text, nothing for a blank page, or the failure. Blank pages and failures go if ``ignore_blank``."""
    kept = results.filter("code = 100") if ignore_blank else results
    body = F.when(F.col("code") == 100, F.col("text")).when(F.col("code") == 101, "").otherwise(error_line("txt", F.col("code"), F.col("message")))
    return kept.select("out_name", body.alias("value"), *more)


def single_name(path: str, name: str, beside_source: bool) -> Column:
    """Where a page's own text file goes: its path, or its name in the target folder, with another suffix."""
    return F.concat(F.regexp_replace(path if beside_source else name, r"(?<=[^/\\])\.[^./\\]*$", ""), F.lit(".txt"))


def write_single(results: DataFrame, path: str, ignore_blank: bool = True, order: str = "seq") -> None:
    """One file a page at ``out_name`` under ``path``, byte for byte its text, empty for a blank page. Of pages with one name the last one stays."""
    texts = lines_single(results.select("*", F.col(order).alias("__at")), ignore_blank, "__at")
    # Texts are sorted once, after they have moved; an aggregate of strings would sort them before as well.
    after = F.lead(F.lit(1)).over(Window.partitionBy("out_name").orderBy("__at"))
    last = texts.withColumn("__more", after).filter("__more IS NULL")
    write_files(last.select(F.col("out_name").alias("file"), F.col("value").alias("text"), F.lit("utf-8").alias("encoding")), path)


#: Fixed value: the header of a table.
HEADER = ("Name", "OCR", "Path")


def _field(c: Column) -> Column:
    """A value as CSV has it: in quotes where it has to be."""
    return F.when(c.isNull(), "").when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def lines_csv(results: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """job, seq, line and encoding: each job's table with its header at seq -1, in the first encoding that holds all of it."""
    rows = rows_csv(results).select(job, F.col(order).alias("seq"), *HEADER)
    everything = F.concat(*[F.coalesce(c, F.lit("")) for c in HEADER])
    encodings = encoding_masks(rows, everything, job).select(job, encoding_name(F.col("mask")).alias("encoding"))
    line = lambda cs: F.concat(*[x for i, c in enumerate(cs) for x in ([F.lit(",")] * (i > 0) + [_field(c)])], F.lit("\r\n"))
    head = encodings.select(job, F.lit(-1).cast(rows.schema["seq"].dataType).alias("seq"), line([F.lit(c) for c in HEADER]).alias("line"), "encoding")
    body = rows.select(job, "seq", line([F.col(c) for c in HEADER]).alias("line")).join(encodings, job)
    return head.unionByName(body)


def write_csv(results: DataFrame, path: str, job: str = "job_id", order: str = "seq") -> None:
    """CSV tables, one folder a job, in each job's own encoding: a job's table is its files one after the other by name."""
    dealt = lines_csv(results, job, order).repartitionByRange(job, "seq").sortWithinPartitions(job, "seq")
    file = F.format_string("%s=%s/part-%05d.csv", F.lit(job), F.col(job).cast("string"), F.spark_partition_id())
    write_files(dealt.select(file.alias("file"), F.col("line").alias("text"), "encoding"), path)


def _headed(lines: DataFrame, started: str | None, quoted: bool = False) -> DataFrame:
    return lines if started is None else with_header(lines, started, quoted)


#: Writers by name: (results, path, time the run started or None).
WRITERS = {
    "txt": lambda r, p, started: write_lines(_headed(lines_txt(r), started), p),
    "txtPlain": lambda r, p, _: write_lines(lines_plain(r), p),
    "txtIndividual": lambda r, p, _: write_single(r, p),
    "md": lambda r, p, started: write_lines(_headed(lines_md(r), started, quoted=True), p),
    "jsonl": lambda r, p, _: write_lines(lines_json(r, [c for c in r.columns if c != "seq"]), p),
    "csv": lambda r, p, _: write_csv(r, p),
}


def write_all(results: DataFrame, folder: str, formats: Sequence[str], started: str | None = None) -> None:
    """Every format sees every result; the results are computed once. ``started`` heads the formats that have a header."""
    kept = results.persist()
    try:
        for name in formats:
            WRITERS[name](kept, f"{folder}/{name}", started)
    finally:
        kept.unpersist()


def fan_out(results: DataFrame, folder: str, formats: Sequence[str], checkpoint: str) -> StreamingQuery:
    """A stream of results to all formats: each batch in a folder of its number, which appears when all of it is written; a repeated batch takes its place."""

    def write(batch: DataFrame, number: int) -> None:
        where, beside = f"{folder}/batch={number}", f"{folder}/_batch={number}"
        jvm = batch.sparkSession._jvm
        done, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (where, beside))
        fs = done.getFileSystem(batch.sparkSession._jsparkSession.sessionState().newHadoopConf())
        fs.delete(new, True)  # what a failed try left
        write_all(batch, beside, formats)
        fs.delete(done, True)
        fs.rename(new, done)

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
