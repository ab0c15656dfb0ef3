"""Texts put together from blocks: pages, documents, batches, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import separator
from pagewright.operators.order import scan

PAGE = ("doc_id", "page")


def joined(text: str | Column, order: Column, between: str = "") -> Column:
    """An aggregate: texts in the given order, one after the other; nulls are left out."""
    pairs = F.array_sort(F.collect_list(F.when((F.col(text) if isinstance(text, str) else text).isNotNull(), F.struct(order.alias("o"), (F.col(text) if isinstance(text, str) else text).alias("t")))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), between)


def with_separators(blocks: DataFrame, keys=PAGE, order: str = "block_no", last: str = "\n", name: str = "sep") -> DataFrame:
    """Each block with what parts it from the next one of its page; the last one gets ``last``."""
    after = F.lead("text").over(Window.partitionBy(*keys).orderBy(order))
    return blocks.withColumn(name, F.when(after.isNull(), last).otherwise(separator("text", after)))


def page_texts(blocks: DataFrame, keys=PAGE, order: str = "block_no", sep: str = "sep") -> DataFrame:
    """One text a page: blocks with their separators, none after the last block."""
    after = F.lead(order).over(Window.partitionBy(*keys).orderBy(order))
    piece = F.concat("text", F.when(after.isNull(), "").otherwise(F.coalesce(sep, F.lit(""))))
    return blocks.withColumn("__piece", piece).groupBy(*keys).agg(joined("__piece", F.col(order)).alias("text"), F.count(F.lit(1)).alias("n_blocks"))


def document_texts(pages: DataFrame, keys=("doc_id",), order: str = "page") -> DataFrame:
    """Page texts one after the other, nothing between them."""
    return pages.groupBy(*keys).agg(joined("text", F.col(order)).alias("text"), F.sum("n_blocks").alias("n_blocks"))


#: Fixed value: what a batch without any text says.
NO_TEXT = "[Message] No text in OCR result."


def batch_pieces(results: DataFrame, keys, order: str) -> DataFrame:
    """What each result adds to its batch's text, in a column ``piece``: its text or message, after a line end if the text so far lacks one.

    ``results`` has code and text: the text with its last separator, the message of a
    failure, or nothing for a blank one. Only the result just before can lack its line
    end, as a blank one would have had it put before itself. A sink writes the pieces in
    order; no row holds a whole batch. ``order`` tells the results of a batch apart.
    """
    text = F.when(F.col("code") == 101, "").otherwise(F.coalesce("text", F.lit("")))
    # The texts themselves don't take part in the scan, only whether they leave a line open.
    open_line = results.select(*keys, order, ((text != "") & ~text.endswith("\n")).alias("__open"))
    before = scan(open_line, keys, [order], __before=("before", "__open")).drop("__open")
    met = results.join(before, [*keys, order])
    return met.withColumn("piece", F.concat(F.when(F.col("__before"), "\n").otherwise(""), text)).drop("__before")


def batch_text(results: DataFrame, keys, order: str, empty: str = NO_TEXT) -> DataFrame:
    """``batch_pieces`` as one text a group, for groups as small as a document; ``empty`` if nothing was found."""
    out = batch_pieces(results, keys, order).groupBy(*keys).agg(joined("piece", F.col(order)).alias("text"))
    return out.withColumn("text", F.when(F.col("text") == "", empty).otherwise(F.col("text")))


def copied_pieces(results: DataFrame, keys, order: str) -> DataFrame:
    """What each text that isn't empty adds to a copy of all, in a column ``piece``; the line end depends on the place in the list, so an empty last one leaves a line end behind."""
    last = results.groupBy(*keys).agg(F.max(order).alias("__last"))
    ended = results.join(last, list(keys)).withColumn("piece", F.concat("text", F.when(F.col(order) == F.col("__last"), "").otherwise("\n")))
    return ended.filter("text <> ''").drop("__last")


def copied_text(results: DataFrame, keys, order: str) -> DataFrame:
    """``copied_pieces`` as one text a group, for groups as small as a document."""
    pieces = copied_pieces(results, keys, order).groupBy(*keys).agg(joined("piece", F.col(order)).alias("text"))
    return results.select(*keys).distinct().join(pieces, list(keys), "left").withColumn("text", F.coalesce("text", F.lit("")))


def span_texts(blocks: DataFrame, spans: DataFrame, keys, order: str = "seq", listed: bool = False) -> DataFrame:
    """The characters between two places (block, character) of each span's page.

    spans: the keys, span_id, left_block, left_char, right_block, right_char (from 0,
    the right one exclusive). A reversed span is swapped first. ``listed``: rows are
    results of a list, parted by line ends; empty ones are passed over.
    """
    if listed:
        blocks = blocks.filter("text <> ''").withColumn("sep", F.lit("\n"))
    swap = (F.col("left_block") > F.col("right_block")) | ((F.col("left_block") == F.col("right_block")) & (F.col("left_char") > F.col("right_char")))
    s = spans.select(*keys, "span_id", *[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(n) for n, a, b in (("li", "left_block", "right_block"), ("lt", "left_char", "right_char"), ("ri", "right_block", "left_block"), ("rt", "right_char", "left_char"))])
    hit = blocks.join(s, list(keys)).filter(F.col(order).between(F.col("li"), F.col("ri")))
    sep = F.coalesce("sep", F.lit(""))
    piece = (
        F.when((F.col(order) == F.col("li")) & (F.col(order) == F.col("ri")), F.expr("substring(text, lt + 1, rt - lt)"))
        .when(F.col(order) == F.col("li"), F.concat(F.expr("substring(text, lt + 1)"), sep))
        .when(F.col(order) == F.col("ri"), F.expr("substring(text, 1, rt)"))
        .otherwise(F.concat("text", sep))
    )
    return hit.withColumn("__piece", piece).groupBy(*keys, "span_id").agg(joined("__piece", F.col(order)).alias("text"))
