"""The eight layout parsers: blocks in, blocks in reading order with separators out.

A parser turns pages upright, finds the order of its blocks and what parts them.
Order-dependent steps run page by page in one ``mapInArrow`` over whole pages (see
``page_layout``) that shares its shuffle with the windows before it. It also tells each block
what follows it, so that separators are plain expressions after it; only ``multi_none`` takes
a window for them. Input: the page's keys (doc_id and page, or
any others of any types), block_no, corners px..sy, text, score.
Output: the keys, block_no, seq (reading order from 0), region, line, para,
text, sep. Pages whose texts are all empty give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.geometry import upright
from pagewright.functions.text import separator
from pagewright.operators import groups, layout
from pagewright.plans.page_layout import Boxes, lines, paragraphs, regions

PAGE = ("doc_id", "page")
COLUMNS = ["block_no", "seq", "region", "line", "para", "x0", "y0", "x1", "y1", "text", "score"]
ORDERED = "block_no long, seq int, region int, line int, para int, x0 double, y0 double, x1 double, y1 double, text string, score double"


def _columns(b: Boxes, with_paragraphs: bool) -> tuple[list[int], list[int], list[int], list[int]]:
    """Reading order over columns, with region, line and para of each place; para counts paragraphs of the page, or is the block's own place."""
    order, region, para, last = [], [], [], 0
    for n, r in enumerate(regions(b)):
        order += r.boxes
        region += [n] * len(r.boxes)
        if with_paragraphs:
            of = {i: last + k for k, p in enumerate(paragraphs(b, r.boxes)) for i in p}
            last = max(of.values()) + 1
            para += [of[i] for i in r.boxes]
    return order, region, [0] * len(order), para if with_paragraphs else list(range(len(order)))


def _single(b: Boxes, with_paragraphs: bool) -> tuple[list[int], list[int], list[int], list[int]]:
    """Lines of one column; para counts paragraphs of lines."""
    found = lines(b)
    order = [i for line in found for i in line]
    line = [n for n, one in enumerate(found) for _ in one]
    para = line
    if with_paragraphs:
        hulls = [envelope(b, one) for one in found]
        h = Boxes(*map(list, zip(*hulls))) if hulls else Boxes([], [], [], [])
        of = {i: k for k, p in enumerate(paragraphs(h, list(range(len(found))))) for i in p}
        para = [of[n] for n in line]
    return order, [0] * len(order), line, para


def envelope(b: Boxes, line: list[int]) -> tuple[float, float, float, float]:
    """See ``operators.layout.line_envelopes``: right and bottom are the last box's."""
    top, last = min(b.y0[i] for i in line), line[-1]
    if len(line) == 1:
        return b.x0[last], top, b.x1[last], b.y1[last]
    return b.x0[line[0]], top, max(top, b.x1[last]), max(top, b.y1[last])


#: What a row knows of the one that its separator parts it from: its left edge and bottom if that is a block of the same line, and its first character.
FOLLOWING = {"__nx": "double", "__ny": "double", "__after": "string"}


def _in_paragraph(page: np.ndarray, line: np.ndarray, para: np.ndarray, y0: np.ndarray) -> np.ndarray:
    """The place of the block below in its paragraph, or -1. Blocks come by page and seq."""
    by = np.lexsort((np.arange(len(page)), y0, para, page))
    return _chained(by, (page, para))


def _chained(by: np.ndarray, same: Sequence[np.ndarray]) -> np.ndarray:
    out = np.full(len(by), -1, np.int64)
    goes_on = np.logical_and.reduce([c[by[1:]] == c[by[:-1]] for c in same])
    out[by[:-1][goes_on]] = by[1:][goes_on]
    return out


def _in_line(page: np.ndarray, line: np.ndarray, para: np.ndarray, y0: np.ndarray) -> np.ndarray:
    return _chained(np.arange(len(page)), (page, line))


def _in_page(page: np.ndarray, line: np.ndarray, para: np.ndarray, y0: np.ndarray) -> np.ndarray:
    return _chained(np.arange(len(page)), (page,))


def _in_lines_of_paragraph(page: np.ndarray, line: np.ndarray, para: np.ndarray, y0: np.ndarray) -> np.ndarray:
    """The next block of the line; from a line's last block, the first one of its paragraph's next line, by the lines' tops."""
    out = _in_line(page, line, para, y0)
    first = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (line[1:] != line[:-1])))
    by = np.lexsort((line[first], np.minimum.reduceat(y0, first), para[first], page[first]))
    below = _chained(by, (page[first], para[first]))
    last = np.append(first[1:], len(page)) - 1
    out[last] = np.where(below < 0, -1, first[below])
    return out


def _laid_out(batches: Iterator[pa.RecordBatch], how, with_paragraphs: bool, keys: Sequence[str], following=None) -> Iterator[pa.RecordBatch]:
    """Blocks in reading order from pages that come block by block; many pages to a batch."""
    for batch, bounds in groups.whole(batches, keys):
        by = np.lexsort((*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("block_no", "y0")), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
        batch = batch.take(pa.array(by))  # from top to bottom
        sides = [batch.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")]
        found: list[list[int]] = [[], [], [], [], [], []]  # page, place, seq, region, line, para
        for k, (first, last) in enumerate(pairwise(bounds.tolist())):
            order, *of = how(Boxes(*(side[first:last] for side in sides)), with_paragraphs)
            for column, values in zip(found, ([k] * len(order), [first + i for i in order], range(len(order)), *of)):
                column += values
        page, place, *numbers = (np.array(c, np.int64) for c in found)
        columns = {c: pa.array(v, pa.int32()) for c, v in zip(("seq", "region", "line", "para"), numbers)}
        columns |= {c: batch.column(c).take(pa.array(place)) for c in COLUMNS if c not in columns}
        if following:
            line, para = numbers[2], numbers[3]
            after = following(page, line, para, columns["y0"].to_numpy(zero_copy_only=False))
            at = pa.array(after, mask=after < 0)
            beside = pa.array(after, mask=(after < 0) | (line[after] != line) | (page[after] != page))
            columns |= {"__nx": columns["x0"].take(beside), "__ny": columns["y1"].take(beside), "__after": pc.utf8_slice_codeunits(columns["text"].take(at), 0, 1)}
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(place)) for c in keys), *columns.values()], [*keys, *columns]).select([*keys, *COLUMNS, *(FOLLOWING if following else ())])


def _ordered(blocks: DataFrame, how, with_paragraphs: bool, keys: Sequence[str], following=None) -> DataFrame:
    """Pages as the windows over them leave them, then a call for many of them. With ``following`` each row knows the one after it."""
    flat = upright(blocks, keys).select(*keys, F.col("block_no").cast("long").alias("block_no"), "x0", "y0", "x1", "y1", "text", "score")
    schema = T.StructType([flat.schema[c] for c in keys])
    for field in T.StructType.fromDDL(ORDERED + "".join(f", {c} {t}" for c, t in FOLLOWING.items() if following)):
        schema.add(field)
    # The windows have dealt and sorted pages by their keys, so that this moves and sorts nothing.
    return flat.sortWithinPartitions(*keys).mapInArrow(lambda b: _laid_out(b, how, with_paragraphs, keys, following), schema)


def _parted(ordered: DataFrame, by_gap: bool = True) -> DataFrame:
    """sep of rows that know the one after them: as in lines where that stands beside them, else by characters; a line end if there is none."""
    sep = layout.line_separator(F.col("__nx"), F.col("__ny"), F.col("__after")) if by_gap else F.when(F.col("__after").isNull(), "\n").otherwise(separator("text", "__after"))
    return ordered.withColumn("sep", sep).drop(*FOLLOWING)


def _next(column: str, keys: Sequence[str]) -> Column:
    return F.lead(column).over(Window.partitionBy(*keys).orderBy("seq"))


def none(blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """As they come; a missing separator is a line end."""
    return blocks.withColumn("seq", F.col("block_no").cast("int")).withColumn("sep", F.coalesce("sep", F.lit("\n")))


def multi_para(blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Columns, and natural paragraphs within them."""
    return _parted(_ordered(blocks, _columns, True, keys, _in_paragraph), by_gap=False)


def multi_line(blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Columns, every block a line."""
    return _ordered(blocks, _columns, False, keys).withColumn("sep", F.lit("\n"))


def multi_none(blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Columns, all in one paragraph."""
    after = _next("text", keys)
    return _ordered(blocks, _columns, False, keys).withColumn("sep", F.when(after.isNull(), "\n").otherwise(separator("text", after)))


def single_line(blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """One column of lines."""
    return _parted(_ordered(blocks, _single, False, keys, _in_line))


def single_none(blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """One column, lines joined."""
    return _parted(_ordered(blocks, _single, False, keys, _in_page))


def single_para(blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """One column, natural paragraphs: the paragraph's separator takes the place of the line's.

    Neighbours in a paragraph are by the envelopes' tops, which is the lines' order
    but for lines whose later boxes stand higher than their first.
    """
    return _parted(_ordered(blocks, _single, True, keys, _in_lines_of_paragraph))


def single_code(blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """One column of code: merged lines with their indents. Output: doc_id, page, line, box, text, score, level, sep."""
    merged = layout.code_lines(_ordered(blocks, _single, False, keys), (*keys, "line"), "seq")
    return layout.indented(merged, keys).withColumn("sep", F.lit("\n"))


PARSERS = {f.__name__: f for f in (none, multi_para, multi_line, multi_none, single_para, single_line, single_none, single_code)}


def parse(blocks: DataFrame, name: str = "multi_para", keys: Sequence[str] = PAGE) -> DataFrame:
    """A parser by name, over pages that ``keys`` tell apart; an unknown name is ``none``."""
    return PARSERS.get(name, none)(blocks, keys)
