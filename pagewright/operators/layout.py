"""Layout steps over blocks: margins, rows, gaps, separators, paragraph bodies, envelopes, indents.

Pages are independent, and every window and grouping here has the page's keys
first, so that a chain of these steps shuffles once. What needs a fold with a state
(rows with their gaps, paragraph bodies, lines of code) runs over a page's sorted blocks,
many pages to an Arrow batch; all else are Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagewright.functions.text import separator
from pagewright.operators import groups

PAGE = ("doc_id", "page")


def margins(blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Left and right edge of each page's blocks, one unit outside them."""
    return blocks.groupBy(*keys).agg((F.min("x0") - 1).alias("left"), (F.max("x1") + 1).alias("right"))


def _folded(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], name: str, fold: Callable[..., list[int]], carry: Sequence[str] = ()) -> DataFrame:
    """keys, order, ``carry`` and a number of every row: ``fold`` gets the ``columns`` of one group's rows from top to bottom. Many groups come in a batch."""
    held = list(dict.fromkeys([*keys, "y0", order, *columns, *carry]))
    schema = T.StructType([*(rows.schema[c] for c in keys), T.StructField(order, T.LongType()), *(rows.schema[c] for c in carry), T.StructField(name, T.IntegerType())])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in groups.whole(batches, keys):
            sides = [batch.column(c).to_pylist() for c in columns]
            numbers = [n for a, z in pairwise(bounds.tolist()) for n in fold(*(side[a:z] for side in sides))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column(order).cast(pa.int64()), *(batch.column(c) for c in carry), pa.array(numbers, pa.int32())], schema.names)

    return groups.dealt(rows.select(*held), keys, ["y0", order]).mapInArrow(folded, schema)


def _row_numbers(y0: list[float], y1: list[float]) -> list[int]:
    row, floor, out = -1, float("-inf"), []
    for top, bottom in zip(y0, y1):
        if top > floor:
            row, floor = row + 1, bottom
        out.append(row)
    return out


def page_rows(blocks: DataFrame, keys: Sequence[str] = PAGE, order: str = "block_no", carry: Sequence[str] = ()) -> DataFrame:
    """row of every block: a row opens at its top block and takes what follows down to that block's bottom edge.

    Later blocks don't extend the row, so this is a fold and not gaps and islands. Columns
    to ``carry`` come along.
    """
    return _folded(blocks, keys, order, ("y0", "y1"), "row", _row_numbers, carry)


def row_gaps(blocks: DataFrame, keys: Sequence[str] = PAGE, order: str = "block_no") -> DataFrame:
    """Uncovered stretches of every row between the page's margins, from left to right; the last one always counts.

    Without a column row, rows are found on the way, in the same pass over a page's blocks.
    """
    known = "row" in blocks.columns
    held = list(dict.fromkeys([*keys, *(("row",) if known else ("y0", "y1")), "x0", "x1", order]))
    edge = blocks.select(F.greatest(F.col("x0") - 1, F.col("x1")).alias("e")).schema["e"].dataType
    schema = T.StructType([*(blocks.schema[c] for c in keys), blocks.schema["row"] if known else T.StructField("row", T.IntegerType()), T.StructField("gap_left", edge), T.StructField("gap_right", edge)])

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in groups.whole(batches, keys):
            if known:
                row = batch.column("row").to_numpy(zero_copy_only=False)
            else:
                sides = [batch.column(c).to_pylist() for c in ("y0", "y1")]
                row = np.array([n for a, z in pairwise(bounds.tolist()) for n in _row_numbers(*(side[a:z] for side in sides))])
            page = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            x0, x1, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x0", "x1", order))
            left, right = np.minimum.reduceat(x0, bounds[:-1]) - 1, np.maximum.reduceat(x1, bounds[:-1]) + 1
            by = np.lexsort((at, x1, x0, row, page))
            page, row, x0, x1 = page[by], row[by], x0[by], x1[by]
            first = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (row[1:] != row[:-1])))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
            # Running maxima by the ranks of right edges, each row's above those of the row before.
            edges, rank = np.unique(x1, return_inverse=True)
            reached = edges[np.maximum.accumulate(rank + group * len(edges)) - group * len(edges)]
            reach = left[page]
            inside = np.flatnonzero(np.append(False, group[1:] == group[:-1]))
            reach[inside] = np.maximum(reach[inside], reached[inside - 1])
            free, last = np.flatnonzero(x0 > reach), np.append(first[1:], len(row)) - 1
            of = pa.array(bounds[page[np.append(free, last)]])
            found = [row[np.append(free, last)], np.append(reach[free], reached[last]), np.append(x0[free], right[page[last]])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *(pa.array(v).cast(t) for v, t in zip(found, types))], schema.names)

    types = [to_arrow_type(f.dataType) for f in schema.fields[len(keys) :]]
    return groups.dealt(blocks.select(*held), keys, ["row" if known else "y0", order]).mapInArrow(gaps, schema)


def line_separators(fragments: DataFrame, keys: Sequence[str] = (*PAGE, "line_id"), order: str = "frag_no") -> DataFrame:
    """sep within lines: a space across a wide gap, else by characters; a line end after the last one.

    The height that "wide" refers to is half of (both bottoms less this top less the
    neighbour's *left*): the left edge stands where a top is to be expected, and is
    kept so that results stay the same.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return fragments.withColumn("sep", line_separator(F.lead("x0").over(w), F.lead("y1").over(w), F.lead("text").over(w)))


def line_separator(nx: Column, ny: Column, nt: Column) -> Column:
    """``line_separators`` from the neighbour's left edge, bottom and text; without an edge, by characters alone."""
    height = (F.col("y1") + ny - F.col("y0") - nx) * 0.5
    return F.when(nt.isNull(), "\n").when(nx - F.col("x1") > height * 1.5, " ").otherwise(separator("text", nt))


def paragraph_bodies(lines: DataFrame, keys: Sequence[str], order: str = "block_no", tolerance: float = 1.2) -> DataFrame:
    """para of every line of a region, from 0: lines whose edges keep to the paragraph's and whose spacing isn't larger.

    Edges, height and spacing of a paragraph are running means of the mean so far and
    the new line.
    """
    return _folded(lines, keys, order, ("x0", "y0", "x1", "y1"), "para", lambda *sides: _body_numbers(tolerance, *sides))


def _body_numbers(tolerance: float, x0: list[float], y0: list[float], x1: list[float], y1: list[float]) -> list[int]:
    para, left, right, height, space, bottom, out = -1, 0.0, 0.0, 0.0, None, 0.0, []
    for l, t, r, b in zip(x0, y0, x1, y1):
        h, gap = b - t, t - bottom
        if para >= 0 and abs(left - l) <= height * tolerance and abs(right - r) <= height * tolerance and (space is None or gap < space + height * 0.5):
            left, right, height = (left + l) / 2, (right + r) / 2, (height + h) / 2
            space = gap if space is None else (space + gap) / 2
        else:
            para, left, right, height, space = para + 1, l, r, h, None
        bottom = b
        out.append(para)
    return out


def paragraph_ends(lines: DataFrame, keys: Sequence[str], order: Sequence[str] = ("y0", "block_no")) -> DataFrame:
    """sep of every line: by characters inside a paragraph, a line end after its last line. ``lines`` has para."""
    after = F.lead("text").over(Window.partitionBy(*keys, "para").orderBy(*order))
    return lines.withColumn("sep", F.when(after.isNull(), "\n").otherwise(separator("text", after)))


def line_envelopes(fragments: DataFrame, keys: Sequence[str] = (*PAGE, "line_id"), order: str = "frag_no") -> DataFrame:
    """One box and two characters a line, as paragraphs take them.

    Left is the first block's, top the least; right and bottom are those of the last
    block (or the top, if that is larger), not the largest, and are kept so.
    """
    first, last = (lambda c: F.min_by(c, order)), (lambda c: F.max_by(c, order))
    top = F.min("y0")
    several = F.count(F.lit(1)) > 1
    return fragments.groupBy(*keys).agg(
        first("x0").alias("x0"), top.alias("y0"),
        F.when(several, F.greatest(top, last("x1"))).otherwise(last("x1")).alias("x1"),
        F.when(several, F.greatest(top, last("y1"))).otherwise(last("y1")).alias("y1"),
        F.concat(F.left(first("text"), F.lit(1)), F.right(last("text"), F.lit(1))).alias("text"),
    )


def code_lines(fragments: DataFrame, keys: Sequence[str] = (*PAGE, "line_id"), order: str = "frag_no") -> DataFrame:
    """Lines of code: blocks side by side with two spaces for each running height between them; the envelope; the mean score."""
    sides = ("x0", "y0", "x1", "y1", "score")
    held = list(dict.fromkeys([*keys, order, *sides, "text"]))
    schema = T.StructType([*(fragments.schema[c] for c in keys), *(T.StructField(c, T.DoubleType()) for c in sides[:4]), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in groups.whole(batches, keys):
            x0, y0, x1, y1, score = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in sides)
            first, size = bounds[:-1], np.diff(bounds)
            box, h, total = [a[first] for a in (x0, y0, x1, y1)], y1[first] - y0[first], score[first]
            spaces = np.zeros(batch.num_rows, np.int64)
            lines, k = np.flatnonzero(size > 1), 1
            while len(lines):  # the k-th blocks of all lines that have one
                at = first[lines] + k
                h[lines] = (h[lines] + y1[at] - y0[at]) / 2
                gap = x0[at] - box[2][lines]
                with np.errstate(divide="ignore", invalid="ignore"):
                    wide = np.rint(gap / h[lines])
                spaces[at] = np.where(gap > 0, np.clip(np.nan_to_num(wide), 0, 2**31 - 1), 0)
                for n, (side, better) in enumerate(((x0, np.minimum), (y0, np.minimum), (x1, np.maximum), (y1, np.maximum))):
                    box[n][lines] = better(box[n][lines], side[at])
                total[lines] += score[at]
                k += 1
                lines = lines[size[lines] > k]
            pieces = pc.binary_join_element_wise(pc.binary_repeat(pa.array(["  "] * batch.num_rows), pa.array(spaces)), batch.column("text"), "")
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces), "")
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in keys), *map(pa.array, box), text, pa.array(total / size)], schema.names)

    return groups.dealt(fragments.select(*held), keys, [order]).mapInArrow(merged, schema)


def indented(lines: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Lines with two spaces for each indent level, their left edge at the page's; level is a column.

    Levels lie one mean line height apart from the least left edge to below the
    largest; with all left edges equal there is none, and the level is -1.
    """
    page = Window.partitionBy(*keys)
    b = lines.withColumns({"__h": F.avg(F.col("y1") - F.col("y0")).over(page), "__a": F.min("x0").over(page), "__b": F.max("x0").over(page)})
    levels = F.ceil((F.col("__b") - F.col("__a")) / F.col("__h"))
    level = (F.least(levels, F.ceil((F.col("x0") + F.col("__h") / 2 - F.col("__a")) / F.col("__h"))) - 1).cast("int")
    b = b.withColumn("level", level)
    return b.withColumns({"text": F.concat(F.repeat(F.lit("  "), F.col("level")), "text"), "x0": F.col("__a")}).drop("__h", "__a", "__b")
