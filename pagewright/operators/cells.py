"""A grid of cells under boxes, so that points meet boxes of their own cell and not all of a page or a job.

A box belongs to a level by its larger side: cells of a level are squares at least four
and less than sixteen times as large as its boxes, so that a box touches four of them at
most, mostly one. Boxes too large for the last but one level share the one cell of the
last. A point lies in one cell of each level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a cell at level 0, how much larger it gets with each level, and the level that is one cell.
SIDE, GROWTH, LAST = 64.0, 4.0, 7
CELL = ("__level", "__cx", "__cy")


def _side(level: Column | int) -> Column:
    return F.pow(F.lit(GROWTH), F.lit(level) if isinstance(level, int) else level) * SIDE


def _place(v: str | Column, level: Column | int) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    whole = (F.lit(level) if isinstance(level, int) else level) == LAST
    return F.when(whole, F.lit(0).cast("long")).otherwise(F.floor(v / _side(level)))


def with_cells(boxes: DataFrame, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """A row for each cell that a box touches, with level and place of the cell. Boxes without a whole extent touch none."""
    size = 4 * F.greatest(F.abs(F.col(x1) - F.col(x0)), F.abs(F.col(y1) - F.col(y0)))
    fit = F.ceil(F.log(F.greatest(size, F.lit(SIDE)) / SIDE) / F.log(F.lit(GROWTH))).cast("int")
    level = F.when(size <= SIDE * GROWTH ** (LAST - 1), fit).otherwise(LAST)
    known = F.col(x0).isNotNull() & F.col(y0).isNotNull() & F.col(x1).isNotNull() & F.col(y1).isNotNull()
    at = boxes.filter(known).withColumn("__level", level)
    level = F.col("__level")
    for name, a, b in (("__cx", x0, x1), ("__cy", y0, y1)):
        first, last = _place(a, level), _place(b, level)
        at = at.withColumn(name, F.explode(F.sequence(F.least(first, last), F.greatest(first, last))))
    return at


def cells_of(points: DataFrame, x: str, y: str, levels: Sequence[int] | None = None) -> DataFrame:
    """A row for each level (all of them, if none are given), with the place of the cell that holds the point."""
    each = F.explode(F.lit(list(levels) if levels is not None else list(range(LAST + 1))))
    at = points.withColumn("__level", each)
    return at.withColumns({"__cx": _place(x, F.col("__level")), "__cy": _place(y, F.col("__level"))})


def place_in(x: str, y: str, level: int) -> tuple[Column, Column]:
    """The place of the cell of one level that holds a point."""
    return _place(x, level), _place(y, level)
