"""Ordered scans over groups of any size: numbers, running values, neighbours.

A window by job alone puts a whole job in one task, however large it is. A scan takes two
passes instead. First all rows are dealt out by ranges of (group, order) and written, so
that a group lies in as many parts as its size asks for, one after the other. Each part's
total, or first and last value, is one row for each group that it holds; these rows alone
meet by group, at most as many as there are parts. Then each part is scanned by itself
from what the parts before it leave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.storage import saved

PART = "__part"
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with the number of the part they lie in, parts in the order of ``keys`` and ``order``.

    They are written, as a task that ran again might cut the ranges elsewhere.
    """
    return saved(rows.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], **columns: tuple[str, str | Column]) -> DataFrame:
    """``rows`` with new columns, each given as (kind, value), over the rows of equal ``keys`` in ascending ``order``.

    Kinds: ``sum``, ``max`` and ``last`` (the last value that isn't null) up to the row
    itself; ``before`` and ``after``, the value of the row next to it, or null. ``order``
    has to tell the rows of a group apart; nulls come first. Without ``keys`` all rows are
    one group.
    """
    parts = ranged(rows, keys, order)
    place = F.struct(*[F.lit(0), *order])
    value = {name: F.col(v) if isinstance(v, str) else v for name, (_, v) in columns.items()}
    edges = {
        "sum": lambda v: F.sum(v),
        "max": lambda v: F.max(v),
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), place)),
        "before": lambda v: F.max_by(F.struct(v.alias("v")), place),
        "after": lambda v: F.min_by(F.struct(v.alias("v")), place),
    }
    across = Window.partitionBy(*keys).orderBy(PART)
    carried = {
        "sum": lambda c: F.sum(c).over(across.rowsBetween(*_BEFORE)),
        "max": lambda c: F.max(c).over(across.rowsBetween(*_BEFORE)),
        "last": lambda c: F.last(c, ignorenulls=True).over(across.rowsBetween(*_BEFORE)),
        "before": lambda c: F.lag(c).over(across),
        "after": lambda c: F.lead(c).over(across),
    }
    totals = parts.groupBy(*keys, PART).agg(*[edges[kind](value[name]).alias(f"__{name}") for name, (kind, _) in columns.items()])
    # One row for each part and group in it: at most as many in a group as there are parts.
    left = totals.select(F.col(PART).alias("__at"), *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], *[carried[kind](F.col(f"__{name}")).alias(f"__from_{name}") for name, (kind, _) in columns.items()])
    same = F.col(PART) == F.col("__at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__key{i}"))
    met = parts.join(left, same, "left")

    inside = Window.partitionBy(*keys, PART).orderBy(*order)
    so_far = inside.rowsBetween(*_SO_FAR)

    def scanned(name: str, kind: str) -> Column:
        v, start = value[name], F.col(f"__from_{name}")
        if kind == "sum":
            return F.coalesce(start, F.lit(0)) + F.coalesce(F.sum(v).over(so_far), F.lit(0))
        if kind == "max":
            return F.greatest(start, F.max(v).over(so_far))
        if kind == "last":
            return F.coalesce(F.last(v, ignorenulls=True).over(so_far), start)
        near = (F.lag if kind == "before" else F.lead)(F.struct(v.alias("v"))).over(inside)
        return F.when(near.isNull(), start["v"]).otherwise(near["v"])

    return met.select(*[met[c] for c in rows.columns], *[scanned(name, kind).alias(name) for name, (kind, _) in columns.items()])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their place among those of equal ``keys``, from 1."""
    return scan(rows, keys, order, **{name: ("sum", F.lit(1).cast("long"))})
