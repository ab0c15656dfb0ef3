"""Connected components of a table of links, by alternating large-star and small-star rounds.

A large-star round ties every larger neighbour of a node to the least node it
sees, a small-star round every smaller one; both keep the components and the
rounds end when every component is a star around its least node. Each round is
written to the shared folder. No links leave the executors; the joins are sort-merge joins,
so that no table of nodes is gathered in the driver to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import saved


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "large")
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = saved(down.groupBy("u").agg(F.min("v").alias("m")), "small")
    tied = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node that has a link, with the least node of its component."""
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = saved(_small(saved(_large(edges), "edges")), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
