"""The grid index against all pairs, and how many pairs it tests."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import cells, filters

BOX = "x0 double, y0 double, x1 double, y1 double"


def box(rng, size):
    x, y = rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)
    return x, y, x + rng.choice([0, 1, rng.uniform(0, size)]), y + rng.uniform(0, size)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    """Boxes of all sizes up to those that fill the last level, borders that touch, areas without extent, nulls."""
    rng = random.Random(seed)
    blocks = [(rng.choice("ab"), i, *box(rng, rng.choice([5, 60, 900]))) for i in range(300)]
    areas = [(rng.choice("ab"), *box(rng, rng.choice([80, 700, 5000, 10**7]))) for _ in range(25)] + [("a", *blocks[0][2:]), ("a", None, 0.0, 1.0, 1.0), ("c", -1e9, -1e9, 1e9, 1e9), ("b", 64.0, 64.0, 128.0, 128.0)]
    blocks += [("b", 900, 64.0, 64.0, 128.0, 128.0), ("b", 901, 128.0, 128.0, 128.0, 128.0), ("b", 902, 128.0, 128.0, 128.1, 128.0)]
    b = spark.createDataFrame(blocks, f"job_id string, block_no long, {BOX}").repartition(3)
    a = spark.createDataFrame(areas, f"job_id string, {BOX}")
    holds = lambda s, t: None not in s and s[0] <= t[0] and s[1] <= t[1] and s[2] >= t[2] and s[3] >= t[3]
    want = {x[1] for x in blocks if not any(y[0] == x[0] and holds(y[1:], x[2:]) for y in areas)}
    got = filters.ignore_areas(b, a)
    assert {r.block_no for r in got.collect()} == want and got.columns == b.columns
    points = [(rng.choice("ab"), rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for _ in range(150)] + [("b", 128.0, 128.0), ("b", 128.0, 128.0), ("a", None, 1.0)] + [(x[0], x[2], x[3]) for x in blocks[:20]]
    p = spark.createDataFrame(points, "job_id string, px double, py double")
    first = lambda j, x, y: min((t[1] for t in blocks if x is not None and t[0] == j and t[2] <= x <= t[4] and t[3] <= y <= t[5]), default=-1)
    found = [tuple(r) for r in filters.point_lookup(p, b, ["job_id"]).collect()]
    assert sorted(found, key=str) == sorted(((j, x, y, first(j, x, y)) for j, x, y in points), key=str)


def test_pairs_grow_with_the_blocks(spark):
    """10,000 areas in a job: each block is tested against a few of them."""
    areas = spark.range(10_000).select(F.lit("j").alias("job_id"), (F.col("id") % 100 * 50).cast("double").alias("x0"), (F.floor(F.col("id") / 100) * 50).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 45, "y1": F.col("y0") + 25})
    blocks = spark.range(20_000).select(F.lit("j").alias("job_id"), F.col("id").alias("block_no"), (F.col("id") * 7 % 5000).cast("double").alias("x0"), (F.col("id") * 13 % 5000).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 10})
    filed = cells.with_cells(areas)
    levels = [r[0] for r in filed.select("__level").distinct().collect()]
    tested = cells.cells_of(blocks.select("job_id", F.col("x0").alias("px"), F.col("y0").alias("py")), "px", "py", levels).join(filed, ["job_id", *cells.CELL]).count()
    assert filed.count() < 20_000 and tested < 60 * 20_000  # of 200 million pairs
    plain = blocks.filter(~((F.col("x0") % 50 + 20 <= 45) & (F.col("y0") % 50 + 10 <= 25)))
    assert filters.ignore_areas(blocks, areas).count() == plain.count()
