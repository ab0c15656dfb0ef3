"""Page-wise steps over flat rows: whole groups, one shuffle, lines of code block by block."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright import derive
from pagewright.operators import groups, layout
from pagewright.plans import parsers
from pagewright.queries import layouts


def test_groups_come_whole():
    """Groups over several batches, of one row, with null and NaN keys."""
    nan = float("nan")
    keys = [(1, nan)] * 7 + [(1, 2.0)] + [(None, 2.0)] * 5 + [(2, nan)] * 2
    rows = pa.RecordBatch.from_pydict({"a": pa.array([k[0] for k in keys], pa.int64()), "b": [k[1] for k in keys], "n": list(range(len(keys)))})
    for size in (1, 2, 3, 7, 20):
        batches = [rows.slice(i, size) for i in range(0, len(keys), size)]
        got = [(b.column("n").to_pylist()[i:j]) for b, bounds in groups.whole(iter(batches), ["a", "b"]) for i, j in zip(bounds, bounds[1:])]
        assert got == [list(range(7)), [7], list(range(8, 13)), [13, 14]], size


@pytest.mark.parametrize("name", ["multi_para", "single_para", "single_line", "single_none"])
def test_a_parser_shuffles_once(spark, sf, name):
    plan = parsers.parse(derive.corners(derive.blocks(spark, sf)), name)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "collect_list" not in plan


def test_row_gaps_move_and_sort_blocks_once(spark, sf):
    plan = layouts.row_gaps(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    b = derive.blocks(spark, sf).filter("doc_id < 20")
    rowed = b.join(layout.page_rows(b), ["doc_id", "page", "block_no"])
    assert sorted(map(tuple, layout.row_gaps(rowed).collect())) == sorted(map(tuple, layout.row_gaps(b).collect()))


def test_code_lines_gather_nothing(spark, sf):
    plan = layout.code_lines(derive.fragments(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Sort [") == 1


def test_long_lines_are_cut_in_one_pass(spark, tmp_path):
    """A line of four million characters; a substring for each piece would pass 80,000 times over half of it."""
    n = 4_000_000
    text = F.concat(F.repeat(F.lit("ab 汉😀e f"), n // 8), F.lit("\n\n  \nend"))
    spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang")).write.parquet(str(tmp_path / "documents.parquet"))
    start = time.perf_counter()
    rows = derive.chunks(spark, str(tmp_path)).agg(F.count("*"), F.sum(F.length("text")), F.max(F.length("text")), F.max("line_no"), F.max("seq")).first()
    assert tuple(rows) == (n // 48 + 2, n + 3, 48, 3, n // 48 + 1)
    assert time.perf_counter() - start < 20
