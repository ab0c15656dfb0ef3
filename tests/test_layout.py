"""Parsers: pages worked out by hand, invariants on the derived corpus, agreement of native and page-wise steps."""

import math

import pytest
from pyspark.sql import functions as F

from pagewright import derive
from pagewright.operators import layout
from pagewright.plans import page_layout, parsers
from pagewright.plans.page_layout import Boxes


def boxes(*rows):
    """(x0, y0, x1, y1) rows."""
    return Boxes(*map(list, zip(*[map(float, r) for r in rows])))


def reading(b):
    return [r.boxes for r in page_layout.regions(b)]


def test_one_column():
    assert reading(boxes((0, 0, 100, 10), (0, 20, 100, 30), (0, 40, 90, 50))) == [[0, 1, 2]]


def test_two_columns():
    b = boxes((0, 0, 100, 10), (200, 0, 300, 10), (0, 20, 100, 30), (200, 20, 300, 30))
    assert reading(b) == [[0, 2], [1, 3]]


def test_heading_over_two_columns():
    b = boxes((0, 0, 300, 10), (0, 20, 100, 30), (200, 20, 300, 30), (0, 40, 100, 50), (200, 40, 300, 50))
    assert reading(b) == [[0], [1, 3], [2, 4]]


def test_three_columns_with_a_common_footer():
    b = boxes((0, 0, 80, 10), (100, 0, 180, 10), (200, 0, 280, 10), (0, 20, 80, 30), (100, 20, 180, 30), (200, 20, 280, 30), (0, 40, 280, 50))
    assert reading(b) == [[0, 3], [1, 4], [2, 5], [6]]


def test_row_does_not_grow():
    """The second box reaches lower than the first; the third starts below the first and opens a row."""
    assert page_layout.rows(boxes((0, 0, 10, 10), (20, 5, 30, 25), (40, 12, 50, 20))) == [[0, 1], [2]]


def test_gutters_narrow_and_part():
    free = [[(0.0, 10.0), (50.0, 60.0)], [(2.0, 4.0), (6.0, 8.0)], [(3.0, 3.5)]]
    assert page_layout.gutters(free) == [(3.0, 3.5, 0, 2), (6.0, 8.0, 0, 1), (50.0, 60.0, 0, 0)]


def test_lines_take_what_stands_at_their_height():
    b = boxes((0, 0, 50, 10), (60, 2, 90, 12), (0, 20, 40, 30), (45, 20, 80, 60), (95, 1, 120, 11))
    assert page_layout.lines(b) == [[0, 1, 4], [2], [3]] or page_layout.lines(b) == [[0, 1, 4], [3], [2]]


def test_single_line_joins_the_nearer_paragraph():
    body = [(0, 0, 100, 10), (0, 14, 100, 24), (0, 28, 60, 38), (10, 50, 100, 60), (0, 64, 100, 74), (0, 78, 100, 88)]
    b = boxes(*body)
    assert page_layout.paragraphs(b, list(range(6))) == [[0, 1, 2], [3, 4, 5]]


def frame(spark, rows):
    out = [(1, 1, i, t, 0.9, None, *map(float, (x0, y0, x1, y0, x1, y1, x0, y1))) for i, (t, x0, y0, x1, y1) in enumerate(rows)]
    return spark.createDataFrame(out, "doc_id long, page int, block_no long, text string, score double, sep string, px double, py double, qx double, qy double, rx double, ry double, sx double, sy double")


PAGE = [("Right head", 200, 0, 300, 10), ("Left one", 0, 1, 100, 11), ("left two-", 0, 20, 100, 30), ("right two", 200, 21, 300, 31), ("three.", 0, 40, 50, 50), ("", 0, 60, 10, 70)]


def text_of(df, order="seq"):
    return "".join(r.text + r.sep for r in sorted(df.collect(), key=lambda r: r[order]))


def test_parsers_on_a_page(spark):
    df = frame(spark, PAGE)
    assert text_of(parsers.parse(df, "multi_line")) == "Left one\nleft two-\nthree.\nRight head\nright two\n"
    assert text_of(parsers.parse(df, "multi_none")) == "Left one left two-three. Right head right two\n"
    assert text_of(parsers.parse(df, "multi_para")) == "Left one left two-three.\nRight head right two\n"
    assert text_of(parsers.parse(df, "no such")) == "\n".join(t for t, *_ in PAGE) + "\n"
    lines = text_of(parsers.parse(df, "single_line"))
    assert lines == "Left one Right head\nleft two- right two\nthree.\n"
    assert text_of(parsers.parse(df, "single_none")) == "Left one Right head left two- right two three.\n"


def test_in_line_gap(spark):
    """A gap over 1.5 times the height parts even after a hyphen; the height takes the neighbour's left edge for a top, so it is small here."""
    df = frame(spark, [("wide-", 0, 100, 20, 110), ("gap", 25, 100, 60, 110), ("x-", 0, 20, 20, 30), ("y", 21, 20, 30, 30)])
    assert text_of(parsers.parse(df, "single_line")).split("\n")[1] == "wide-gap"
    df = frame(spark, [("wide-", 0, 0, 20, 10), ("gap", 25, 0, 60, 10)])
    assert text_of(parsers.parse(df, "single_line")) == "wide- gap\n"


def test_code(spark):
    df = frame(spark, [("if", 0, 0, 20, 10), ("x:", 45, 0, 60, 10), ("y", 21, 20, 30, 30), ("z", 0, 40, 30, 50)])
    got = [(r.text, r.level, r.x0) for r in sorted(parsers.parse(df, "single_code").collect(), key=lambda r: r.line)]
    assert got == [("if" + "  " * round(25 / 10) + "x:", 0, 0.0), ("    y", 2, 0.0), ("z", 0, 0.0)]


def test_equal_left_edges_have_no_indent(spark):
    df = frame(spark, [("a", 5, 0, 20, 10), ("b", 5, 20, 20, 30)])
    assert [(r.text, r.level) for r in parsers.parse(df, "single_code").collect()] == [("a", -1), ("b", -1)]


def test_cjk(spark):
    df = frame(spark, [("漢字", 0, 0, 100, 10), ("仮名。", 0, 14, 100, 24), ("Latin", 0, 28, 100, 38), ("한글", 0, 42, 100, 52), ("！", 0, 56, 100, 66)])
    assert text_of(parsers.parse(df, "multi_none")) == "漢字仮名。 Latin 한글！\n"


def test_empty_pages(spark):
    df = frame(spark, [("", 0, 0, 10, 10)])
    for name in parsers.PARSERS:
        if name != "none":
            assert parsers.parse(df, name).count() == 0


def test_turned_page(spark):
    a = math.radians(10)
    spin = lambda x, y: (math.cos(a) * x - math.sin(a) * y, math.sin(a) * x + math.cos(a) * y)
    rows = []
    for i, (t, x0, y0, x1, y1) in enumerate(PAGE[:5]):
        c = [v for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)) for v in spin(x, y)]
        rows.append((1, 1, i, t, 0.9, None, *c))
    df = spark.createDataFrame(rows, frame(spark, PAGE).schema)
    assert text_of(parsers.parse(df, "multi_para")) == "Left one left two-three.\nRight head right two\n"


@pytest.mark.parametrize("name", [n for n in parsers.PARSERS if n not in ("none", "single_code")])
def test_parsers_keep_every_block(spark, sf, name):
    b = derive.corners(derive.blocks(spark, sf))
    out = parsers.parse(b, name).cache()
    assert out.count() == b.filter("text <> ''").count()
    assert out.select("doc_id", "block_no").distinct().count() == out.count()
    per = out.groupBy("doc_id", "page").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.countDistinct("seq").alias("n"), F.max_by("sep", "seq").alias("last"))
    assert per.filter("a <> 0 or b <> n - 1 or last <> '\n'").count() == 0
    out.unpersist()


def test_native_steps_agree_with_the_page_wise_ones(spark, sf):
    b = derive.blocks(spark, sf)
    native = {(r.doc_id, r.page, r.block_no): r.row for r in layout.page_rows(b).collect()}
    column = F.floor(F.col("block_no") % 40 / 20).cast("int").alias("col")
    para = {(r.doc_id, r.page, r.block_no): r.para for r in layout.paragraph_bodies(b.select("*", column), ["doc_id", "page", "col"]).collect()}
    pages: dict = {}
    for r in sorted(b.collect(), key=lambda r: (r.y0, r.block_no)):
        pages.setdefault((r.doc_id, r.page), []).append(r)
    for key, rs in list(pages.items())[:150]:
        box = Boxes(*([getattr(r, c) for r in rs] for c in ("x0", "y0", "x1", "y1")))
        for k, row in enumerate(page_layout.rows(box)):
            assert all(native[(*key, rs[i].block_no)] == k for i in row)
        for col in (0, 1):
            order = [i for i, r in enumerate(rs) if r.block_no % 40 // 20 == col]
            for k, (body, _) in enumerate(page_layout.bodies(box, order)):
                assert all(para[(*key, rs[i].block_no)] == k for i in body)


def test_shuffles(spark, sf):
    """A parser moves its blocks once for all steps before and in the page-wise one, and once for the windows after it."""
    df = parsers.multi_none(derive.corners(derive.blocks(spark, sf)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_lines_like_a_plain_scan():
    """Against the scan of all free boxes for each line: boxes of all heights, overlaps, ties, boxes without height."""
    import random

    def scanned(b):
        order = sorted(range(len(b.x0)), key=lambda i: (b.x0[i], b.y0[i]))
        free, out = dict.fromkeys(order), []
        while free:
            i = next(iter(free))
            del free[i]
            height, edge, line = b.y1[i] - b.y0[i], b.x1[i], [i]
            for j in list(free):
                other = b.y1[j] - b.y0[j]
                level = b.y0[j] >= b.y0[i] - height * 0.5 and b.y1[j] <= b.y1[i] + height * 0.5
                if b.x0[j] >= edge - height and level and abs(height - other) <= min(height, other) * 0.5:
                    line.append(j)
                    del free[j]
                    edge = b.x1[j]
            out.append(line)
        return sorted(out, key=lambda line: b.y0[line[0]])

    rng = random.Random(6)
    for trial in range(300):
        rows = []
        for _ in range(rng.randint(0, 60)):
            x, y = rng.choice([rng.uniform(-50, 400), rng.randrange(0, 400, 20)]), rng.choice([rng.uniform(-30, 90), rng.randrange(0, 90, 15)])
            rows.append((x, y, x + rng.choice([0, 10, rng.uniform(-3, 80)]), y + rng.choice([0, 10, 15, 22.5, rng.uniform(-2, 40)])))
        b = boxes(*rows, *rows[: rng.randint(0, 5)]) if rows else Boxes([], [], [], [])
        assert page_layout.lines(b) == scanned(b), trial


def test_a_page_of_twenty_thousand_boxes(spark):
    """Lines, rows and paragraph bodies in time about linear in the boxes, also where all boxes are equal."""
    import time

    n = 20_000
    grid = boxes(*[(60 * (i % 100), 30 * (i // 100), 60 * (i % 100) + 50, 30 * (i // 100) + 20) for i in range(n)])
    start = time.perf_counter()
    assert [len(line) for line in page_layout.lines(grid)] == [100] * 200
    assert len(page_layout.lines(boxes(*[(0, 0, 50, 10)] * n))) == n
    assert time.perf_counter() - start < 20  # a scan of all free boxes tests 200 million pairs for the equal ones alone
    df = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("block_no"), (60.0 * (F.col("id") % 100)).alias("x0"), (30.0 * F.floor(F.col("id") / 100)).alias("y0"))
    df = df.withColumns({"x1": F.col("x0") + 50, "y1": F.col("y0") + 20})
    start = time.perf_counter()
    assert layout.page_rows(df).agg(F.max("row")).first()[0] == 199
    one = df.filter("block_no % 100 = 0").unionByName(df.filter("block_no % 100 <> 0").withColumns({"x0": F.lit(0.0), "x1": F.lit(50.0), "y0": 6000 + 30.0 * F.col("block_no"), "y1": 6020 + 30.0 * F.col("block_no")}))
    assert layout.paragraph_bodies(one, ["doc_id", "page"]).count() == n
    assert time.perf_counter() - start < 60


def test_parsers_over_other_keys(spark):
    """Two pages of one document that only a third key of another type tells apart."""
    df = frame(spark, PAGE)
    both = df.withColumn("batch", F.lit("x")).unionByName(df.withColumns({"batch": F.lit("y"), "text": F.upper("text")})).withColumn("page", F.lit(2.5))
    out = parsers.parse(both, "multi_line", ("batch", "doc_id", "page"))
    assert out.columns[:3] == ["batch", "doc_id", "page"] and dict(out.dtypes)["page"] == dict(both.dtypes)["page"]
    want = "Left one\nleft two-\nthree.\nRight head\nright two\n"
    assert text_of(out.filter("batch = 'x'")) == want and text_of(out.filter("batch = 'y'")) == want.upper()
    for name in parsers.PARSERS:
        assert parsers.parse(both.withColumn("sep", F.lit("\n")), name, ("batch", "doc_id", "page")).count() > 0
