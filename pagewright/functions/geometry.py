"""Column functions on boxes. A box is either x0, y0, x1, y1, or four corners px..sy, clockwise from the top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORNERS = ("p", "q", "r", "s")
#: Shorter side of a rendered page, at least.
MIN_EDGE = 1080
#: Pages turned by no more than this aren't turned back.
THRESHOLD = 3 * 3.141592653589793 / 180
PI = 3.141592653589793


def affine(x: Column, scale: Column, shift: Column) -> Column:
    return x * scale + shift


def render_zoom(width: Column, height: Column) -> Column:
    """How far a page is enlarged so that its shorter side has MIN_EDGE pixels."""
    short = F.least(width, height)
    return F.when(short < MIN_EDGE, MIN_EDGE / F.greatest(short, F.lit(1))).otherwise(1.0)


def half_even_degrees(x: Column) -> Column:
    return F.pmod(F.rint(x), F.lit(360.0))


def matrix_rotation(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whole degrees of a 2x2 transform; mirrored ones count by their unmirrored form, vanishing ones are 0."""
    size = F.sqrt(a * a + b * b)
    cos = F.when(a * d - b * c < 0, -a).otherwise(a)
    return F.when(size * size < 1e-6, 0.0).otherwise(half_even_degrees(F.degrees(F.atan2(b / size, cos / size))))


def block_angle() -> Column:
    """Direction of a box's longer side in radians, within [-90°, 90°) moved by the threshold."""
    width = F.sqrt((F.col("qx") - F.col("px")) * (F.col("qx") - F.col("px")) + (F.col("qy") - F.col("py")) * (F.col("qy") - F.col("py")))
    height = F.sqrt((F.col("rx") - F.col("qx")) * (F.col("rx") - F.col("qx")) + (F.col("ry") - F.col("qy")) * (F.col("ry") - F.col("qy")))
    angle = F.when(width < height, F.atan2(F.col("ry") - F.col("qy"), F.col("rx") - F.col("qx"))).otherwise(F.atan2(F.col("qy") - F.col("py"), F.col("qx") - F.col("px")))
    return F.when(angle < -PI / 2 + THRESHOLD, angle + PI).when(angle >= PI / 2 + THRESHOLD, angle - PI).otherwise(angle)


def page_rotation(blocks: DataFrame, keys=("doc_id", "page")) -> DataFrame:
    """Median block angle of each page."""
    return blocks.groupBy(*keys).agg(F.median(block_angle()).alias("rotation"))


def upright(blocks: DataFrame, keys=("doc_id", "page"), order: str = "block_no") -> DataFrame:
    """Blocks with text, their corners turned back by the page's rotation: x0, y0, x1, y1.

    A page turned back so that a coordinate becomes negative is moved so that both
    its least coordinates are 0. The window over the page uses the page's keys, so
    the whole costs one shuffle.
    """
    page = Window.partitionBy(*keys)
    b = blocks.filter("text <> ''").withColumn("__angle", block_angle())
    b = b.withColumn("rotation", F.median("__angle").over(page))
    b = b.withColumns({"__cos": F.cos(-F.col("rotation")), "__sin": F.sin(-F.col("rotation"))})
    still = F.abs("rotation") <= THRESHOLD
    turned = {n + "x": F.when(still, F.col(n + "x")).otherwise(F.col("__cos") * F.col(n + "x") - F.col("__sin") * F.col(n + "y")) for n in CORNERS}
    turned |= {n + "y": F.when(still, F.col(n + "y")).otherwise(F.col("__sin") * F.col(n + "x") + F.col("__cos") * F.col(n + "y")) for n in CORNERS}
    b = b.select(*[c for c in b.columns if c not in (*turned, "x0", "y0", "x1", "y1")], *[v.alias("__" + k) for k, v in turned.items()])
    xs, ys = [F.col(f"__{n}x") for n in CORNERS], [F.col(f"__{n}y") for n in CORNERS]
    b = b.withColumns({"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)})
    b = b.withColumns({"__mx": F.min("x0").over(page), "__my": F.min("y0").over(page)})
    move = ~still & ((F.col("__mx") < 0) | (F.col("__my") < 0))
    for side, by in (("x0", "__mx"), ("x1", "__mx"), ("y0", "__my"), ("y1", "__my")):
        b = b.withColumn(side, F.when(move, F.col(side) - F.col(by)).otherwise(F.col(side)))
    return b.drop(*[c for c in b.columns if c.startswith("__")])


def rotated_bbox(degrees: Column, width: Column, height: Column) -> dict[str, Column]:
    """A box of an unrotated page on the page turned by 0, 90, 180 or 270 degrees, as least and greatest corners."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    at = lambda x, y: (F.when(degrees == 90, height - y).when(degrees == 180, width - x).when(degrees == 270, y).otherwise(x), F.when(degrees == 90, x).when(degrees == 180, height - y).when(degrees == 270, width - x).otherwise(y))
    (px, py), (qx, qy) = at(x0, y0), at(x1, y1)
    return {"x0": F.least(px, qx), "y0": F.least(py, qy), "x1": F.greatest(px, qx), "y1": F.greatest(py, qy)}


def rectangle() -> dict[str, Column]:
    """x, y, width, height of a box."""
    return {"x": F.col("x0"), "y": F.col("y0"), "width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")}


def rounded_box(x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    """Whole-number corners of a rectangle."""
    return {"x0": F.floor(x + 0.5), "y0": F.floor(y + 0.5), "x1": F.floor(x + width + 0.5), "y1": F.floor(y + height + 0.5)}
