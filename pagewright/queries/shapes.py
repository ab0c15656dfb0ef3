"""Queries on geometry. Angles and turned coordinates are rounded, as two engines' trigonometry may differ in the last bit."""

from pyspark.sql import functions as F

from pagewright import derive
from pagewright.functions import geometry as g
from pagewright.registry import query


def turned(spark, sf_dir):
    return derive.corners(derive.blocks(spark, sf_dir))


@query("SELECT doc_id, block_no, " + ", ".join(f"round({n}x * (0.5 + doc_id % 3) + 10, 6) AS {n}x, round({n}y * (0.5 + doc_id % 3) + 20, 6) AS {n}y" for n in "pqrs") + " FROM turned", "turned")
def affine_boxes(spark, sf_dir):
    scale = 0.5 + F.col("doc_id") % 3
    return turned(spark, sf_dir).select("doc_id", "block_no", *[F.round(g.affine(F.col(n + axis), scale, F.lit(shift)), 6).alias(n + axis) for n in "pqrs" for axis, shift in (("x", 10), ("y", 20))])


SIZE = "(SELECT page_id, (300 + 97 * (page_id % 17))::DOUBLE AS w, (400 + 61 * (page_id % 23))::DOUBLE AS h FROM pages)"


def sizes(spark, sf_dir):
    return derive.table(spark, sf_dir, "pages").select("page_id", (300 + 97 * (F.col("page_id") % 17)).cast("double").alias("w"), (400 + 61 * (F.col("page_id") % 23)).cast("double").alias("h"))


@query(f"SELECT page_id, CASE WHEN least(w, h) < 1080 THEN 1080 / greatest(least(w, h), 1) ELSE 1::DOUBLE END AS zoom FROM {SIZE}")
def render_zoom(spark, sf_dir):
    return sizes(spark, sf_dir).select("page_id", g.render_zoom(F.col("w"), F.col("h")).alias("zoom"))


@query("SELECT b.doc_id, b.block_no, b.x0 * z.zoom AS x0, b.y0 * z.zoom AS y0, b.x1 * z.zoom AS x1, b.y1 * z.zoom AS y1 FROM blocks b JOIN (SELECT doc_id, page, 1 + (page % 4) / 4::DOUBLE AS zoom FROM page_list) z USING (doc_id, page)", "page_list")
def preview_zoom(spark, sf_dir):
    zoom = derive.pages(spark, sf_dir).select("doc_id", "page", (1 + F.col("page") % 4 / 4).alias("zoom"))
    return derive.blocks(spark, sf_dir).join(zoom, ["doc_id", "page"]).select("doc_id", "block_no", *[g.affine(F.col(c), F.col("zoom"), F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")])


MATRIX = "(SELECT page_id, (page_id % 9 - 4)::DOUBLE AS a, (page_id % 7 - 3)::DOUBLE AS b, (page_id % 5 - 2)::DOUBLE AS c, (page_id % 11 - 5)::DOUBLE AS d FROM pages)"


@query(f"""SELECT page_id, CASE WHEN a * a + b * b < 1e-6 THEN 0::DOUBLE ELSE (round_even(degrees(atan2(b / sqrt(a * a + b * b), CASE WHEN a * d - b * c < 0 THEN -a ELSE a END / sqrt(a * a + b * b))), 0) + 360) % 360 END AS rotation FROM {MATRIX}""")
def matrix_rotation(spark, sf_dir):
    col = lambda k, m: (F.col("page_id") % k - m).cast("double")
    return derive.table(spark, sf_dir, "pages").select("page_id", g.matrix_rotation(col(9, 4), col(7, 3), col(5, 2), col(11, 5)).alias("rotation"))


@query("SELECT page_id, (round_even((page_id % 4) * 90 + (page_id % 37) * 12.5::DOUBLE - 270, 0) + 720) % 360 AS rotation FROM pages")
def absolute_rotation(spark, sf_dir):
    return derive.table(spark, sf_dir, "pages").select("page_id", g.half_even_degrees((F.col("page_id") % 4) * 90 + (F.col("page_id") % 37) * F.lit(12.5) - 270).alias("rotation"))


@query("""SELECT doc_id, block_no, CASE r WHEN 90 THEN 1600 - y1 WHEN 180 THEN 1200 - x1 WHEN 270 THEN y0 ELSE x0 END AS x0, CASE r WHEN 90 THEN x0 WHEN 180 THEN 1600 - y1 WHEN 270 THEN 1200 - x1 ELSE y0 END AS y0,
CASE r WHEN 90 THEN 1600 - y0 WHEN 180 THEN 1200 - x0 WHEN 270 THEN y1 ELSE x1 END AS x1, CASE r WHEN 90 THEN x1 WHEN 180 THEN 1600 - y0 WHEN 270 THEN 1200 - x0 ELSE y1 END AS y1 FROM (SELECT *, doc_id % 4 * 90 AS r FROM blocks)""", "blocks")
def rotated_bbox(spark, sf_dir):
    sides = g.rotated_bbox(F.col("doc_id") % 4 * 90, F.lit(1200.0), F.lit(1600.0))
    return derive.blocks(spark, sf_dir).select("doc_id", "block_no", *[v.alias(k) for k, v in sides.items()])


RAW_ANGLE = "CASE WHEN sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) < sqrt((rx - qx) * (rx - qx) + (ry - qy) * (ry - qy)) THEN atan2(ry - qy, rx - qx) ELSE atan2(qy - py, qx - px) END"
ANGLE = f"(SELECT *, CASE WHEN raw < -pi() / 2 + radians(3) THEN raw + pi() WHEN raw >= pi() / 2 + radians(3) THEN raw - pi() ELSE raw END AS angle FROM (SELECT *, {RAW_ANGLE} AS raw FROM turned))"


@query(f"SELECT doc_id, block_no, round(angle, 6) AS angle FROM {ANGLE}", "turned")
def block_angle(spark, sf_dir):
    return turned(spark, sf_dir).select("doc_id", "block_no", F.round(g.block_angle(), 6).alias("angle"))


@query(f"SELECT doc_id, page, round(median(angle), 6) AS rotation FROM {ANGLE} GROUP BY doc_id, page", "turned")
def page_rotation(spark, sf_dir):
    return g.page_rotation(turned(spark, sf_dir)).select("doc_id", "page", F.round("rotation", 6).alias("rotation"))


TURNED_BACK = ", ".join(f"CASE WHEN abs(r) <= radians(3) THEN {n}x ELSE cos(-r) * {n}x - sin(-r) * {n}y END AS {n}u, CASE WHEN abs(r) <= radians(3) THEN {n}y ELSE sin(-r) * {n}x + cos(-r) * {n}y END AS {n}v" for n in "pqrs")


@query(f"""SELECT doc_id, block_no, round(l - CASE WHEN moved THEN ml ELSE 0 END, 3) AS x0, round(t - CASE WHEN moved THEN mt ELSE 0 END, 3) AS y0, round(ri - CASE WHEN moved THEN ml ELSE 0 END, 3) AS x1, round(bo - CASE WHEN moved THEN mt ELSE 0 END, 3) AS y1 FROM (
SELECT *, abs(r) > radians(3) AND (ml < 0 OR mt < 0) AS moved FROM (SELECT *, min(l) OVER w AS ml, min(t) OVER w AS mt FROM (
SELECT doc_id, page, block_no, r, least(pu, qu, ru, su) AS l, least(pv, qv, rv, sv) AS t, greatest(pu, qu, ru, su) AS ri, greatest(pv, qv, rv, sv) AS bo FROM (SELECT *, {TURNED_BACK} FROM (SELECT *, median(angle) OVER (PARTITION BY doc_id, page) AS r FROM {ANGLE})))
WINDOW w AS (PARTITION BY doc_id, page)))""", "turned")
def upright_bbox(spark, sf_dir):
    return g.upright(turned(spark, sf_dir)).select("doc_id", "block_no", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("SELECT doc_id, block_no, x0 AS x, y0 AS y, x1 - x0 AS width, y1 - y0 AS height, floor(x0 / 3 + 0.5)::BIGINT AS left, floor(x0 / 3 + (x1 - x0) / 3 + 0.5)::BIGINT AS right FROM blocks", "blocks")
def box_rects(spark, sf_dir):
    r = g.rectangle()
    back = g.rounded_box(*(r[k] / 3 for k in ("x", "y", "width", "height")))
    return derive.blocks(spark, sf_dir).select("doc_id", "block_no", *[v.alias(k) for k, v in r.items()], back["x0"].alias("left"), back["x1"].alias("right"))
