"""Queries on layout: native steps, and the parsers with what they are made of."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright import derive
from pagewright.operators import layout
from pagewright.plans import parsers
from pagewright.queries import layout_sql
from pagewright.queries.texts import sep_sql
from pagewright.registry import query


def turned(spark, sf_dir):
    """Blocks with corners. First pieces stand a little further right, so that no indent is just as large as a parser allows: turned pages would differ in the last bit."""
    first = F.when(F.col("chunk_no") == 0, 2.0).otherwise(0.0)
    return derive.corners(derive.blocks(spark, sf_dir).withColumns({c: F.col(c) + first for c in ("x0", "x1")}))


def straight(boxes):
    """Boxes with their own corners: where a step asks if edges are equal, turned pages would differ in the last bit."""
    return boxes.withColumns({c: F.col(of) for c, of in zip(("px", "py", "qx", "qy", "rx", "ry", "sx", "sy"), ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1"))})


@query('SELECT doc_id, page, min(x0) - 1 AS "left", max(x1) + 1 AS "right" FROM blocks GROUP BY doc_id, page', "blocks")
def page_margins(spark, sf_dir):
    return layout.margins(derive.blocks(spark, sf_dir))


# The fold over a page's blocks from top to bottom, as a recursion.
ROWS = """, ranked AS MATERIALIZED (SELECT doc_id, page, block_no, x0, x1, y0, y1, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, block_no) AS k FROM blocks),
walk AS (SELECT doc_id, page, block_no, k, 0 AS "row", y1 AS floor FROM ranked WHERE k = 1 UNION ALL
SELECT r.doc_id, r.page, r.block_no, r.k, CASE WHEN r.y0 > w.floor THEN w."row" + 1 ELSE w."row" END, CASE WHEN r.y0 > w.floor THEN r.y1 ELSE w.floor END FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.page = w.page AND r.k = w.k + 1)"""


@query(f'{ROWS} SELECT doc_id, page, block_no, "row" FROM walk', "blocks")
def page_rows(spark, sf_dir):
    return layout.page_rows(derive.blocks(spark, sf_dir))


@query(f"""{ROWS}, placed AS (SELECT r.*, w."row", min(r.x0) OVER (PARTITION BY r.doc_id, r.page) - 1 AS l, max(r.x1) OVER (PARTITION BY r.doc_id, r.page) + 1 AS z FROM ranked r JOIN walk w USING (doc_id, page, block_no)),
seen AS (SELECT *, greatest(l, coalesce(max(x1) OVER (PARTITION BY doc_id, page, "row" ORDER BY x0, x1, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l)) AS reach FROM placed)
SELECT doc_id, page, "row", reach AS gap_left, x0 AS gap_right FROM seen WHERE x0 > reach UNION ALL SELECT doc_id, page, "row", max(x1), max(z) FROM placed GROUP BY doc_id, page, "row" """, "blocks")
def row_gaps(spark, sf_dir):
    return layout.row_gaps(derive.blocks(spark, sf_dir))


@query(f"""SELECT doc_id, page, line_id, frag_no, CASE WHEN nt IS NULL THEN chr(10) WHEN nx - x1 > (y1 + ny - y0 - nx) * 0.5::DOUBLE * 1.5::DOUBLE THEN ' ' ELSE {sep_sql('text', 'nt')} END AS sep FROM (
SELECT *, lead(x0) OVER w AS nx, lead(y1) OVER w AS ny, lead(text) OVER w AS nt FROM fragments WINDOW w AS (PARTITION BY doc_id, page, line_id ORDER BY frag_no))""", "fragments")
def line_separators(spark, sf_dir):
    return layout.line_separators(derive.fragments(spark, sf_dir)).select("doc_id", "page", "line_id", "frag_no", "sep")


def column():
    return F.floor(F.col("block_no") % 40 / 20).cast("int").alias("col")


BODIES = """, lined AS MATERIALIZED (SELECT doc_id, page, block_no % 40 // 20 AS col, block_no, x0, x1, y0, y1, text, row_number() OVER (PARTITION BY doc_id, page, block_no % 40 // 20 ORDER BY y0, block_no) AS k FROM blocks),
fold AS (SELECT doc_id, page, col, block_no, k, 0 AS para, x0 AS l, x1 AS r, y1 - y0 AS h, NULL::DOUBLE AS s, y1 AS bottom FROM lined WHERE k = 1 UNION ALL
SELECT doc_id, page, col, block_no, k, CASE WHEN same THEN para ELSE para + 1 END, CASE WHEN same THEN (l + x0) / 2 ELSE x0 END, CASE WHEN same THEN (r + x1) / 2 ELSE x1 END, CASE WHEN same THEN (h + y1 - y0) / 2 ELSE y1 - y0 END,
CASE WHEN NOT same THEN NULL WHEN s IS NULL THEN y0 - bottom ELSE (s + (y0 - bottom)) / 2 END, y1 FROM (
SELECT n.doc_id, n.page, n.col, n.block_no, n.k, n.x0, n.x1, n.y0, n.y1, f.para, f.l, f.r, f.h, f.s, f.bottom, abs(f.l - n.x0) <= f.h * 1.2::DOUBLE AND abs(f.r - n.x1) <= f.h * 1.2::DOUBLE AND (f.s IS NULL OR n.y0 - f.bottom < f.s + f.h * 0.5::DOUBLE) AS same
FROM fold f JOIN lined n ON n.doc_id = f.doc_id AND n.page = f.page AND n.col = f.col AND n.k = f.k + 1))"""


def bodies_of(spark, sf_dir):
    return layout.paragraph_bodies(derive.blocks(spark, sf_dir).select("*", column()), ["doc_id", "page", "col"])


@query(f"{BODIES} SELECT doc_id, page, col::INTEGER AS col, block_no, para FROM fold", "blocks")
def paragraph_bodies(spark, sf_dir):
    return bodies_of(spark, sf_dir)


@query(f"""{BODIES} SELECT doc_id, page, block_no, para, CASE WHEN nt IS NULL THEN chr(10) ELSE {sep_sql('text', 'nt')} END AS sep FROM (
SELECT f.doc_id, f.page, f.block_no, f.para, l.text, lead(l.text) OVER (PARTITION BY f.doc_id, f.page, f.col, f.para ORDER BY l.y0, f.block_no) AS nt FROM fold f JOIN lined l ON l.doc_id = f.doc_id AND l.block_no = f.block_no)""", "blocks")
def paragraph_ends(spark, sf_dir):
    b = derive.blocks(spark, sf_dir).select("doc_id", "page", "block_no", "y0", "text", column())
    joined = b.join(bodies_of(spark, sf_dir), ["doc_id", "page", "col", "block_no"])
    return layout.paragraph_ends(joined, ["doc_id", "page", "col"]).select("doc_id", "page", "block_no", "para", "sep")


@query("""SELECT doc_id, page, line_id, min_by(x0, frag_no) AS x0, min(y0) AS y0, CASE WHEN count(*) > 1 THEN greatest(min(y0), max_by(x1, frag_no)) ELSE max_by(x1, frag_no) END AS x1, CASE WHEN count(*) > 1 THEN greatest(min(y0), max_by(y1, frag_no)) ELSE max_by(y1, frag_no) END AS y1,
left(min_by(text, frag_no), 1) || right(max_by(text, frag_no), 1) AS text FROM fragments GROUP BY doc_id, page, line_id""", "fragments")
def line_envelopes(spark, sf_dir):
    return layout.line_envelopes(derive.fragments(spark, sf_dir))


CODE = """, merged AS (SELECT doc_id, page, line_id, frag_no, x0, y0, x1, y1, y1 - y0 AS h, text, score FROM fragments WHERE frag_no = 0 UNION ALL
SELECT f.doc_id, f.page, f.line_id, f.frag_no, least(m.x0, f.x0), least(m.y0, f.y0), greatest(m.x1, f.x1), greatest(m.y1, f.y1), (m.h + f.y1 - f.y0) / 2,
m.text || repeat('  ', CASE WHEN f.x0 > m.x1 THEN round_even((f.x0 - m.x1) / ((m.h + f.y1 - f.y0) / 2), 0)::INTEGER ELSE 0 END) || f.text, m.score + f.score FROM merged m JOIN fragments f ON f.doc_id = m.doc_id AND f.page = m.page AND f.line_id = m.line_id AND f.frag_no = m.frag_no + 1),
code AS (SELECT doc_id, page, line_id, max_by(x0, frag_no) AS x0, max_by(y0, frag_no) AS y0, max_by(x1, frag_no) AS x1, max_by(y1, frag_no) AS y1, max_by(text, frag_no) AS text, round(max_by(score, frag_no) / (max(frag_no) + 1), 9) AS score FROM merged GROUP BY doc_id, page, line_id)"""


def code_of(spark, sf_dir):
    return layout.code_lines(derive.fragments(spark, sf_dir))


@query(f"{CODE} SELECT * FROM code", "fragments")
def code_merge(spark, sf_dir):
    return code_of(spark, sf_dir).withColumn("score", F.round("score", 9))


# Left edges 24 and 60 to the right, 7 more by line: never on a level's edge.
@query("""SELECT doc_id, page, line_id, repeat('  ', greatest(level, 0)) || text AS text, level FROM (SELECT *, least(ceil((b - a) / h), ceil((x0 + h / 2 - a) / h))::INTEGER - 1 AS level FROM (
SELECT *, avg(y1 - y0) OVER w AS h, min(x0) OVER w AS a, max(x0) OVER w AS b FROM (SELECT doc_id, page, line_id, x0 + 7 * (line_id % 5) AS x0, y0, y1, text FROM fragments WHERE frag_no = 0) WINDOW w AS (PARTITION BY doc_id, page)))""", "fragments")
def indent_levels(spark, sf_dir):
    f = derive.fragments(spark, sf_dir).filter("frag_no = 0").withColumn("x0", F.col("x0") + 7 * (F.col("line_id") % 5))
    return layout.indented(f).select("doc_id", "page", "line_id", "text", "level")


@query("SELECT doc_id, page, block_no, coalesce(sep, chr(10)) AS sep FROM blocks", "blocks")
def parse_none(spark, sf_dir):
    return parsers.none(derive.blocks(spark, sf_dir)).select("doc_id", "page", "block_no", "sep")


def _parsed(name, *columns):
    def run(spark, sf_dir):
        boxes = straight(derive.blocks(spark, sf_dir)) if name == "single_code" else turned(spark, sf_dir)
        return parsers.parse(boxes, name).select(*columns)

    run.__name__ = f"parse_{name}"
    return query(layout_sql.SQL[name], "blocks")(run)


for _name in ("multi_para", "multi_line", "multi_none", "single_para", "single_line", "single_none"):
    _parsed(_name, "doc_id", "page", "block_no", "seq", "region", "line", "para", "sep")
_parsed("single_code", "doc_id", "page", "line", "text", "level", "sep")


@query(layout_sql.SQL["regions"], "blocks")
def regions(spark, sf_dir):
    """Regions of each page in reading order, with their boxes."""
    out = parsers.multi_none(turned(spark, sf_dir))
    corner = lambda f, c: F.round(f(c), 3).alias(c)
    return out.groupBy("doc_id", "page", "region").agg(F.count(F.lit(1)).alias("n"), corner(F.min, "x0"), corner(F.min, "y0"), corner(F.max, "x1"), corner(F.max, "y1"), F.min("seq").alias("first"))


def _varied(name):
    def run(spark, sf_dir):
        return parsers.parse(straight(derive.varied(spark, sf_dir)), name).select("doc_id", "page", "block_no", "seq", "region", "line", "para", "sep")

    run.__name__ = f"varied_{name}"
    run.__doc__ = "A parser over pages with headings, footers and several columns."
    return query(layout_sql.VARIED[name], "varied")(run)


for _name in ("multi_para", "single_para", "single_none"):
    _varied(_name)


@query(layout_sql.VARIED["regions"], "varied")
def varied_regions(spark, sf_dir):
    """Regions of pages with headings, footers and several columns."""
    out = parsers.multi_none(straight(derive.varied(spark, sf_dir)))
    corner = lambda f, c: F.round(f(c), 3).alias(c)
    return out.groupBy("doc_id", "page", "region").agg(F.count(F.lit(1)).alias("n"), corner(F.min, "x0"), corner(F.min, "y0"), corner(F.max, "x1"), corner(F.max, "y1"), F.min("seq").alias("first"))


@query(layout_sql.VARIED["paragraph_merge"], "varied")
def varied_paragraphs(spark, sf_dir):
    """Paragraphs of pages with headings, footers and several columns: how many lines each has."""
    out = parsers.multi_para(straight(derive.varied(spark, sf_dir)))
    return out.groupBy("doc_id", "page", "region", "para").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"SELECT source AS batch, 'd' || doc_id AS doc, 'p' || page AS sheet, block_no, seq, para, sep FROM ({layout_sql.VARIED['multi_para'].replace(', apart AS', 'WITH apart AS', 1)}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)", "varied")
def parse_keyed(spark, sf_dir):
    """Pages told apart by a batch, a document's name and a sheet's name, all of them strings."""
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    b = derive.varied(spark, sf_dir).select(F.col("job_id").alias("batch"), name("d", "doc_id").alias("doc"), name("p", "page").alias("sheet"), "block_no", "text", "score", "x0", "y0", "x1", "y1")
    return parsers.parse(straight(b), "multi_para", ("batch", "doc", "sheet")).select("batch", "doc", "sheet", "block_no", "seq", "para", "sep")


@query(layout_sql.SQL["line_groups"], "fragments")
def line_groups(spark, sf_dir):
    """Lines of fragments by the greedy scan."""
    f = derive.fragments(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_id", "frag_no"))
    f = f.withColumn("block_no", number.cast("long"))
    return parsers.single_line(straight(f)).select("doc_id", "page", "block_no", "seq", "line", "sep")


@query(layout_sql.SQL["paragraph_merge"], "blocks")
def paragraph_merge(spark, sf_dir):
    """Paragraphs of each page after single lines were taken in: how many lines each has."""
    out = parsers.multi_para(turned(spark, sf_dir))
    return out.groupBy("doc_id", "page", "region", "para").agg(F.count(F.lit(1)).alias("n_lines"))
