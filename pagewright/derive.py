"""Tables of text blocks and results, derived from the driver's tables.

Each table exists twice under one rule: as a DataFrame, and as a SQL text for
DuckDB. A page holds 40 blocks in two columns of 20 rows; texts are cut at line
ends and then every 48 characters. All values follow from ids and lengths, so both
engines agree bit for bit. Nothing here shuffles but the tables made by grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 48
PAGE = 40
COLUMN = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, seq, line_no, chunk_no, text: the pieces of a document that aren't blank, numbered from 0."""
    # One pass over each line; a substring for each piece would count a long line's characters from its front every time.
    pieces = F.expr(
        f"""filter(flatten(transform(split(text, '\\n'), (line, i) ->
              transform(regexp_extract_all(line, '(?s).{{1,{PIECE}}}', 0), (s, k) ->
                named_struct('line_no', i, 'chunk_no', k, 'text', s)))),
            p -> trim(p.text) <> '')"""
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(pieces).alias("seq", "p")).select("doc_id", "source", "lang", "seq", "p.line_no", "p.chunk_no", "p.text")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text-block table: job_id, doc_id, page, block_no, bounding box, text, score, sep, origin."""
    c = chunks(spark, sf_dir)
    page = F.floor(F.col("seq") / PAGE).cast("int") + 1
    at = F.col("seq") % PAGE
    c = c.select(
        F.col("source").alias("job_id"), "doc_id", "lang", page.alias("page"), F.col("seq").alias("block_no"), "line_no", "chunk_no", "text",
        (60 + 520 * F.floor(at / COLUMN) + F.when(F.col("chunk_no") == 0, 24).otherwise(0)).cast("double").alias("x0"),
        (50 + 30 * (at % COLUMN) + (F.col("doc_id") + 7 * F.col("seq")) % 3).cast("double").alias("y0"),
        (0.5 + ((31 * F.col("doc_id") + 17 * F.col("seq")) % 50) / 100).alias("score"),
    )
    return c.withColumns({"x1": F.col("x0") + 9 * F.length("text"), "y1": F.col("y0") + 20, "origin": F.when((F.col("doc_id") + F.col("page")) % 3 == 0, "text").otherwise("ocr"), "sep": F.when(F.col("block_no") % 5 == 0, "").when(F.col("block_no") % 7 == 0, " ")})


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of many kinds: a heading and a footer across the page, one to three columns, two columns above three, or labels beside their texts; lines of several heights and spacings."""
    c = chunks(spark, sf_dir)
    page = F.floor(F.col("seq") / PAGE).cast("int") + 1
    c = c.select(F.col("source").alias("job_id"), "doc_id", page.alias("page"), F.col("seq").alias("block_no"), "chunk_no", "text", (F.col("seq") % PAGE - 1).alias("at"), ((F.col("doc_id") + 3 * page) % 5).alias("kind"))
    upper = F.col("at") < 12
    n = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 1, 2).when(F.col("kind") == 2, 3).when(F.col("kind") == 3, F.when(upper, 2).otherwise(3)).otherwise(2)
    c = c.withColumns({"n": n, "within": F.when((F.col("kind") == 3) & ~upper, F.col("at") - 12).otherwise(F.col("at"))})
    c = c.withColumns({"col": F.col("within") % F.col("n"), "row": F.floor(F.col("within") / F.col("n")) + F.when((F.col("kind") == 3) & ~upper, 6).otherwise(0)})
    c = c.withColumns({"width": F.when(F.col("kind") == 4, F.when(F.col("col") == 0, 160).otherwise(900)).otherwise(1140 / F.col("n"))})
    across = (F.col("at") == -1) | (F.col("at") == 38)
    left = F.when(F.col("kind") == 4, 170 * F.col("col")).otherwise(F.col("width") * F.col("col")) + 60 + F.when((F.col("chunk_no") == 0) & (F.col("kind") != 4), 20).otherwise(0)
    top = 80 + 34 * F.col("row") + 30 * F.floor(F.col("row") / 6) + (F.col("doc_id") + 7 * F.col("block_no")) % 3 + F.when(F.col("kind") == 4, 0).otherwise(3 * F.col("col"))
    size = 20 + 2 * (F.col("block_no") % 3)
    out = c.withColumns({"x0": F.when(across, 60).otherwise(left).cast("double"), "y0": F.when(F.col("at") == -1, 20).when(F.col("at") == 38, 2000).otherwise(top).cast("double")})
    x1 = F.when(across, F.lit(1200.0)).otherwise(F.col("x0") + (F.col("width") - 60) * F.length("text") / 48)
    out = out.withColumns({"x1": x1, "y1": F.col("y0") + F.when(across, 30).otherwise(size), "score": F.lit(0.5)})
    return out.select("job_id", "doc_id", "page", "block_no", "chunk_no", "text", "x0", "y0", "x1", "y1", "score")


COS, SIN = 0.9902680687415704, 0.13917310096006544  # of 8 degrees


def corners(df: DataFrame) -> DataFrame:
    """``df`` with the four corners of its boxes, turned by 8 degrees where doc_id is a multiple of 5."""
    out = df
    for name, x, y in (("p", "x0", "y0"), ("q", "x1", "y0"), ("r", "x1", "y1"), ("s", "x0", "y1")):
        turned = F.col("doc_id") % 5 == 0
        out = out.withColumn(name + "x", F.when(turned, F.col(x) * COS - F.col(y) * SIN).otherwise(F.col(x)))
        out = out.withColumn(name + "y", F.when(turned, F.col(x) * SIN + F.col(y) * COS).otherwise(F.col(y)))
    return out


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks cut into groups of three words side by side: several blocks a line. line_id counts the lines of a page, frag_no the groups of a line."""
    b = blocks(spark, sf_dir)
    groups = F.regexp_extract_all(F.regexp_replace("text", " +", " "), F.lit("[^ ]+(?: [^ ]+){0,2}"), F.lit(0))
    b = b.select("job_id", "doc_id", "page", "block_no", "x0", "y0", "y1", "score", F.posexplode(groups).alias("frag_no", "text"))
    left = (F.col("x0") + 140 * F.col("frag_no")).alias("x0")
    return b.select("job_id", "doc_id", "page", F.col("block_no").alias("line_id"), "frag_no", left, (F.col("x0") + 140 * F.col("frag_no") + 7 * F.length("text")).alias("x1"), "y0", "y1", "score", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, doc_id, page, n_blocks of every page."""
    return blocks(spark, sf_dir).groupBy("job_id", "doc_id", "page").agg(F.count(F.lit(1)).alias("n_blocks"))


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page that has a result: code, message, score, times, path. Every 19th page has none."""
    return with_results(pages(spark, sf_dir))


def with_results(pages: DataFrame) -> DataFrame:
    """The results of pages; columns that ``pages`` has besides those of ``pages()`` follow."""
    p = pages.filter((F.col("doc_id") + F.col("page")) % 19 != 0)
    code = F.when((13 * F.col("doc_id") + F.col("page")) % 17 == 0, 101).when((7 * F.col("doc_id") + F.col("page")) % 23 == 0, 902).otherwise(100)
    p = p.withColumn("code", code)
    return p.select(
        "job_id", "doc_id", "page", "code", "n_blocks",
        F.when(F.col("code") == 902, F.concat(F.lit("engine failed on page "), F.col("page").cast("string"))).alias("message"),
        F.when(F.col("code") == 100, (50 + (F.col("doc_id") + F.col("page")) % 50) / 100).otherwise(0.0).alias("score"),
        (0.05 + F.col("page") % 10 / 100).alias("time_s"),
        (1704067200 + 60 * F.col("doc_id") + F.col("page")).alias("finished_s"),
        F.concat(F.lit("scans/"), "job_id", F.lit("/doc "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        *[c for c in pages.columns if c not in ("job_id", "doc_id", "page", "n_blocks")],
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: page count, encryption, and a page range of all kinds."""
    docs = pages(spark, sf_dir).groupBy("job_id", "doc_id").agg(F.max("page").alias("page_count"))
    kind = F.col("doc_id") % 7
    first = F.when(kind == 0, 1).when(kind == 1, 2).when(kind == 2, -2).when(kind == 3, 0).when(kind == 4, 3).when(kind == 5, 1).otherwise(1)
    last = F.when(kind == 0, -1).when(kind == 1, 2).when(kind == 2, -1).when(kind == 3, 2).when(kind == 4, 2).when(kind == 5, 99).otherwise(1)
    return docs.select("*", (F.col("doc_id") % 37 == 0).alias("is_encrypted"), (F.col("doc_id") % 74 == 0).alias("is_authenticated"), first.alias("range_start"), last.alias("range_end"))


def control_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, event_id, ts, action of every job's control stream."""
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", "value", action.alias("action"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, event_id, ts, action, task: every purchase takes a task, whose result comes up to two days later; few errors end their job."""
    e = control_events(spark, sf_dir)
    action = F.when(F.col("action") != "fail", F.col("action")).when(F.col("event_id") % 8 == 0, "stop").when(F.col("event_id") % 8 == 1, "fail").otherwise("start")
    taken = F.col("action") == "page_done"
    first = e.select("job_id", (2 * F.col("event_id")).alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(taken, "take").otherwise(action).alias("action"), F.when(taken, F.col("event_id")).alias("task"))
    after = F.make_dt_interval(hours=(8 * (F.col("event_id") % 7)).cast("int"))
    came = e.filter(taken).select("job_id", (2 * F.col("event_id") + 1).alias("event_id"), (F.col("ts") + after).cast("timestamp").alias("ts"), F.lit("done").alias("action"), F.col("event_id").alias("task"))
    return first.unionByName(came)


ACTIONS = {"signup": "start", "view": "pause", "click": "resume", "error": "fail", "purchase": "page_done"}
LEVELS = {"signup": "INFO", "view": "DEBUG", "click": "INFO", "error": "ERROR", "purchase": "WARNING"}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select("event_id", "ts", level.alias("level"), F.col("props").alias("message"), F.concat(F.lit("module"), (F.col("user_id") % 4).cast("string")).alias("module"))


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode records by image: every 11th payload isn't UTF-8, every 13th is invalid."""
    e = table(spark, sf_dir, "events")
    data = F.when(F.col("event_id") % 11 == 0, F.expr("X'FFFE41'")).otherwise(F.encode(F.coalesce("props", F.lit("")), "utf-8"))
    kind = F.when(F.col("event_id") % 11 == 0, "Binary").when(F.col("event_id") % 3 == 0, "Mixed").otherwise("Text")
    return e.select((F.col("event_id") % 997).alias("img_id"), F.col("event_id").alias("code_no"), (F.col("event_id") % 13 != 0).alias("valid"), kind.alias("content_type"), data.alias("bytes"))


def _case(column: str, mapping: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


# The same tables for DuckDB. Each entry may use those before it.
SQL = {
    "chunks": f"""
SELECT doc_id, source, lang, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, chunk_no) - 1 AS seq, line_no, chunk_no, text FROM (
  SELECT doc_id, source, lang, line_no, k AS chunk_no, substring(line, k * {PIECE} + 1, {PIECE}) AS text FROM (
    SELECT doc_id, source, lang, i - 1 AS line_no, ls[i] AS line
    FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) t(i)), range(0, greatest(CAST(ceil(length(line) / {PIECE}.0) AS BIGINT), 1)) u(k))
WHERE trim(text) <> ''""",
    "blocks": f"""
SELECT *, x0 + 9 * length(text) AS x1, y0 + 20 AS y1, CASE WHEN (doc_id + page) % 3 = 0 THEN 'text' ELSE 'ocr' END AS origin, CASE WHEN block_no % 5 = 0 THEN '' WHEN block_no % 7 = 0 THEN ' ' END AS sep FROM (
  SELECT source AS job_id, doc_id, lang, CAST(seq // {PAGE} + 1 AS INTEGER) AS page, seq AS block_no, line_no, chunk_no, text,
    CAST(60 + 520 * ((seq % {PAGE}) // {COLUMN}) + CASE WHEN chunk_no = 0 THEN 24 ELSE 0 END AS DOUBLE) AS x0,
    CAST(50 + 30 * (seq % {PAGE} % {COLUMN}) + (doc_id + 7 * seq) % 3 AS DOUBLE) AS y0,
    CAST(0.5 AS DOUBLE) + ((31 * doc_id + 17 * seq) % 50) / CAST(100 AS DOUBLE) AS score FROM chunks)""",
    "turned": "SELECT *, " + ", ".join(f"CASE WHEN doc_id % 5 = 0 THEN {x} * CAST({COS!r} AS DOUBLE) - {y} * CAST({SIN!r} AS DOUBLE) ELSE {x} END AS {n}x, CASE WHEN doc_id % 5 = 0 THEN {x} * CAST({SIN!r} AS DOUBLE) + {y} * CAST({COS!r} AS DOUBLE) ELSE {y} END AS {n}y" for n, x, y in (("p", "x0", "y0"), ("q", "x1", "y0"), ("r", "x1", "y1"), ("s", "x0", "y1"))) + " FROM blocks",
    "fragments": """
SELECT job_id, doc_id, page, block_no AS line_id, CAST(g AS INTEGER) AS frag_no, x0 + 140 * g AS x0, x0 + 140 * g + 7 * length(t) AS x1, y0, y1, score, t AS text FROM (
  SELECT *, array_to_string(w[g * 3 + 1 : g * 3 + 3], ' ') AS t FROM (
    SELECT *, list_filter(string_split(text, ' '), lambda v: v <> '') AS w FROM blocks), range(0, (len(w) - 1) // 3 + 1) r(g) WHERE len(w) > 0)""",
    "varied": f"""
SELECT job_id, doc_id, page, block_no, chunk_no, text, x0, y0, CASE WHEN spot IN (-1, 38) THEN 1200::DOUBLE ELSE x0 + (width - 60) * length(text) / 48::DOUBLE END AS x1, y0 + CASE WHEN spot IN (-1, 38) THEN 30 ELSE 20 + 2 * (block_no % 3) END AS y1, 0.5::DOUBLE AS score FROM (
SELECT *, CAST(CASE WHEN spot IN (-1, 38) THEN 60 ELSE CASE WHEN kind = 4 THEN 170 * col ELSE width * col END + 60 + CASE WHEN chunk_no = 0 AND kind <> 4 THEN 20 ELSE 0 END END AS DOUBLE) AS x0,
  CAST(CASE spot WHEN -1 THEN 20 WHEN 38 THEN 2000 ELSE 80 + 34 * line + 30 * (line // 6) + (doc_id + 7 * block_no) % 3 + CASE WHEN kind = 4 THEN 0 ELSE 3 * col END END AS DOUBLE) AS y0 FROM (
SELECT *, CASE WHEN kind = 4 THEN CASE WHEN col = 0 THEN 160 ELSE 900 END ELSE 1140 / n END AS width FROM (
SELECT *, within % n AS col, CAST(floor(within / n) AS BIGINT) + CASE WHEN kind = 3 AND spot >= 12 THEN 6 ELSE 0 END AS line FROM (
SELECT *, CASE kind WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN CASE WHEN spot < 12 THEN 2 ELSE 3 END ELSE 2 END AS n, CASE WHEN kind = 3 AND spot >= 12 THEN spot - 12 ELSE spot END AS within FROM (
SELECT source AS job_id, doc_id, CAST(seq // {PAGE} + 1 AS INTEGER) AS page, seq AS block_no, chunk_no, text, seq % {PAGE} - 1 AS spot, (doc_id + 3 * (seq // {PAGE} + 1)) % 5 AS kind FROM chunks)))))""",
    "page_list": "SELECT job_id, doc_id, page, count(*) AS n_blocks FROM blocks GROUP BY ALL",
    "page_results": """
SELECT job_id, doc_id, page, code, n_blocks, CASE WHEN code = 902 THEN 'engine failed on page ' || page END AS message,
  CASE WHEN code = 100 THEN (50 + (doc_id + page) % 50) / CAST(100 AS DOUBLE) ELSE 0 END AS score, CAST(0.05 AS DOUBLE) + page % 10 / CAST(100 AS DOUBLE) AS time_s,
  1704067200 + 60 * doc_id + page AS finished_s, 'scans/' || job_id || '/doc ' || doc_id || '.pdf' AS path
FROM (SELECT *, CASE WHEN (13 * doc_id + page) % 17 = 0 THEN 101 WHEN (7 * doc_id + page) % 23 = 0 THEN 902 ELSE 100 END AS code FROM page_list WHERE (doc_id + page) % 19 <> 0)""",
    "catalogue": """
SELECT job_id, doc_id, max(page) AS page_count, doc_id % 37 = 0 AS is_encrypted, doc_id % 74 = 0 AS is_authenticated,
  CASE doc_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN -2 WHEN 3 THEN 0 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 1 END AS range_start,
  CASE doc_id % 7 WHEN 0 THEN -1 WHEN 1 THEN 2 WHEN 2 THEN -1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 99 ELSE 1 END AS range_end
FROM page_list GROUP BY job_id, doc_id""",
    "control_events": f"SELECT user_id AS job_id, event_id, ts, value, {_case('event_type', ACTIONS)} AS action FROM events",
    "task_events": """
SELECT job_id, 2 * event_id AS event_id, ts, CASE WHEN action = 'page_done' THEN 'take' WHEN action <> 'fail' THEN action WHEN event_id % 8 = 0 THEN 'stop' WHEN event_id % 8 = 1 THEN 'fail' ELSE 'start' END AS action, CASE WHEN action = 'page_done' THEN event_id END AS task FROM control_events
UNION ALL SELECT job_id, 2 * event_id + 1, ts + to_hours(8 * (event_id % 7)), 'done', event_id FROM control_events WHERE action = 'page_done'""",
    "logs": f"SELECT event_id, ts, {_case('event_type', LEVELS)} AS level, props AS message, 'module' || (user_id % 4) AS module FROM events",
    "barcodes": r"""
SELECT event_id % 997 AS img_id, event_id AS code_no, event_id % 13 <> 0 AS valid, CASE WHEN event_id % 11 = 0 THEN 'Binary' WHEN event_id % 3 = 0 THEN 'Mixed' ELSE 'Text' END AS content_type,
  CASE WHEN event_id % 11 = 0 THEN '\xFF\xFE\x41'::BLOB ELSE encode(coalesce(props, '')) END AS bytes FROM events""",
}
#: What each table is derived from.
NEEDS = {"blocks": ["chunks"], "varied": ["chunks"], "turned": ["blocks"], "fragments": ["blocks"], "page_list": ["blocks"], "page_results": ["page_list"], "catalogue": ["page_list"], "task_events": ["control_events"]}


def with_tables(sql: str, *names: str) -> str:
    """``sql`` with the derived tables it reads before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{sql}" if order else sql
