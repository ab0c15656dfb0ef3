"""Queries on texts: separators, page, document and batch texts, spans."""

from pyspark.sql import functions as F

from pagewright import derive
from pagewright.functions.text import CJK_RANGES
from pagewright.operators import assembly
from pagewright.registry import query

CJK = "^[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in CJK_RANGES) + "]"


def sep_sql(a: str, b: str) -> str:
    """The separator of two texts for DuckDB."""
    return f"CASE WHEN regexp_matches(right({a}, 1), '{CJK}') AND regexp_matches(left({b}, 1), '{CJK}') THEN '' WHEN right({a}, 1) = '-' THEN '' WHEN regexp_matches(left({b}, 1), '^\\p{{P}}') THEN '' ELSE ' ' END"


PIECES = f"(SELECT *, lead(text) OVER (PARTITION BY doc_id, page ORDER BY block_no) AS following FROM blocks)"
PARTED = f"(SELECT *, CASE WHEN following IS NULL THEN '' ELSE {sep_sql('text', 'following')} END AS gap FROM {PIECES})"
PAGE_TEXT = f"(SELECT doc_id, page, string_agg(text || gap, '' ORDER BY block_no) AS text, count(*) AS n_blocks FROM {PARTED} GROUP BY doc_id, page)"


def pages_of(spark, sf_dir):
    return assembly.page_texts(assembly.with_separators(derive.blocks(spark, sf_dir)))


@query(f"SELECT doc_id, md5(string_agg(text, '' ORDER BY page)) AS text_md5, sum(n_blocks)::BIGINT AS n_blocks FROM {PAGE_TEXT} GROUP BY doc_id", "blocks")
def doc_text(spark, sf_dir):
    return assembly.document_texts(pages_of(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"), "n_blocks")


@query(f"SELECT doc_id, page, text, n_blocks FROM {PAGE_TEXT}", "blocks")
def page_text(spark, sf_dir):
    return pages_of(spark, sf_dir).select("doc_id", "page", "text", "n_blocks")


@query(f"SELECT lang, CASE WHEN following IS NULL THEN 'line end' WHEN gap = '' THEN 'none' ELSE 'space' END AS kind, count(*) AS n FROM {PARTED} GROUP BY 1, 2", "blocks")
def separator_profile(spark, sf_dir):
    kind = F.when(F.col("sep") == "\n", "line end").when(F.col("sep") == "", "none").otherwise("space")
    return assembly.with_separators(derive.blocks(spark, sf_dir)).groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


RESULT_TEXT = f"(SELECT r.job_id, r.doc_id, r.page, r.code, r.finished_s * 1000 + r.page AS seq, CASE WHEN r.code = 100 THEN t.text || CASE WHEN r.page % 2 = 0 THEN chr(10) ELSE '' END WHEN r.code = 101 THEN '' ELSE r.message END AS text FROM page_results r JOIN {PAGE_TEXT} t USING (doc_id, page))"


def result_texts(spark, sf_dir):
    """Page results with their text; every second page ends in a line end."""
    text = F.when(F.col("code") == 100, F.concat("text", F.when(F.col("page") % 2 == 0, "\n").otherwise(""))).when(F.col("code") == 101, "").otherwise(F.col("message"))
    joined = derive.page_results(spark, sf_dir).drop("n_blocks").join(pages_of(spark, sf_dir), ["doc_id", "page"])
    return joined.select("job_id", "doc_id", "page", "code", (F.col("finished_s") * 1000 + F.col("page")).alias("seq"), text.alias("text"))


@query(f"""SELECT doc_id, md5(CASE WHEN text = '' THEN '{assembly.NO_TEXT}' ELSE text END) AS text_md5 FROM (SELECT doc_id, string_agg(CASE WHEN before <> '' AND NOT ends_with(before, chr(10)) THEN chr(10) ELSE '' END || text, '' ORDER BY seq) AS text
FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM {RESULT_TEXT}) GROUP BY doc_id)""", "page_results")
def batch_text(spark, sf_dir):
    return assembly.batch_text(result_texts(spark, sf_dir), ["doc_id"], "seq").select("doc_id", F.md5("text").alias("text_md5"))


@query(f"""SELECT doc_id, md5(coalesce(string_agg(CASE WHEN text <> '' THEN text || CASE WHEN last THEN '' ELSE chr(10) END END, '' ORDER BY seq), '')) AS text_md5
FROM (SELECT *, seq = max(seq) OVER (PARTITION BY doc_id) AS last FROM {RESULT_TEXT}) GROUP BY doc_id""", "page_results")
def copy_all(spark, sf_dir):
    return assembly.copied_text(result_texts(spark, sf_dir), ["doc_id"], "seq").select("doc_id", F.md5("text").alias("text_md5"))


@query("""SELECT doc_id, page, span_id, string_agg(CASE WHEN block_no = li AND block_no = ri THEN substring(text, lt + 1, rt - lt) WHEN block_no = li THEN substring(text, lt + 1) || coalesce(sep, '') WHEN block_no = ri THEN substring(text, 1, rt) ELSE text || coalesce(sep, '') END, '' ORDER BY block_no) AS text
FROM blocks JOIN (SELECT doc_id, page, page * 10 AS span_id, (page - 1) * 40 + doc_id % 5 AS li, doc_id % 7 AS lt, (page - 1) * 40 + 6 + doc_id % 9 AS ri, 3 + doc_id % 4 AS rt FROM page_list) USING (doc_id, page) WHERE block_no BETWEEN li AND ri GROUP BY doc_id, page, span_id""", "page_list")
def span_text(spark, sf_dir):
    p = derive.pages(spark, sf_dir)
    first, last = (F.col("page") - 1) * 40 + F.col("doc_id") % 5, (F.col("page") - 1) * 40 + 6 + F.col("doc_id") % 9
    # Reversed on purpose: the operator swaps them.
    spans = p.select("doc_id", "page", (F.col("page") * 10).alias("span_id"), last.alias("left_block"), (3 + F.col("doc_id") % 4).alias("left_char"), first.alias("right_block"), (F.col("doc_id") % 7).alias("right_char"))
    b = derive.blocks(spark, sf_dir).select("doc_id", "page", "block_no", "text", "sep")
    return assembly.span_texts(b, spans, ["doc_id", "page"], "block_no").select("doc_id", "page", "span_id", "text")
