"""Queries on names, labels and scalar conversions."""

from functools import reduce

from pyspark.sql import functions as F

from pagewright import derive
from pagewright.functions import text as t
from pagewright.operators.filters import clamp_range
from pagewright.queries.filtering import CLAMPED, PATHS, paths_of
from pagewright.registry import query

RANGE = "CASE WHEN a = 1 AND b = page_count THEN '' WHEN a = b THEN '(p' || a || ')' ELSE '(p' || a || '-' || b || ')' END"


@query(f"SELECT doc_id, '[OCR]_' || strftime(DATE '2024-01-01' + (doc_id % 28)::INTEGER, '%Y%m%d') || '_doc ' || doc_id || {RANGE} AS name FROM {CLAMPED}", "catalogue")
def output_names(spark, sf_dir):
    a, b = clamp_range(F.col("range_start"), F.col("range_end"), F.col("page_count"))
    day = t.formatted_time(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("timestamp"), "%Y%m%d")
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return derive.catalogue(spark, sf_dir).select("doc_id", t.output_name(F.lit("[OCR]_%date_%name%range"), day, name, a, b, F.col("page_count")).alias("name"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H.%M.%S (%y, day %j) 100% ') || epoch_us(ts) // 1000000 || '.' || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '0' ELSE rtrim(lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0') END || ' %Q' AS name FROM events".replace("100% ", "100%% "))
def dated_names(spark, sf_dir):
    """Times in a user's own pattern, seconds since 1970 among them."""
    return derive.table(spark, sf_dir, "events").select("event_id", t.formatted_time(F.col("ts").cast("timestamp"), "%Y-%m-%d %H.%M.%S (%y, day %j) 100%% %unix %Q").alias("name"))


@query("SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN 'page ' || page ELSE 'time ' || printf('%.2f', time_s) || CASE WHEN score > 0 THEN ' | confidence ' || printf('%.2f', score) ELSE '' END END AS title FROM page_results", "page_results")
def result_titles(spark, sf_dir):
    given = F.when(F.col("page") % 3 == 0, F.concat(F.lit("page "), F.col("page").cast("string")))
    return derive.page_results(spark, sf_dir).select("doc_id", "page", t.result_title(given, F.col("time_s"), F.col("score")).alias("title"))


@query("""SELECT event_id, CASE s WHEN 'run' THEN CASE WHEN k < n THEN 'running' ELSE 'saving' END WHEN 'pause' THEN 'paused' WHEN 'stop' THEN CASE WHEN k <= 0 THEN '' WHEN k < n THEN 'stopped' ELSE 'finished' END ELSE '' END AS label FROM (
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'pause' WHEN 2 THEN 'stop' ELSE 'other' END AS s, event_id // 4 % 5 AS k, 4 AS n FROM events)""")
def state_labels(spark, sf_dir):
    k = F.col("event_id") % 4
    state = F.when(k == 0, "run").when(k == 1, "pause").when(k == 2, "stop").otherwise("other")
    return derive.table(spark, sf_dir, "events").select("event_id", t.state_label(state, F.floor(F.col("event_id") / 4) % 5, F.lit(4)).alias("label"))


@query(r"""SELECT page_id, regexp_matches(name, '[\\/:*?"<>|]') AS illegal, left(regexp_replace(trim(name, ' '), '[/:*?"<>|]', '_', 'g'), 255) AS safe FROM (SELECT page_id, ' ' || url || '\' || left(html, 300) AS name FROM pages)""")
def name_checks(spark, sf_dir):
    name = F.concat(F.lit(" "), "url", F.lit("\\"), F.left("html", F.lit(300)))
    return derive.table(spark, sf_dir, "pages").select("page_id", name.alias("name")).select("page_id", t.illegal_name("name").alias("illegal"), t.safe_name("name").alias("safe"))


@query(r"""SELECT doc_id, regexp_matches(name, '[\\/:*?"<>|]') AS illegal, md5(left(regexp_replace(trim(name, ' '), '[/:*?"<>|]', '_', 'g'), 255)) AS safe_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^A-Za-z ]', ' ', 'g') END AS name FROM documents)""")
def whole_name_checks(spark, sf_dir):
    """Whole texts as names, half of them with letters and spaces only, so that both verdicts occur."""
    name = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "[^A-Za-z ]", " "))
    return derive.table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).select("doc_id", t.illegal_name("name").alias("illegal"), F.md5(t.safe_name("name")).alias("safe_md5"))


@query(rf"""SELECT page_id, base, regexp_replace(path, '/?[^/]*$', '') AS folder, CASE WHEN regexp_matches(base, '^.+\.[^.]*$') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END AS stem, lower(regexp_extract(base, '.(\.[^.]*)$', 1)) AS extension FROM (SELECT page_id, path, list_last(string_split(path, '/')) AS base FROM {PATHS})""".replace("list_last(", "list_extract(").replace("'/'))", "'/'), -1)"))
def path_parts(spark, sf_dir):
    return paths_of(spark, sf_dir).select("page_id", *[c.alias(k) for k, c in t.path_parts("path").items()])


@query("""SELECT doc_id, page, CASE code WHEN 100 THEN 'text' WHEN 101 THEN 'noText' ELSE 'error' END AS status, CASE code WHEN 100 THEN '√ ' || printf('%.2f', score) WHEN 101 THEN '√ ----' ELSE '× ' || code END AS label, strftime(make_timestamp(finished_s * 1000000), '%H:%M') AS finished FROM page_results""", "page_results")
def status_labels(spark, sf_dir):
    finished = F.date_format(F.timestamp_seconds("finished_s"), "HH:mm")
    return derive.page_results(spark, sf_dir).select("doc_id", "page", t.status(F.col("code")).alias("status"), t.score_label(F.col("code"), F.col("score")).alias("label"), finished.alias("finished"))


@query("""SELECT event_id, CASE WHEN s < 0.1 THEN '' ELSE CASE WHEN length(floor(s / 60)::BIGINT::VARCHAR) < 2 THEN lpad(floor(s / 60)::BIGINT::VARCHAR, 2, '0') ELSE floor(s / 60)::BIGINT::VARCHAR END || ':' || lpad((floor(s)::BIGINT % 60)::VARCHAR, 2, '0') END AS elapsed FROM (SELECT event_id, (event_id % 9973) * 0.75::DOUBLE AS s FROM events)""")
def elapsed_labels(spark, sf_dir):
    return derive.table(spark, sf_dir, "events").select("event_id", t.elapsed((F.col("event_id") % 9973) * F.lit(0.75).cast("double")).alias("elapsed"))


@query("""SELECT code_no, CASE content_type WHEN 'Text' THEN decode(bytes) WHEN 'Mixed' THEN 'type: Mixed' || chr(10) || 'data: ' || decode(bytes) ELSE 'type: Binary' || chr(10) || 'data: [Base64]' || chr(10) || base64(bytes) END AS text FROM barcodes""", "barcodes")
def payload_text(spark, sf_dir):
    return derive.barcodes(spark, sf_dir).select("code_no", t.payload_text(F.col("content_type"), F.col("bytes")).alias("text"))


KINDS = ("int", "float", "json", "string", "float", "string", "string", "float", "int", "json", "string", "json", "int")


@query("""SELECT event_id, CASE WHEN x = floor(x) THEN floor(x)::BIGINT::VARCHAR ELSE x::VARCHAR END AS number, CASE k """ + " ".join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(KINDS)) + """ END AS kind,
CASE k WHEN 0 THEN -event_id WHEN 8 THEN 1000000 + event_id % 1000 END::DECIMAL(38, 0) AS int_value, CASE k WHEN 0 THEN (-event_id)::VARCHAR WHEN 8 THEN (1000000 + event_id % 1000)::VARCHAR WHEN 12 THEN repeat('9', 40) || event_id END AS int_text, CASE k WHEN 1 THEN event_id + 0.5 WHEN 4 THEN event_id * 1000 WHEN 7 THEN 0.25 END::DOUBLE AS float_value,
CASE k WHEN 2 THEN '{"a":' || event_id || '}' WHEN 9 THEN '[1,null,"x"]' WHEN 11 THEN 'true' END AS json_value FROM (SELECT event_id, event_id % 13 AS k, (event_id % 1000) / 4::DOUBLE AS x FROM events)""")
def coerced_values(spark, sf_dir):
    """Literals that are whole numbers, numbers, JSON, or only look like them."""
    e = derive.table(spark, sf_dir, "events")
    k, n = F.col("event_id") % 13, F.col("event_id").cast("string")
    literals = (F.concat(F.lit("-"), n), F.concat(n, F.lit(".5")), F.concat(F.lit('{"a": '), n, F.lit("}")), F.concat(F.lit("v"), n), F.concat(n, F.lit("e3")), F.lit("{bad}"), F.lit("[1,,2]"), F.lit(" .25 "), F.concat(F.lit("1_000_"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")), F.lit(' [1, null, "x"]'), F.lit("1__0"), F.lit("true"), F.concat(F.lit("+00" + "9" * 40), n))
    literal = reduce(lambda a, i: F.when(k == i, literals[i]).otherwise(a), range(len(literals)), F.lit(None).cast("string"))
    values = t.literal_values(literal)
    return e.select("event_id", t.whole_number((F.col("event_id") % 1000).cast("double") / 4).alias("number"), *[values[c].alias(c) for c in ("kind", "int_value", "int_text", "float_value", "json_value")])


@query("SELECT doc_id, page, list_extract(string_split(path, '/'), -1) || ' - ' || page AS label FROM page_results", "page_results")
def page_labels(spark, sf_dir):
    return derive.page_results(spark, sf_dir).select("doc_id", "page", F.concat(t.path_parts("path")["base"], F.lit(" - "), F.col("page").cast("string")).alias("label"))
