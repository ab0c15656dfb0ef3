"""Queries on filters and joins."""

from pyspark.sql import functions as F

from pagewright import derive
from pagewright.operators import filters
from pagewright.registry import query

AREAS = [(0.0, 0.0, 1200.0, 75.0, 1, -1), (500.0, 340.0, 1200.0, 700.0, 2, -1), (84.0, 110.0, 84.0, 110.0, 1, 1)]
AREA_SQL = "(SELECT job_id, x0, y0, x1, y1, page_from, page_to FROM (SELECT DISTINCT job_id FROM blocks), (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}, {f})" for a, b, c, d, e, f in AREAS) + ") v(x0, y0, x1, y1, page_from, page_to))"


def areas_of(spark, blocks):
    rows = ", ".join(f"named_struct('x0', {a}D, 'y0', {b}D, 'x1', {c}D, 'y1', {d}D, 'page_from', {e}, 'page_to', {f})" for a, b, c, d, e, f in AREAS)
    return blocks.select("job_id").distinct().select("job_id", F.explode(F.expr(f"array({rows})")).alias("a")).select("job_id", "a.*")


INSIDE = "a.job_id = b.job_id AND a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1"


@query(f"SELECT job_id, doc_id, page, count(*) AS n FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM {AREA_SQL} a WHERE {INSIDE}) GROUP BY ALL", "blocks")
def ignore_area(spark, sf_dir):
    b = derive.blocks(spark, sf_dir)
    return filters.ignore_areas(b, areas_of(spark, b)).groupBy("job_id", "doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, page, block_no FROM (SELECT b.*, c.page_count FROM blocks b JOIN catalogue c USING (doc_id)) b WHERE NOT EXISTS (SELECT 1 FROM {AREA_SQL} a WHERE {INSIDE}
AND b.page BETWEEN CASE WHEN a.page_from < 0 THEN a.page_from + b.page_count + 1 ELSE a.page_from END AND CASE WHEN a.page_to < 0 THEN a.page_to + b.page_count + 1 ELSE a.page_to END)""", "catalogue")
def ignore_area_paged(spark, sf_dir):
    b = derive.blocks(spark, sf_dir)
    counted = b.join(derive.catalogue(spark, sf_dir).select("doc_id", "page_count"), "doc_id")
    return filters.ignore_areas(counted, areas_of(spark, b), paged=True).select("doc_id", "page", "block_no")


@query(f"SELECT doc_id, page, block_no FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM {AREA_SQL} a WHERE {INSIDE}) AND score >= 0.6::DOUBLE AND text NOT LIKE '%.'", "blocks")
def post_processed(spark, sf_dir):
    """Blocks after a chain of three post-processors."""
    b = derive.blocks(spark, sf_dir)
    areas = areas_of(spark, b)
    steps = (lambda x: filters.ignore_areas(x, areas), lambda x: x.filter(F.col("score") >= 0.6), lambda x: x.filter(~F.col("text").endswith(".")))
    return filters.post_process(b, *steps).select("doc_id", "page", "block_no")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN NULL ELSE 'an area needs two points' END AS error,
CASE WHEN doc_id % 4 < 2 THEN doc_id::DOUBLE END AS x0, CASE WHEN doc_id % 4 < 2 THEN 2::DOUBLE END AS y0, CASE WHEN doc_id % 4 < 2 THEN doc_id + 3::DOUBLE END AS x1, CASE WHEN doc_id % 4 < 2 THEN 9::DOUBLE END AS y1 FROM documents""")
def ignore_area_checked(spark, sf_dir):
    d = F.col("doc_id").cast("double")
    first, second = F.array(d, F.lit(2.0)), F.array(d + 3, F.lit(9.0))
    points = F.when(F.col("doc_id") % 4 < 2, F.array(first, second)).when(F.col("doc_id") % 4 == 2, F.array(first)).otherwise(F.array(first, F.array(d)))
    return filters.check_areas(derive.table(spark, sf_dir, "documents").select("doc_id", points.alias("points"))).drop("points", "slots", "corners")


@query("SELECT doc_id, page, score FROM page_results WHERE code = 100", "page_results")
def blank_filter(spark, sf_dir):
    return filters.drop_blank(derive.page_results(spark, sf_dir)).select("doc_id", "page", "score")


@query("""SELECT p.doc_id, p.page, p.px, p.py, coalesce(min(CASE WHEN p.px BETWEEN b.x0 AND b.x1 AND p.py BETWEEN b.y0 AND b.y1 THEN b.block_no END), -1) AS found
FROM (SELECT doc_id, page, (80 + 37 * (doc_id % 20))::DOUBLE AS px, (50 + 30 * (page % 20) + doc_id % 25)::DOUBLE AS py FROM page_list) p JOIN blocks b USING (doc_id, page) GROUP BY ALL""", "page_list")
def point_lookup(spark, sf_dir):
    p = derive.pages(spark, sf_dir).select("doc_id", "page", (80 + 37 * (F.col("doc_id") % 20)).cast("double").alias("px"), (50 + 30 * (F.col("page") % 20) + F.col("doc_id") % 25).cast("double").alias("py"))
    return filters.point_lookup(p, derive.blocks(spark, sf_dir), ["doc_id", "page"])


@query("""WITH r AS (SELECT path AS title, finished_s AS timestamp, finished_s * 100 + page AS seq FROM page_results), w AS (SELECT doc_id AS wanted_id, 'scans/src' || (doc_id % 20) || '/doc ' || doc_id || '.pdf' AS title, 1704067200 + 60 * (doc_id + 1) + 1 AS timestamp FROM documents)
SELECT w.wanted_id, w.title, w.timestamp, min(r.seq) AS seq FROM w LEFT JOIN r ON r.title = w.title OR r.timestamp = w.timestamp GROUP BY ALL""".replace("WITH r", ", r", 1), "page_results")
def result_lookup(spark, sf_dir):
    r = derive.page_results(spark, sf_dir).select(F.col("path").alias("title"), F.col("finished_s").alias("timestamp"), (F.col("finished_s") * 100 + F.col("page")).alias("seq"))
    d = derive.table(spark, sf_dir, "documents")
    w = d.select(F.col("doc_id").alias("wanted_id"), F.concat(F.lit("scans/src"), (F.col("doc_id") % 20).cast("string"), F.lit("/doc "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("title"), (1704067200 + 60 * (F.col("doc_id") + 1) + 1).alias("timestamp"))
    return filters.result_lookup(w, r)


@query("SELECT path, page_id FROM (SELECT regexp_replace(url, '[?#].*$', '') AS path, page_id, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def unique_paths(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"), "page_id")
    return filters.unique_insert(rows, "path", "page_id")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'changed ' || c_custkey END, c_name) AS c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 7""")
def keyed_upsert(spark, sf_dir):
    c = derive.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = c.filter("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("changed "), F.col("c_custkey").cast("string")).alias("c_name"))
    return filters.keyed_delete(filters.keyed_update(c, changes, "c_custkey", ["c_name"]), c.filter("c_custkey % 10 = 7"), "c_custkey")


WORDS = [("signup", "注册", "Sign up", "登録"), ("view", "查看", "View", "表示"), ("click", "点击", "Click", "クリック"), ("error", "错误", "Error", "エラー")]


@query("SELECT event_id, event_type, coalesce(en_US, event_type) AS translated FROM events LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{e}')" for k, _, e, _ in WORDS) + ") d(key, en_US) ON key = event_type")
def translate_labels(spark, sf_dir):
    words = spark.createDataFrame(WORDS, "key string, zh_CN string, en_US string, ja_JP string")
    return filters.translate(derive.table(spark, sf_dir, "events").select("event_id", "event_type"), words, "event_type", "fr_FR")


@query("SELECT job_id, doc_id, page FROM page_list p WHERE NOT EXISTS (SELECT 1 FROM page_results r WHERE r.doc_id = p.doc_id AND r.page = p.page)", "page_results")
def untouched_pages(spark, sf_dir):
    return filters.untouched(derive.pages(spark, sf_dir), derive.page_results(spark, sf_dir), ["doc_id", "page"]).select("job_id", "doc_id", "page")


@query("SELECT doc_id, page, coalesce(code, 803) AS code, message FROM page_list LEFT JOIN page_results USING (doc_id, page)", "page_results")
def task_outcome(spark, sf_dir):
    return filters.task_outcome(derive.pages(spark, sf_dir).select("doc_id", "page"), derive.page_results(spark, sf_dir).select("doc_id", "page", "code", "message"), ["doc_id", "page"])


@query("SELECT doc_id, CASE WHEN is_encrypted AND NOT is_authenticated THEN 'password needed' ELSE 'ready' END AS status FROM catalogue", "catalogue")
def document_admission(spark, sf_dir):
    return filters.admit_documents(derive.catalogue(spark, sf_dir)).select("doc_id", "status")


PATHS = "(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.pdf' WHEN 2 THEN '.Jpeg' WHEN 3 THEN '' WHEN 4 THEN '.txt' ELSE '.ePub' END AS path FROM pages)"
FAMILY = "CASE WHEN lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) IN (" + ", ".join(f"'{s}'" for s in filters.IMAGE_SUFFIXES) + ") THEN 'image' WHEN lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) IN (" + ", ".join(f"'{s}'" for s in filters.DOCUMENT_SUFFIXES) + ") THEN 'document' END"


def paths_of(spark, sf_dir):
    k = F.col("page_id") % 6
    end = F.when(k == 0, ".PNG").when(k == 1, ".pdf").when(k == 2, ".Jpeg").when(k == 3, "").when(k == 4, ".txt").otherwise(".ePub")
    return derive.table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), end).alias("path"))


@query(f"SELECT page_id, {FAMILY} AS family FROM {PATHS}")
def suffix_family(spark, sf_dir):
    return paths_of(spark, sf_dir).select("page_id", filters.suffix_family("path").alias("family"))


@query(f"SELECT page_id, path, data FROM (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN path END AS path, CASE WHEN page_id % 10 = 0 THEN 'aGk=' END AS data FROM {PATHS}) WHERE (path IS NULL AND data IS NOT NULL) OR coalesce({FAMILY}, '') = 'image'")
def admit_tasks(spark, sf_dir):
    t = paths_of(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 5 != 0, F.col("path")).alias("path"), F.when(F.col("page_id") % 10 == 0, "aGk=").alias("data"))
    return filters.admit_tasks(t)[0]


@query("SELECT path, CASE WHEN path LIKE '%7.pdf' THEN NULL ELSE max(page) END AS page_count, bool_or(doc_id % 37 = 0) AS is_encrypted, CASE WHEN path LIKE '%7.pdf' THEN 'unreadable' END AS error FROM (SELECT doc_id, page, 'scans/' || job_id || '/doc ' || doc_id || '.pdf' AS path FROM page_list) GROUP BY path", "page_list")
def catalogue(spark, sf_dir):
    path = F.concat(F.lit("scans/"), "job_id", F.lit("/doc "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    p = derive.pages(spark, sf_dir).select(path.alias("path"), "page", (F.col("doc_id") % 37 == 0).alias("is_encrypted"))
    return filters.catalogue_of(p.withColumn("page", F.when(~F.col("path").endswith("7.pdf"), F.col("page"))))


NORMAL = "SELECT *, CASE WHEN a < 1 THEN 'starts before page 1' WHEN b > page_count THEN 'ends after the last page' WHEN a > b THEN 'ends before it starts' END AS error FROM (SELECT *, CASE WHEN range_start < 0 THEN range_start + page_count + 1 ELSE range_start END AS a, CASE WHEN range_end < 0 THEN range_end + page_count + 1 ELSE range_end END AS b FROM catalogue)"


@query(f"WITH n AS ({NORMAL}) SELECT doc_id, error, p::INTEGER AS page FROM n, range(a, b + 1) r(p) WHERE error IS NULL UNION ALL SELECT doc_id, error, NULL FROM n WHERE error IS NOT NULL".replace("WITH n", ", n", 1), "catalogue")
def page_ranges(spark, sf_dir):
    return filters.expand_ranges(derive.catalogue(spark, sf_dir)).select("doc_id", "error", "page")


#: a and b: the range of each catalogue row moved inside its document.
CLAMPED = """(SELECT *, least(greatest(b0, a), page_count) AS b FROM (SELECT *, least(greatest(a0, 1), page_count) AS a FROM (SELECT *,
CASE WHEN range_start < 0 THEN range_start + page_count + 1 ELSE range_start END AS a0, CASE WHEN range_end < 0 THEN range_end + page_count + 1 ELSE range_end END AS b0 FROM catalogue)))"""


@query(f"SELECT doc_id, a AS first, b AS last FROM {CLAMPED}", "catalogue")
def range_clamp(spark, sf_dir):
    a, b = filters.clamp_range(F.col("range_start"), F.col("range_end"), F.col("page_count"))
    return derive.catalogue(spark, sf_dir).select("doc_id", a.alias("first"), b.alias("last"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND n = 0 THEN 'no page listed' WHEN doc_id % 5 = 0 AND bad THEN 'no such page' WHEN doc_id % 5 <> 0 AND page_count < 2 THEN 'ends after the last page' END AS error, p::INTEGER AS page FROM (
SELECT *, len(l) AS n, coalesce(list_bool_or(list_transform(l, lambda v: v IS NULL OR v < 1 OR v > page_count)), false) AS bad FROM (
SELECT *, CASE doc_id % 15 WHEN 0 THEN [1, page_count, 1] WHEN 5 THEN []::INTEGER[] ELSE [1, 3, NULL] END AS l FROM catalogue)), LATERAL (
SELECT unnest(CASE WHEN doc_id % 5 = 0 AND n > 0 AND NOT bad THEN l WHEN doc_id % 5 <> 0 AND page_count >= 2 THEN [1, 2] ELSE [NULL] END) AS p)""", "catalogue")
def page_lists(spark, sf_dir):
    """Wanted pages by lists, which go before ranges: repeated pages stay, empty lists and pages that aren't there are errors."""
    k = F.col("doc_id") % 15
    listed = F.when(k == 0, F.array(F.lit(1), F.col("page_count"), F.lit(1))).when(k == 5, F.array().cast("array<int>")).when(k == 10, F.array(F.lit(1), F.lit(3), F.lit(None).cast("int")))
    c = derive.catalogue(spark, sf_dir).select("doc_id", "page_count", F.lit(1).alias("range_start"), F.lit(2).alias("range_end"), listed.alias("wanted"))
    return filters.expand_ranges(c, listed="wanted").select("doc_id", "error", "page")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN NULL ELSE 'an area needs two points' END AS error,
CASE WHEN doc_id % 4 < 2 THEN doc_id || ' 2 | ' || (doc_id + 3) || ' 2 | ' || (doc_id + 3) || ' 9 | ' || doc_id || ' 9' END AS corners, CASE WHEN doc_id % 4 < 2 THEN doc_id || ' 2 |  | ' || (doc_id + 3) || ' 9 | ' END AS slots FROM documents""")
def area_corners(spark, sf_dir):
    """Both forms of checked areas as text; a number that isn't finite is no corner."""
    d = F.col("doc_id").cast("double")
    odd = F.when(F.col("doc_id") % 4 == 2, F.lit(float("nan"))).when(F.col("doc_id") % 4 == 3, F.lit(float("inf"))).otherwise(9.0)
    points = F.array(F.array(d, F.lit(2.0)), F.array(d + 3, odd))
    shown = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda p: F.array_join(F.transform(p, lambda v: v.cast("long").cast("string")), " ")), " | ")).alias(c)
    checked = filters.check_areas(derive.table(spark, sf_dir, "documents").select("doc_id", points.alias("points")))
    return checked.select("doc_id", "error", shown("corners"), shown("slots"))


@query("""SELECT doc_id, CASE WHEN open THEN 'ready' WHEN doc_id % 3 = 0 THEN 'wrong password' ELSE 'password needed' END AS status, CASE WHEN NOT open AND doc_id % 3 <> 0 THEN 202 END AS code,
CASE WHEN open THEN NULL WHEN doc_id % 3 = 0 THEN '[Error] Incorrect password. [secret ' || doc_id || ']' ELSE 'The doc is encrypted, please fill in the password.' END AS message FROM (SELECT doc_id, NOT is_encrypted OR is_authenticated AS open FROM catalogue)""", "catalogue")
def password_outcomes(spark, sf_dir):
    word = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("secret "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, "")
    c = derive.catalogue(spark, sf_dir).withColumn("password", word)
    return filters.admit_documents(c, "password").select("doc_id", "status", "code", "message")


@query("SELECT 'mixed' AS mode, job_id, count(*) AS n FROM blocks GROUP BY job_id UNION ALL SELECT CASE origin WHEN 'ocr' THEN 'imageOnly' ELSE 'textOnly' END, job_id, count(*) FROM blocks GROUP BY origin, job_id", "blocks")
def extraction_mode(spark, sf_dir):
    b = derive.blocks(spark, sf_dir)
    parts = [filters.by_mode(b, m).groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("mode"), "job_id", "n") for m in ("mixed", "fullPage", "imageOnly", "textOnly")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT page_id, w AS width, h AS height FROM (SELECT page_id, page_id % 7 - 1 AS w, page_id % 5 - 1 AS h FROM pages) WHERE w > 0 AND h > 0")
def drop_degenerate(spark, sf_dir):
    return filters.without_degenerate(derive.table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 7 - 1).alias("width"), (F.col("page_id") % 5 - 1).alias("height")))
