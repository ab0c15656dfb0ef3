"""Queries on results, progress, times and order."""

from pyspark.sql import functions as F

from pagewright import derive
from pagewright.operators import filters, results
from pagewright.queries.filtering import AREA_SQL, CLAMPED, INSIDE, areas_of
from pagewright.registry import query
from pagewright.storage import scratch
from pagewright.streaming import jobs

SURVIVING = f"(SELECT * FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM {AREA_SQL} a WHERE {INSIDE}))"


def surviving(spark, sf_dir):
    b = derive.blocks(spark, sf_dir)
    return filters.ignore_areas(b, areas_of(spark, b))


@query("SELECT doc_id, page, round(coalesce(avg(score), 0), 9) AS confidence FROM page_list LEFT JOIN blocks USING (doc_id, page) GROUP BY doc_id, page", "page_list")
def page_confidence(spark, sf_dir):
    return results.confidence(derive.pages(spark, sf_dir).select("doc_id", "page"), derive.blocks(spark, sf_dir)).select("doc_id", "page", F.round("confidence", 9).alias("confidence"))


@query(f"SELECT doc_id, page, round(coalesce(avg(s.score), 0), 9) AS confidence FROM page_list LEFT JOIN {SURVIVING} s USING (doc_id, page) GROUP BY doc_id, page", "page_list")
def surviving_confidence(spark, sf_dir):
    return results.confidence(derive.pages(spark, sf_dir).select("doc_id", "page"), surviving(spark, sf_dir)).select("doc_id", "page", F.round("confidence", 9).alias("confidence"))


FEW = "(SELECT * FROM blocks WHERE (doc_id + page) % 4 <> 0)"


@query(f"SELECT r.doc_id, r.page, CASE WHEN r.code = 100 AND coalesce(n, 0) = 0 THEN 101 ELSE r.code END AS code, coalesce(n, 0) AS n_left FROM page_results r LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM {FEW} GROUP BY ALL) USING (doc_id, page)", "page_results")
def page_codes(spark, sf_dir):
    left = derive.blocks(spark, sf_dir).filter((F.col("doc_id") + F.col("page")) % 4 != 0)
    return results.image_codes(derive.page_results(spark, sf_dir).select("doc_id", "page", "code"), left).select("doc_id", "page", "code", "n_left")


PARTS = "(SELECT doc_id, page, code, message, CASE WHEN code = 100 AND doc_id % 3 <> 0 THEN n_blocks ELSE 0 END AS n_blocks, 1 AS part_no FROM page_results UNION ALL SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN 904 ELSE 101 END, CASE WHEN page % 3 = 0 THEN 'bad image' END, 0, 2 FROM page_results)"


def parts_of(spark, sf_dir):
    r = derive.page_results(spark, sf_dir).select("doc_id", "page", "code", "message", "n_blocks")
    first = r.withColumn("n_blocks", F.when((F.col("code") == 100) & (F.col("doc_id") % 3 != 0), F.col("n_blocks")).otherwise(0)).withColumn("part_no", F.lit(1))
    third = F.col("page") % 3 == 0
    second = r.select("doc_id", "page", F.when(third, 904).otherwise(101).alias("code"), F.when(third, "bad image").alias("message"), F.lit(0).cast("long").alias("n_blocks"), F.lit(2).alias("part_no"))
    return first.unionByName(second)


@query(f"SELECT doc_id, page, CASE WHEN sum(n_blocks) > 0 THEN 100 WHEN count(*) FILTER (code NOT IN (100, 101)) > 0 THEN 102 ELSE 101 END AS code, sum(n_blocks)::BIGINT AS n_blocks FROM {PARTS} GROUP BY doc_id, page", "page_results")
def doc_page_codes(spark, sf_dir):
    return results.document_codes(parts_of(spark, sf_dir)).select("doc_id", "page", "code", "n_blocks")


@query(f"SELECT doc_id, page, coalesce('[Error] Doc P' || page || chr(10) || string_agg('[Error] OCR code:' || code || ' msg:' || coalesce(message, '') || chr(10), '' ORDER BY part_no) FILTER (code NOT IN (100, 101)), '') AS message FROM {PARTS} GROUP BY doc_id, page", "page_results")
def page_errors(spark, sf_dir):
    return results.document_codes(parts_of(spark, sf_dir)).select("doc_id", "page", "message")


BARCODE_TEXT = """SELECT img_id, code, CASE code WHEN 100 THEN t WHEN 101 THEN 'No code in image.' ELSE '[Error] Code: ' || code || chr(10) || 'Message: ' || CASE code WHEN 202 THEN 'no image' ELSE '【Error】' || found || '组二维码解码失败。' || chr(10) || 'Failed to decode ' || found || ' sets of QR codes.' END END AS text FROM (
SELECT img_id, found, t, CASE WHEN img_id % 41 = 0 THEN 202 WHEN coalesce(found, 0) = 0 THEN 101 WHEN ok = 0 THEN 102 ELSE 100 END AS code FROM (SELECT page_id AS img_id FROM pages) LEFT JOIN (
SELECT img_id, count(*) AS found, count(*) FILTER (valid) AS ok, string_agg(code_no || ':' || content_type, chr(10) ORDER BY code_no) FILTER (valid) AS t FROM (SELECT * REPLACE (code_no % 13 <> 0 AND img_id % 7 <> 0 AS valid) FROM barcodes) GROUP BY img_id) USING (img_id))"""


@query(BARCODE_TEXT, "barcodes")
def barcode_text(spark, sf_dir):
    """Images by page, some of them unreadable, some with codes that are all invalid."""
    codes = derive.barcodes(spark, sf_dir).withColumns({"valid": F.col("valid") & (F.col("img_id") % 7 != 0), "text": F.concat(F.col("code_no").cast("string"), F.lit(":"), "content_type")})
    unreadable = F.col("page_id") % 41 == 0
    images = derive.table(spark, sf_dir, "pages").select(F.col("page_id").alias("img_id"), F.when(unreadable, 202).alias("code"), F.when(unreadable, "no image").alias("message"))
    return results.barcode_texts(codes, images)


@query(f"SELECT img_id, CASE WHEN row_number() OVER (PARTITION BY img_id % 5 ORDER BY img_id) > 1 THEN chr(10) ELSE '' END || text AS piece FROM ({BARCODE_TEXT})", "barcodes")
def barcode_batches(spark, sf_dir):
    """The same for batches of images: what each adds to its batch's text."""
    texts = barcode_text(spark, sf_dir).withColumn("batch", F.col("img_id") % 5)
    return results.barcode_pieces(texts, ["batch"]).select("img_id", "piece")


@query("""SELECT job_id, processed_count, pages_count, failed_count, processed_count = pages_count AS is_done, CASE WHEN processed_count = pages_count AND failed_count = 0 THEN 'success' WHEN processed_count = pages_count THEN 'failure' WHEN processed_count > 0 THEN 'running' ELSE 'waiting' END AS state FROM (
SELECT p.job_id, count(r.code) AS processed_count, count(*) AS pages_count, count(*) FILTER (r.code NOT IN (100, 101)) AS failed_count FROM page_list p LEFT JOIN page_results r USING (doc_id, page) GROUP BY p.job_id)""", "page_results")
def job_progress(spark, sf_dir):
    return results.job_progress(derive.pages(spark, sf_dir), derive.page_results(spark, sf_dir))


@query(f"SELECT job_id, pages, encrypted, coalesce(failed, 0) AS failed FROM (SELECT job_id, sum(b - a + 1)::BIGINT AS pages, count(*) FILTER (is_encrypted) AS encrypted FROM {CLAMPED} GROUP BY job_id) LEFT JOIN (SELECT job_id, count(*) FILTER (code NOT IN (100, 101)) AS failed FROM page_results GROUP BY job_id) USING (job_id)", "catalogue", "page_results")
def batch_totals(spark, sf_dir):
    a, b = filters.clamp_range(F.col("range_start"), F.col("range_end"), F.col("page_count"))
    docs = derive.catalogue(spark, sf_dir).select("job_id", "is_encrypted", a.alias("range_start"), b.alias("range_end"))
    return results.batch_totals(docs, results=derive.page_results(spark, sf_dir))


@query("SELECT p.job_id, count(*) FILTER (r.code IS NULL) AS n FROM page_list p LEFT JOIN page_results r USING (doc_id, page) GROUP BY p.job_id", "page_results")
def queue_lengths(spark, sf_dir):
    return results.queue_lengths(derive.pages(spark, sf_dir), derive.page_results(spark, sf_dir))


@query("SELECT job_id, count(*) AS n, round(avg(time_s), 9) AS mean_s, round(sum(time_s), 6) AS total_s, max(finished_s) AS last_s FROM page_results GROUP BY job_id", "page_results")
def task_durations(spark, sf_dir):
    r = derive.page_results(spark, sf_dir)
    return r.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("time_s"), 9).alias("mean_s"), F.round(F.sum("time_s"), 6).alias("total_s"), F.max("finished_s").alias("last_s"))


@query("""SELECT job_id, (max(us) - min(us) - sum(CASE WHEN action = 'pause' AND after IS NOT NULL THEN after - us ELSE 0 END))::BIGINT / 1000000 AS active_s FROM (
SELECT *, lead(us) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS after FROM (SELECT *, epoch_us(ts) AS us FROM control_events)) GROUP BY job_id""", "control_events")
def active_time(spark, sf_dir):
    return results.active_time(derive.control_events(spark, sf_dir))


@query("SELECT job_id, count(*) AS n, round(avg(s), 6) AS mean_s, round(sum(s), 6) AS total_s, max(finished_s) AS last_s FROM (SELECT job_id, finished_s, (epoch_us(make_timestamp(finished_s * 1000000)) - epoch_us(make_timestamp(finished_s * 1000000 - 50000 - page % 10 * 10000))) / 1000000::DOUBLE AS s FROM page_results) GROUP BY job_id", "page_results")
def run_durations(spark, sf_dir):
    """Durations from when each page began and ended."""
    micros = F.col("finished_s") * 1_000_000
    r = derive.page_results(spark, sf_dir).select("job_id", F.timestamp_micros(micros - 50_000 - F.col("page") % 10 * 10_000).alias("started_at"), F.timestamp_micros(micros).alias("ended_at"))
    return results.task_durations(r).select("job_id", "n", F.round("mean_s", 6).alias("mean_s"), F.round("total_s", 6).alias("total_s"), F.unix_seconds("last_ended_at").alias("last_s"))


@query("""SELECT job_id, (1706572800000000 - min(us) - sum(CASE WHEN action = 'pause' THEN coalesce(after, 1706572800000000) - us ELSE 0 END))::BIGINT / 1000000 AS active_s FROM (
SELECT *, lead(us) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS after FROM (SELECT *, epoch_us(ts) AS us FROM control_events)) GROUP BY job_id""", "control_events")
def active_until_now(spark, sf_dir):
    """Active time up to a given moment, open pauses included."""
    return results.active_time(derive.control_events(spark, sf_dir), now=F.timestamp_seconds(F.lit(1706572800)))


@query("SELECT img_id, coalesce(found, 0) AS found, coalesce(ok, 0) AS valid, CASE WHEN coalesce(found, 0) = 0 THEN 101 WHEN ok = 0 THEN 102 ELSE 100 END AS code FROM (SELECT page_id AS img_id FROM pages) LEFT JOIN (SELECT img_id, count(*) AS found, count(*) FILTER (valid) AS ok FROM barcodes GROUP BY img_id) USING (img_id)", "barcodes")
def barcode_outcome(spark, sf_dir):
    images = derive.table(spark, sf_dir, "pages").select(F.col("page_id").alias("img_id"))
    return results.barcode_outcome(derive.barcodes(spark, sf_dir), images)


@query("SELECT doc_id, page, k, k || '/' || page_count AS label, k / page_count::DOUBLE AS ratio FROM (SELECT r.doc_id, r.page, c.page_count, least(row_number() OVER (PARTITION BY r.doc_id ORDER BY r.finished_s, r.page), c.page_count)::INTEGER AS k FROM page_results r JOIN catalogue c USING (doc_id))", "page_results", "catalogue")
def running_progress(spark, sf_dir):
    r = derive.page_results(spark, sf_dir).select("doc_id", "page", "finished_s").join(derive.catalogue(spark, sf_dir).select("doc_id", "page_count"), "doc_id")
    return results.running_progress(r, "doc_id", ["finished_s", "page"], "page_count").select("doc_id", "page", F.col("k").cast("int").alias("k"), "label", "ratio")


@query("SELECT r.doc_id, r.page, r.page - a + 1 AS k, (r.page - a + 1) || '/' || (b - a + 1) AS label, (r.page - a + 1) / (b - a + 1)::DOUBLE AS ratio FROM page_results r JOIN " + CLAMPED + " c USING (doc_id) WHERE r.page BETWEEN a AND b", "page_results", "catalogue")
def page_progress(spark, sf_dir):
    """How far each page is in its document's range."""
    a, b = filters.clamp_range(F.col("range_start"), F.col("range_end"), F.col("page_count"))
    r = derive.page_results(spark, sf_dir).select("doc_id", "page").join(derive.catalogue(spark, sf_dir).select("doc_id", a.alias("range_start"), b.alias("range_end")), "doc_id")
    return results.page_progress(r.filter("page between range_start and range_end")).select("doc_id", "page", "k", "label", "ratio")


@query("SELECT p.job_id, doc_id, page, row_number() OVER (PARTITION BY p.job_id ORDER BY doc_id, page)::INTEGER AS round, turn FROM page_list p JOIN (SELECT job_id, CASE WHEN n = 1 THEN count(*) OVER () ELSE n - 1 END::INTEGER AS turn FROM (SELECT job_id, row_number() OVER (ORDER BY job_id) AS n FROM (SELECT DISTINCT job_id FROM page_list))) j ON j.job_id = p.job_id", "page_list")
def task_turns(spark, sf_dir):
    found = results.turns(derive.pages(spark, sf_dir).select("job_id", "doc_id", "page"))
    return found.select("job_id", "doc_id", "page", *[F.col(c).cast("int").alias(c) for c in ("round", "turn")])


@query("SELECT doc_id, page, round(CASE WHEN r.code = 100 THEN coalesce(avg(b.score), 0) ELSE 0 END, 9) AS confidence FROM page_results r LEFT JOIN blocks b USING (doc_id, page) GROUP BY doc_id, page, r.code", "page_results")
def coded_confidence(spark, sf_dir):
    """Confidence of pages with a result: 0 unless it is text."""
    r = derive.page_results(spark, sf_dir).select("doc_id", "page", "code")
    return results.confidence(r, derive.blocks(spark, sf_dir)).select("doc_id", "page", F.round("confidence", 9).alias("confidence"))


@query("SELECT job_id, doc_id, page, row_number() OVER (PARTITION BY job_id ORDER BY doc_id, page)::INTEGER AS round FROM page_list", "page_list")
def fair_order(spark, sf_dir):
    return results.fair_order(derive.pages(spark, sf_dir).select("job_id", "doc_id", "page")).withColumn("round", F.col("round").cast("int"))


@query("SELECT job_id, doc_id, page, row_number() OVER (ORDER BY job_id, doc_id, page) AS place FROM page_list", "page_list")
def sequential_order(spark, sf_dir):
    return results.sequential_order(derive.pages(spark, sf_dir).select("job_id", "doc_id", "page"))


@query("SELECT doc_id, page, block_no FROM blocks WHERE NOT block_no BETWEEN least(30 - doc_id % 20, 20) AND greatest(30 - doc_id % 20, 20)", "blocks")
def delete_range(spark, sf_dir):
    return results.delete_range(derive.blocks(spark, sf_dir), "block_no", 30 - F.col("doc_id") % 20, F.lit(20)).select("doc_id", "page", "block_no")


@query("SELECT doc_id, page, block_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN block_no % 3 = 0 THEN 0 ELSE 1 END, block_no)::INTEGER - 1 AS seq FROM blocks", "blocks")
def all_blocks(spark, sf_dir):
    b = derive.blocks(spark, sf_dir).select("doc_id", "page", "block_no")
    return results.all_blocks(b.filter("block_no % 3 = 0"), b.filter("block_no % 3 <> 0"))


@query("SELECT doc_id, page, block_no, text, x0 AS x, y1 AS y, x1 - x0 AS width, y1 - y0 AS height FROM blocks JOIN (SELECT doc_id, page FROM page_results WHERE code = 100) USING (doc_id, page) WHERE origin <> 'text'", "page_results")
def text_layer(spark, sf_dir):
    return results.text_layer(derive.blocks(spark, sf_dir), derive.page_results(spark, sf_dir))


@query("""SELECT job_id, CASE WHEN max_by(ended, o) = 1 THEN 'stopped' WHEN max_by(started, o) = 0 THEN 'waiting' WHEN max_by(paused, o) = 1 THEN 'paused' ELSE 'running' END AS state, count(*) FILTER (action = 'page_done' AND ended = 0 AND started = 1 AND paused = 0) AS pages_done FROM (
SELECT job_id, action, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS o, max(CASE WHEN action IN ('fail', 'stop') THEN 1 ELSE 0 END) OVER w AS ended, max(CASE WHEN action IN ('start', 'resume') THEN 1 ELSE 0 END) OVER w AS started,
coalesce(last_value(CASE WHEN action = 'pause' THEN 1 WHEN action IN ('start', 'resume') THEN 0 END IGNORE NULLS) OVER w, 0) AS paused FROM control_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY job_id""", "control_events")
def lifecycle(spark, sf_dir):
    return results.job_states(derive.control_events(spark, sf_dir))


OUTCOMES = """WITH s AS (SELECT *, max(CASE WHEN action IN ('fail', 'stop') THEN 1 ELSE 0 END) OVER w AS ended, max(CASE WHEN action IN ('start', 'resume') THEN 1 ELSE 0 END) OVER w AS started,
coalesce(last_value(CASE WHEN action = 'pause' THEN 1 WHEN action IN ('start', 'resume') THEN 0 END IGNORE NULLS) OVER w, 0) AS paused FROM task_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT take.job_id, take.task, take.ended + take.paused = 0 AND take.started = 1 AS held, res.ts, CASE WHEN res.started = 0 OR res.ended = 1 THEN NULL WHEN res.paused = 1 THEN 'again' ELSE 'done' END AS outcome FROM s take JOIN s res ON take.task = res.task AND take.action = 'take' AND res.action = 'done'),
e AS (SELECT job_id, min(ts) AS ts, arg_min(action, (ts, event_id)) AS action FROM task_events WHERE action IN ('stop', 'fail') GROUP BY job_id),
o AS (SELECT job_id, task, ts, outcome, NULL AS message FROM t WHERE held AND outcome IS NOT NULL
UNION ALL SELECT job_id, NULL, ts, CASE action WHEN 'stop' THEN 'stopped' ELSE 'failed' END, CASE action WHEN 'stop' THEN '[Warning] Task stop.' ELSE '[Error] Task failed.' END FROM e
UNION ALL SELECT t.job_id, t.task, e.ts, 'dropped', NULL FROM t JOIN e ON t.job_id = e.job_id WHERE t.held AND t.outcome IS DISTINCT FROM 'done')
SELECT job_id, task, epoch_us(ts) AS micros, outcome, message FROM o""".replace("WITH s", ", s", 1)


@query(OUTCOMES, "task_events")
def task_outcomes(spark, sf_dir):
    """What becomes of each task, and how jobs end."""
    return results.task_outcomes(derive.task_events(spark, sf_dir)).select("job_id", "task", F.unix_micros("ts").alias("micros"), "outcome", "message")


def streamed(spark, events, cuts, change):
    """The rows that ``change`` makes of a stream of ``events``, which come in as many batches as ``cuts`` part, a run for each: a batch may have any number of files."""
    came, seen, checkpoint = scratch(spark, "events"), scratch(spark, "changes"), scratch(spark, "states")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        times = [F.lit(t).cast("timestamp") for t in cuts]
        for i in range(len(cuts) + 1):
            part = events.filter(F.col("ts") >= times[i - 1]) if i else events
            (part.filter(F.col("ts") < times[i]) if i < len(cuts) else part).write.mode("append").parquet(came)
            stream = spark.readStream.schema(events.schema).parquet(came)
            q = change(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(seen)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(seen)


@query(OUTCOMES, "task_events")
def tasks_in_hand(spark, sf_dir):
    """The same from a stream that keeps the tasks in hand of each job as its state."""
    found = streamed(spark, derive.task_events(spark, sf_dir), ["2024-01-08", "2024-01-16"], jobs.task_changes)
    return found.select("job_id", "task", F.unix_micros("ts").alias("micros"), "outcome", "message")


@query("""SELECT job_id, epoch_us(ts) AS micros, state FROM (
WITH RECURSIVE ev AS (SELECT job_id, ts, action FROM control_events),
lives AS (SELECT job_id, min(ts) AS ts FROM ev GROUP BY job_id
UNION ALL SELECT l.job_id, (SELECT min(n.ts) FROM ev n WHERE n.job_id = l.job_id AND n.ts >= (SELECT min(f.ts) FROM ev f WHERE f.job_id = l.job_id AND f.action = 'fail' AND f.ts >= l.ts) + INTERVAL 24 HOURS) AS ts FROM lives l WHERE l.ts IS NOT NULL),
ended AS (SELECT job_id, ts, (SELECT min(f.ts) FROM ev f WHERE f.job_id = l.job_id AND f.action = 'fail' AND f.ts >= l.ts) AS end_ts FROM lives l WHERE ts IS NOT NULL)
SELECT job_id, ts, 'admitted' AS state FROM ended UNION ALL SELECT job_id, end_ts, 'stopped' FROM ended WHERE end_ts IS NOT NULL
UNION ALL SELECT job_id, end_ts + INTERVAL 24 HOURS, 'expired' FROM ended e WHERE end_ts + INTERVAL 24 HOURS <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR OR end_ts + INTERVAL 24 HOURS <= (SELECT max(ts) FROM ev n WHERE n.job_id = e.job_id))""", "control_events")
def expiring_jobs(spark, sf_dir):
    """Jobs that a stream admits, sees end, forgets a day later and admits anew, on event time."""
    events = derive.control_events(spark, sf_dir).select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action")
    found = streamed(spark, events, ["2024-01-05", "2024-01-06", "2024-01-20"], lambda s: jobs.job_changes(s, hours=24))
    return found.filter("state in ('admitted', 'stopped', 'expired')").select("job_id", F.unix_micros("ts").alias("micros"), "state")


@query("SELECT job_id, max(ts) AS ended_at FROM control_events GROUP BY job_id HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOURS", "control_events")
def expired_jobs(spark, sf_dir):
    ended = derive.control_events(spark, sf_dir).groupBy("job_id").agg(F.max("ts").alias("ended_at"))
    return results.expired(ended, F.expr("timestamp '2024-01-30 00:00:00'"))
