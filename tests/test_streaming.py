"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from pagewright import derive
from pagewright.operators import results
from pagewright.streaming import jobs

SCHEMA = "job_id string, doc_id long, page int, code int"


@pytest.fixture
def folder(spark, sf, tmp_path):
    r = derive.page_results(spark, sf).select("job_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("code").cast("int").alias("code"))
    r.filter("doc_id < 50").coalesce(1).write.parquet(str(tmp_path / "in"))
    return r, str(tmp_path / "in"), str(tmp_path / "check")


def test_unread_results_come_once(spark, folder):
    r, path, check = folder
    polls = []
    take = lambda df, n: polls.append({(x.doc_id, x.page) for x in df.collect()})
    jobs.unread_results(spark, path, SCHEMA, check, take)
    jobs.unread_results(spark, path, SCHEMA, check, take)
    r.filter("doc_id >= 50").repartition(2).write.mode("append").parquet(path)
    jobs.unread_results(spark, path, SCHEMA, check, take, each=1)
    jobs.unread_results(spark, path, SCHEMA, check, take)
    polls = [p for p in polls if p]
    assert len(polls) == 3 and sum(map(len, polls)) == len(set.union(*polls))
    assert set.union(*polls) == {(x.doc_id, x.page) for x in r.collect()}


def test_live_progress(spark, folder):
    r, path, check = folder
    r.filter("doc_id >= 50").repartition(2).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = jobs.live_progress(stream).writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = r.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("code").isin(100, 101)).alias("f"))
    assert {tuple(x) for x in spark.table("progress").collect()} == {tuple(x) for x in batch.collect()}


def test_job_changes(spark, sf, tmp_path):
    events = derive.control_events(spark, sf).select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action").filter("job_id < 40")
    path = str(tmp_path / "in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = events.orderBy("ts", "event_id")
        first = events.filter(F.col("ts") <= F.lit(events.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]))
        first.coalesce(1).write.parquet(path)
        stream = spark.readStream.schema("job_id long, event_id long, ts timestamp, action string").parquet(path)

        def run():
            seen: list = []
            q = jobs.job_changes(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            q.awaitTermination()
            return seen

        changes = run()
        events.join(first.select("event_id"), "event_id", "left_anti").coalesce(1).write.mode("append").parquet(path)
        changes += run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last: dict = {}
    for r in changes:
        last[r.job_id] = r.state
    batch = {r.job_id: r.state for r in results.job_states(events).collect()}
    started = {j: s for j, s in batch.items() if s != "waiting"}
    assert last == started


def run_stream(spark, rows, schema, change, folder, files):
    """The rows a stream emits when ``rows`` come in so many files, one a batch."""
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("ts"))
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    step = -(-len(ordered) // files)
    for i in range(0, len(ordered), step):
        ids = [r[1] for r in ordered[i : i + step]]
        df.filter(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen: list = []
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        q = change(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return df, seen


TASKS = [
    # A result counts; one in a pause doesn't, until the task is run again; a result without its task is nothing.
    (1, "take", 7), (1, "start", None), (1, "take", 8), (1, "done", 8), (1, "done", 8), (1, "take", 9), (1, "pause", None), (1, "take", 10), (1, "done", 9), (1, "done", 9), (1, "resume", None), (1, "done", 10), (1, "take", 9), (1, "done", 9),
    # A stop drops what is in hand, also what a pause kept; nothing counts afterwards.
    (2, "start", None), (2, "take", 20), (2, "take", 21), (2, "pause", None), (2, "done", 20), (2, "resume", None), (2, "stop", None), (2, "done", 21), (2, "fail", None), (2, "start", None), (2, "take", 22),
    (3, "fail", None), (3, "start", None),
]
OUTCOMES = {(1, 8, 3, "done"), (1, 9, 8, "again"), (1, 9, 9, "again"), (1, 9, 13, "done"), (2, 20, 18, "again"), (2, None, 20, "stopped"), (2, 20, 20, "dropped"), (2, 21, 20, "dropped"), (3, None, 25, "failed")}


@pytest.mark.parametrize("files", [1, 5])
def test_tasks_in_hand(spark, tmp_path, files):
    rows = [(job, i, 1_700_000_000_000_000 + i * 1_000_000, action, task) for i, (job, action, task) in enumerate(TASKS)]
    df, seen = run_stream(spark, rows, "job_id long, event_id long, ts long, action string, task long", jobs.task_changes, tmp_path, files)
    plain = lambda rs: sorted(((r.job_id, r.task, int(r.ts.timestamp()) - 1_700_000_000, r.outcome) for r in rs), key=str)
    assert plain(seen) == sorted(OUTCOMES, key=str) == plain(results.task_outcomes(df).collect())
    assert {r.message for r in seen if r.outcome == "stopped"} == {"[Warning] Task stop."}


@pytest.mark.parametrize("files", [1, 4])
def test_jobs_expire_on_event_time(spark, tmp_path, files):
    """Two lives of one job, the first one ended by its own later event or by the watermark; the query ends with its input."""
    hour = 3_600_000_000
    at = [(1, 0, "start"), (1, 1, "stop"), (1, 2, "start"), (2, 3, "start"), (1, 30, "start"), (2, 31, "page_done"), (1, 40, "stop"), (3, 41, "stop"), (2, 70, "page_done")]
    rows = [(job, i, 1_700_000_000_000_000 + h * hour, action) for i, (job, h, action) in enumerate(at)]
    _, seen = run_stream(spark, rows, "job_id long, event_id long, ts long, action string", lambda s: jobs.job_changes(s, hours=24), tmp_path, files)
    got = sorted((r.job_id, round((r.ts.timestamp() - 1_700_000_000) / 3600), r.state) for r in seen)
    assert got == sorted([(1, 0, "admitted"), (1, 0, "running"), (1, 1, "stopped"), (1, 25, "expired"), (1, 30, "admitted"), (1, 30, "running"), (1, 40, "stopped"), (1, 64, "expired"), (2, 3, "admitted"), (2, 3, "running"), (3, 41, "admitted"), (3, 41, "stopped"), (3, 65, "expired")])
