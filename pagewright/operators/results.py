"""Aggregates over results: confidence, codes, progress, totals, times, barcodes, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.assembly import joined
from pagewright.operators.order import numbered, scan
from pagewright.storage import saved

PAGE = ("doc_id", "page")


def confidence(pages: DataFrame, blocks: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Mean score of each page's blocks, 0 for a page without any, or, if ``pages`` have a code, with another one than 100."""
    mean = blocks.groupBy(*keys).agg(F.avg("score").alias("confidence"))
    value = F.coalesce("confidence", F.lit(0.0))
    return pages.join(mean, list(keys), "left").withColumn("confidence", F.when(F.col("code") == 100, value).otherwise(0.0) if "code" in pages.columns else value)


def image_codes(results: DataFrame, surviving: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Final code of image pages: 100 becomes 101 if no block is left."""
    n = surviving.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    out = results.join(n, list(keys), "left").withColumn("n_left", F.coalesce("n_left", F.lit(0)))
    return out.withColumn("code", F.when((F.col("code") == 100) & (F.col("n_left") == 0), 101).otherwise(F.col("code")))


def document_codes(parts: DataFrame, keys: Sequence[str] = PAGE, order: str = "part_no") -> DataFrame:
    """Final code and message of document pages from their parts: any text is 100, else any failure 102, else 101."""
    failed = ~F.col("code").isin(100, 101)
    message = joined(F.when(failed, F.concat(F.lit("[Error] OCR code:"), F.col("code").cast("string"), F.lit(" msg:"), F.coalesce("message", F.lit("")), F.lit("\n"))), F.col(order))
    out = parts.groupBy(*keys).agg(F.sum("n_blocks").alias("n_blocks"), F.count_if(failed).alias("n_failed"), message.alias("message"))
    code = F.when(F.col("n_blocks") > 0, 100).when(F.col("n_failed") > 0, 102).otherwise(101)
    return out.withColumn("code", code).withColumn("message", F.when(F.col("n_failed") > 0, F.concat(F.lit("[Error] Doc P"), F.col(keys[-1]).cast("string"), F.lit("\n"), F.col("message"))).otherwise(""))


def job_progress(tasks: DataFrame, results: DataFrame, job: str = "job_id", keys: Sequence[str] = PAGE) -> DataFrame:
    """Processed and all pages, state and whether a job is done."""
    done = results.select(*keys, F.lit(1).alias("__done"), F.col("code").alias("__code"))
    out = tasks.join(done, list(keys), "left").groupBy(job).agg(F.count("__done").alias("processed_count"), F.count(F.lit(1)).alias("pages_count"), F.count_if(~F.col("__code").isin(100, 101)).alias("failed_count"))
    over = F.col("processed_count") == F.col("pages_count")
    return out.withColumns({"is_done": over, "state": F.when(over & (F.col("failed_count") == 0), "success").when(over, "failure").when(F.col("processed_count") > 0, "running").otherwise("waiting")})


def batch_totals(docs: DataFrame, job: str = "job_id", results: DataFrame | None = None) -> DataFrame:
    """Pages in the ranges, encrypted documents and, with ``results``, how many of them failed."""
    out = docs.groupBy(job).agg(F.sum(F.col("range_end") - F.col("range_start") + 1).alias("pages"), F.count_if(F.col("is_encrypted")).alias("encrypted"))
    if results is None:
        return out
    failed = results.groupBy(job).agg(F.count_if(~F.col("code").isin(100, 101)).alias("failed"))
    return out.join(failed, job, "left").na.fill(0, ["failed"])


def task_durations(tasks: DataFrame, job: str = "job_id", started: str = "started_at", ended: str = "ended_at") -> DataFrame:
    """Each job's number of tasks, mean and total of their durations (end less start, in seconds) and last end."""
    seconds = (F.unix_micros(ended) - F.unix_micros(started)) / 1_000_000
    return tasks.groupBy(job).agg(F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("mean_s"), F.sum(seconds).alias("total_s"), F.max(ended).alias("last_ended_at"))


def queue_lengths(tasks: DataFrame, results: DataFrame, job: str = "job_id", keys: Sequence[str] = PAGE) -> DataFrame:
    """Tasks without a result by job; 0 for jobs that have all."""
    waiting = tasks.join(results.select(*keys), list(keys), "left_anti").groupBy(job).agg(F.count(F.lit(1)).alias("n"))
    return tasks.select(job).distinct().join(waiting, job, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def active_time(events: DataFrame, job: str = "job_id", order: Sequence[str] = ("ts", "event_id"), pause: str = "pause", now: Column | None = None) -> DataFrame:
    """Seconds from a job's first event to its last one, or to ``now``, without the stretches that a pause begins and the next event (or now) ends."""
    events = scan(events.select(*dict.fromkeys([job, *order, "ts", "action"])), [job], order, after=("after", "ts"))
    after = F.col("after") if now is None else F.coalesce("after", now)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    paused = F.when((F.col("action") == pause) & after.isNotNull(), micros(after) - micros(F.col("ts"))).otherwise(0)
    return events.withColumn("__paused", paused).groupBy(job).agg(((micros(F.max("ts") if now is None else F.any_value(now)) - micros(F.min("ts")) - F.sum("__paused")) / 1_000_000).alias("active_s"))


def barcode_outcome(codes: DataFrame, images: DataFrame, image: str = "img_id") -> DataFrame:
    """101 where nothing was found, 102 where nothing found is valid, else 100; and how many."""
    n = codes.groupBy(image).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("valid")).alias("valid"))
    out = images.join(n, image, "left").na.fill(0, ["found", "valid"])
    return out.withColumn("code", F.when(F.col("found") == 0, 101).when(F.col("valid") == 0, 102).otherwise(100))


def barcode_texts(codes: DataFrame, images: DataFrame, image: str = "img_id", order: str = "code_no", text: str = "text") -> DataFrame:
    """code and text of each image: its valid codes one a line, that there is none, or how reading it failed.

    ``images`` may have code and message of images that couldn't be read.
    """
    judged = barcode_outcome(codes, images.select(image), image)
    known = codes.groupBy(image).agg(joined(F.when(F.col("valid"), F.col(text)), F.col(order), "\n").alias("__text"))
    failed = images.select(image, *[F.col(c).alias(f"__{c}") if c in images.columns else F.lit(None).cast(t).alias(f"__{c}") for c, t in (("code", "int"), ("message", "string"))])
    out = judged.join(known, image, "left").join(failed, image)
    n = F.col("found").cast("string")
    # Fixed value: what is said of codes that are all invalid.
    invalid = F.concat(F.lit("【Error】"), n, F.lit("组二维码解码失败。\nFailed to decode "), n, F.lit(" sets of QR codes."))
    code = F.coalesce("__code", "code")
    said = F.concat(F.lit("[Error] Code: "), code.cast("string"), F.lit("\nMessage: "), F.coalesce("__message", F.when(F.col("code") == 102, invalid), F.lit("")))
    return out.select(image, code.alias("code"), F.when(code == 100, F.col("__text")).when(code == 101, "No code in image.").otherwise(said).alias("text"))


def barcode_pieces(texts: DataFrame, batch: Sequence[str], order: str = "img_id") -> DataFrame:
    """What each image of ``barcode_texts`` adds to its batch's text, in a column ``piece``: its text, after a line end unless it is the first. A sink writes the pieces in order; no row holds a whole batch."""
    first = numbered(texts.select(*batch, order), batch, [order], "__k")
    met = texts.join(first, [*batch, order])
    return met.withColumn("piece", F.concat(F.when(F.col("__k") > 1, "\n").otherwise(""), F.coalesce("text", F.lit("")))).drop("__k")


def page_progress(results: DataFrame, first: str = "range_start", last: str = "range_end") -> DataFrame:
    """How far each page is in its document's range: k is its place there, with label and ratio."""
    k, n = F.col("page") - F.col(first) + 1, F.col(last) - F.col(first) + 1
    return results.withColumns({"k": k, "label": F.concat(k.cast("string"), F.lit("/"), n.cast("string")), "ratio": k / n})


def running_progress(results: DataFrame, job: str, order: Sequence[str], total: str) -> DataFrame:
    """How many results a job has at each one, never more than its total, as number, label and ratio."""
    out = numbered(results, [job], order, "k").withColumn("k", F.least("k", total))
    return out.withColumns({"label": F.concat(F.col("k").cast("string"), F.lit("/"), F.col(total).cast("string")), "ratio": F.col("k") / F.col(total)})


def fair_order(tasks: DataFrame, job: str = "job_id", task: Sequence[str] = PAGE) -> DataFrame:
    """One task of each job in turn: round is a column, so that no global sort is needed to keep the order."""
    return numbered(tasks, [job], task, "round")


def turns(tasks: DataFrame, job: str = "job_id", task: Sequence[str] = PAGE) -> DataFrame:
    """``fair_order`` with the job's place in its round, from 1. Of several jobs the second one comes first and the first one last, as the turn passes on before it is used."""
    jobs = saved(tasks.select(job).distinct(), "jobs")
    n = jobs.count()
    places = numbered(jobs, [], [job], "number").select(job, (F.pmod(F.col("number") - 2, F.lit(max(n, 1))) + 1).alias("turn"))
    return fair_order(tasks, job, task).join(places, job)


def sequential_order(tasks: DataFrame, job: str = "job_id", task: Sequence[str] = PAGE) -> DataFrame:
    """The first job to its end, then the next: place counts from 1 over all tasks."""
    return numbered(tasks, [], [job, *task], "place")


def delete_range(rows: DataFrame, order: str, first: Column, last: Column) -> DataFrame:
    return rows.filter(~F.col(order).between(F.least(first, last), F.greatest(first, last)))


def all_blocks(native: DataFrame, recognised: DataFrame, keys: Sequence[str] = PAGE, order: str = "block_no") -> DataFrame:
    """Native blocks, then recognised ones, numbered anew within their page."""
    both = native.withColumn("__rank", F.lit(0)).unionByName(recognised.withColumn("__rank", F.lit(1)))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("__rank", order)) - 1).drop("__rank")


def text_layer(blocks: DataFrame, results: DataFrame, keys: Sequence[str] = PAGE, transparent: bool = True) -> DataFrame:
    """Where texts go in a text layer: left, bottom, width, height. A transparent layer leaves native text out."""
    good = results.filter("code = 100").select(*keys)
    kept = blocks.filter("origin <> 'text'") if transparent else blocks
    return kept.join(good, list(keys), "left_semi").select(*keys, order_of(blocks), "text", F.col("x0").alias("x"), F.col("y1").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))


def order_of(blocks: DataFrame) -> str:
    return "block_no" if "block_no" in blocks.columns else "seq"


def with_states(events: DataFrame, job: str = "job_id", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """``events`` with the job's state just after each: ended, started and paused, as 0 or 1."""
    out = scan(
        events,
        [job],
        order,
        ended=("max", F.when(F.col("action").isin("fail", "stop"), 1).otherwise(0)),
        started=("max", F.when(F.col("action").isin("start", "resume"), 1).otherwise(0)),
        paused=("last", F.when(F.col("action").isin("pause"), 1).when(F.col("action").isin("start", "resume"), 0)),
    )
    return out.withColumn("paused", F.coalesce("paused", F.lit(0)))


def job_states(events: DataFrame, job: str = "job_id", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """State of each job after all its control events, and its finished pages.

    waiting until started; a pause keeps the task in hand for later; after a failure
    or a stop nothing counts any more.
    """
    e = with_states(events.select(*dict.fromkeys([job, *order, "action"])), job, order)
    counts = (F.col("action") == "page_done") & (F.col("ended") == 0) & (F.col("started") == 1) & (F.col("paused") == 0)
    last = F.max_by(F.struct("ended", "started", "paused"), F.struct(*order))
    out = e.groupBy(job).agg(last.alias("l"), F.count_if(counts).alias("pages_done"))
    state = F.when(F.col("l.ended") == 1, "stopped").when(F.col("l.started") == 0, "waiting").when(F.col("l.paused") == 1, "paused").otherwise("running")
    return out.select(job, state.alias("state"), "pages_done")


#: How a job's end reads, by what ended it.
ENDS = {"stop": ("stopped", "[Warning] Task stop."), "fail": ("failed", "[Error] Task failed.")}


def task_outcomes(events: DataFrame, job: str = "job_id", task: str = "task", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """What becomes of tasks, and how their jobs end: the job, task (null for the job's own end), ts, outcome and message.

    Actions ``take`` and ``done`` are those of a task, the others those of the job. A task
    is in hand from when it is taken while the job runs until its result comes while the
    job runs (``done``); a result during a pause has to be made anew (``again``); what is
    in hand when the job ends is ``dropped``.
    """
    e = with_states(events.select(*dict.fromkeys([job, *order, "ts", "action", task])), job, order)
    going = (F.col("started") == 1) & (F.col("ended") == 0)
    runs = going & (F.col("paused") == 0)
    of_task = e.filter(F.col(task).isNotNull() & going)
    # The events of one task are few; a job's are not.
    w = Window.partitionBy(job, task).orderBy(*order)
    flag = F.when((F.col("action") == "take") & runs, 1).when((F.col("action") == "done") & runs, 0)
    held = F.coalesce(F.last(flag, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_task = of_task.select(job, task, *order, "ts", "action", flag.alias("flag"), held.alias("held"), runs.alias("runs"))
    came = of_task.filter((F.col("action") == "done") & (F.col("held") == 1)).select(job, task, "ts", F.when(F.col("runs"), "done").otherwise("again").alias("outcome"), F.lit(None).cast("string").alias("message"))
    ends = e.filter(F.col("action").isin(*ENDS)).groupBy(job).agg(F.min_by(F.struct("ts", "action"), F.struct(*order)).alias("e")).select(job, "e.ts", "e.action")
    said = lambda i: F.create_map(*[F.lit(x) for k, v in ENDS.items() for x in (k, v[i])])[F.col("action")]
    ended = ends.select(job, F.lit(None).cast(events.schema[task].dataType).alias(task), "ts", said(0).alias("outcome"), said(1).alias("message"))
    left = of_task.groupBy(job, task).agg(F.max_by("flag", F.when(F.col("flag").isNotNull(), F.struct(*order))).alias("flag")).filter("flag = 1")
    dropped = left.join(ends, job).select(job, task, "ts", F.lit("dropped").alias("outcome"), F.lit(None).cast("string").alias("message"))
    return came.unionByName(ended).unionByName(dropped)


def expired(jobs: DataFrame, now: Column, hours: int = 24, ended: str = "ended_at") -> DataFrame:
    """Jobs that ended more than ``hours`` ago."""
    return jobs.filter(F.col(ended) < now - F.expr(f"interval {hours} hours"))
