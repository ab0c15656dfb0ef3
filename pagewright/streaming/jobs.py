"""Streams of results and control events: unread results, live progress, job states, expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from pagewright.operators.order import numbered
from pagewright.operators.results import ENDS
from pagewright.storage import temporary


def unread_results(spark: SparkSession, folder: str, schema: str, checkpoint: str, take: Callable[[DataFrame, int], None], each: int | None = None, order: Sequence[str] | None = None) -> StreamingQuery:
    """Hands ``take`` the results that came since the last call with the same checkpoint, each once.

    ``take`` gets a batch and its number; writing by that number makes it safe to
    repeat after a failure. With ``order`` the batch has a column ``place``: each
    result's place in it, from 1, in the order in which they were finished.
    """
    stream = spark.readStream.schema(schema)
    if each:
        stream = stream.option("maxFilesPerTrigger", each)

    def placed(batch: DataFrame, number: int) -> None:
        with temporary(batch.sparkSession):
            take(numbered(batch, [], order, "place"), number)

    query = stream.parquet(folder).writeStream.foreachBatch(placed if order else take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Callbacks(StreamingQueryListener):
    """Calls of a run's watcher: ``started`` and ``ended`` once a query, ``progressed`` with the rows of each batch."""

    def __init__(self, started: Callable[[str], None] | None = None, progressed: Callable[[str, int], None] | None = None, ended: Callable[[str, str | None], None] | None = None):
        self.started, self.progressed, self.ended = started, progressed, ended

    def onQueryStarted(self, event) -> None:
        if self.started:
            self.started(str(event.id))

    def onQueryProgress(self, event) -> None:
        if self.progressed:
            self.progressed(str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.ended:
            self.ended(str(event.id), event.exception)


def live_progress(results: DataFrame, job: str = "job_id") -> DataFrame:
    """Processed and failed pages by job of a result stream, for update or complete mode. State: one row a job."""
    return results.groupBy(job).agg(F.count(F.lit(1)).alias("processed_count"), F.count_if(~F.col("code").isin(100, 101)).alias("failed_count"))


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """A key's events of one batch by time, then number."""
    events = [e for frame in rows for e in zip(*(frame[c].tolist() for c in ("micros", "event_id", *columns)))]
    events.sort(key=lambda e: e[:2])
    return (e[2:] for e in events)


class JobStates(StatefulProcessor):
    """Follows each job from waiting over running and paused to stopped; emits a row at every change of state.

    Per job it keeps the state, the count of finished pages and when it ended. With
    ``hours``, a job is admitted by its first event, and forgotten so long after its end:
    by a timer once the watermark is past that time, or by its own first event from then
    on, which admits it anew. Which of the two comes first doesn't change the rows.
    """

    def __init__(self, hours: float | None = None):
        self.keep = None if hours is None else round(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "state string, pages long, ended long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get()  # None for a new job; every call is a round trip
        known = stored is not None
        state, pages, ended = stored or ("waiting", 0, None)
        out = []
        for ts, action in _in_order(rows, "micros", "action"):
            if ended is not None and self.keep is not None and ts >= ended + self.keep:
                out.append((key[0], ended + self.keep, "expired", 0))
                self.handle.deleteTimer(self._timer(ended))
                state, pages, ended, known = "waiting", 0, None, False
            if not known and self.keep is not None:
                out.append((key[0], ts, "admitted", 0))
            known, before = True, state
            if ended is not None:
                continue
            if action in ("fail", "stop"):
                state, ended = "stopped", ts
                if self.keep is not None:
                    self.handle.registerTimer(self._timer(ended))
            elif action in ("start", "resume"):
                state = "running"
            elif action == "pause":
                # A pause before the start is remembered as a pause that a start ends.
                state = "paused" if state == "running" else state
            elif action == "page_done" and state == "running":
                pages += 1
            if state != before:
                out.append((key[0], ts, state, pages))
        if stored is None or tuple(stored) != (state, pages, ended):
            self.state.update((state, pages, ended))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "micros", "state", "pages_done"])

    def _timer(self, ended: int) -> int:
        """Milliseconds, not before the time itself."""
        return -(-(ended + self.keep) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, ended = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], ended + self.keep, "expired", 0)], columns=["job_id", "micros", "state", "pages_done"])

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, hours: float | None = None, late: str = "1 hour") -> DataFrame:
    """Changes of state of each job of a control-event stream (job_id, event_id, ts, action). Needs the RocksDB state store.

    With ``hours``, jobs expire on event time: events that come ``late`` behind the newest
    one are left out, and a query that ends with its input expires what its watermark has
    passed by then.
    """
    if hours is not None:
        events = events.withWatermark("ts", late)
    rows = events.withColumn("micros", F.unix_micros("ts")).groupBy("job_id")
    found = rows.transformWithStateInPandas(statefulProcessor=JobStates(hours), outputStructType="job_id long, micros long, state string, pages_done long", outputMode="Update", timeMode="None" if hours is None else "EventTime")
    return found.select("job_id", F.timestamp_micros("micros").alias("ts"), "state", "pages_done")


class TaskStates(StatefulProcessor):
    """Follows the tasks in hand of each job; emits what becomes of them.

    Per job it keeps its state, and by task those that were taken while it ran and have no
    result yet. A result counts while the job runs (``done``). One that comes during a
    pause doesn't: the task stays in hand and has to be run again (``again``). A job's end
    (``stopped`` with a warning, or ``failed``, without a task) drops the tasks in hand
    (``dropped``); nothing that follows counts.
    """

    COLUMNS = ("job_id", "task", "micros", "outcome", "message")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "state string")
        self.taken = handle.getMapState("taken", "task long", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get()
        state = stored[0] if stored else "waiting"
        # What the batch changes is kept here and stored at its end: every call is a round trip.
        new: dict[int, int] = {}
        gone: set[int] = set()
        asked: dict[int, bool] = {}

        def held(task: int) -> bool:
            """Whether the task is in hand from batches before this one."""
            if stored is None or task in gone:
                return False
            if task not in asked:
                asked[task] = self.taken.containsKey((task,))
            return asked[task]

        out = []
        for ts, action, task in _in_order(rows, "micros", "action", "task"):
            if state == "ended":
                break
            if action in ("start", "resume"):
                state = "running"
            elif action == "pause" and state == "running":
                state = "paused"
            elif action == "take" and state == "running":
                new[int(task)] = ts
            elif action == "done" and state in ("running", "paused") and (int(task) in new or held(int(task))):
                out.append((key[0], int(task), ts, "done" if state == "running" else "again", None))
                if state == "running":
                    if held(int(task)):
                        gone.add(int(task))
                    new.pop(int(task), None)
            elif action in ENDS:
                state = "ended"
                out.append((key[0], None, ts, *ENDS[action]))
                before = {int(t[0]) for t in self.taken.keys()} if stored else set()
                out += [(key[0], t, ts, "dropped", None) for t in sorted((before - gone) | new.keys())]
                if before:
                    self.taken.clear()
                new, gone = {}, set()
        for task in gone - new.keys():
            self.taken.removeKey((task,))
        for task, ts in new.items():
            self.taken.updateValue((task,), (ts,))
        if stored is None or stored[0] != state:
            self.state.update((state,))
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS).astype({"task": "Int64"})

    def close(self) -> None:
        pass


def task_changes(events: DataFrame) -> DataFrame:
    """What becomes of the tasks of a stream of (job_id, event_id, ts, action, task): actions of jobs, and ``take`` and ``done`` of tasks. Needs the RocksDB state store."""
    rows = events.withColumn("micros", F.unix_micros("ts")).groupBy("job_id")
    found = rows.transformWithStateInPandas(statefulProcessor=TaskStates(), outputStructType="job_id long, task long, micros long, outcome string, message string", outputMode="Update", timeMode="None")
    return found.select("job_id", "task", F.timestamp_micros("micros").alias("ts"), "outcome", "message")
