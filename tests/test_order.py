"""Scans against plain loops, over groups that lie in several parts."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import order, results


@pytest.fixture
def parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows):
    """(job, at) -> sum, max, last, before, after."""
    out = {}
    for job in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: r[1])
        total, most, last = 0, None, None
        for i, (_, at, v) in enumerate(mine):
            total += v or 0
            most = v if most is None else most if v is None else max(most, v)
            last = last if v is None else v
            out[job, at] = (total, most, last, mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None)
    return out


def test_scan(spark, parts):
    rng = random.Random(4)
    rows = [("hot", i, rng.choice([None, 1, 5, -3])) for i in range(800)] + [(rng.choice(["a", "b", None]), 10_000 + i, rng.choice([None, 2])) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "job string, at long, v long").repartition(3)
    got = order.scan(df, ["job"], ["at"], s=("sum", "v"), m=("max", "v"), l=("last", "v"), b=("before", "v"), a=("after", "v"))
    assert {(r.job, r.at): (r.s, r.m, r.l, r.b, r.a) for r in got.collect()} == plain(rows)
    assert got.columns == ["job", "at", "v", "s", "m", "l", "b", "a"]
    # The one hot group lies in several parts, and no window of the plan is by the group alone.
    assert order.ranged(df, ["job"], ["at"]).filter("job = 'hot'").select(order.PART).distinct().count() > 1
    everything = order.numbered(df, [], ["at"], "n")
    assert sorted((r.at, r.n) for r in everything.collect()) == [(r[1], i + 1) for i, r in enumerate(sorted(rows, key=lambda r: r[1]))]
    assert order.scan(df.limit(0), ["job"], ["at"], s=("sum", "v")).count() == 0


def test_one_job_in_several_tasks(spark, parts):
    """A single job's order is found by several tasks, each of which scans a part of it."""
    tasks = spark.range(3000).select(F.lit("j").alias("job_id"), (F.col("id") * 7 % 3000).alias("doc_id"), F.lit(1).alias("page"))
    for found, name in ((results.fair_order(tasks), "round"), (results.sequential_order(tasks), "place"), (results.running_progress(tasks.withColumn("n", F.lit(2000)), "job_id", ["doc_id"], "n"), "k")):
        at = found.select("doc_id", name, F.spark_partition_id().alias("task")).collect()
        assert len({r.task for r in at}) > 1
        assert all(r[name] == min(r.doc_id + 1, 2000 if name == "k" else 3000) for r in at)


def test_job_states_over_parts(spark, parts):
    rng = random.Random(2)
    rows = [(j, i, i // 2, rng.choice(["start", "pause", "resume", "page_done", "page_done", "page_done"] + (["stop"] if rng.random() < 0.02 else []))) for j in (1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "job_id long, event_id long, ts long, action string").repartition(4)
    got = {r.job_id: (r.state, r.pages_done) for r in results.job_states(df).collect()}
    for j in (1, 2):
        state, done = "waiting", 0
        for _, _, _, action in [r for r in rows if r[0] == j]:
            if state == "stopped":
                continue
            if action == "stop":
                state = "stopped"
            elif action in ("start", "resume"):
                state = "running"
            elif action == "pause" and state == "running":
                state = "paused"
            elif action == "page_done" and state == "running":
                done += 1
        assert got[j] == (state, done)
