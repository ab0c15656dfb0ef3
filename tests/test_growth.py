"""Steps of sources and streams whose cost may not grow with what surrounds them."""

import json
import os

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from pagewright import derive
from pagewright.queries import outputs
from pagewright.sources import sinks, tables
from pagewright.sources.files import ListingReader, _files, read_files, write_files
from pagewright.streaming.jobs import TaskStates


def test_discovery_takes_many_steps_in_a_batch(spark, tmp_path):
    for i in range(7):
        (tmp_path / "in" / str(i % 2)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / str(i % 2) / f"{i}.png").write_bytes(b"x")
    seen, told = [], []
    tables.discover(tables.watch_files(spark, str(tmp_path / "in"), each=4), lambda df, n: seen.append(df.count()), str(tmp_path / "c"), lambda *x: told.append(x), every=2).awaitTermination()
    assert seen == [4, 3] and [(n, k) for n, k, _ in told] == [(0, 2), (1, 4), (2, 6), (3, 7)] and all(p.endswith(".png") for *_, p in told)


def test_found_files_reach_the_stream_through_a_log(spark, tmp_path):
    """The driver's stream follows tables of so many files each, older files first; each file comes once, over several runs too."""
    folder, log, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "c")

    def came(*names: str) -> None:
        for name in names:
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_bytes(b"" if "empty" in name else b"x")
            os.utime(folder / name, (1_000_000_000 + len(seen_at), 1_000_000_000 + len(seen_at)))
            seen_at.append(name)

    def run() -> list[list[str]]:
        batches, told = [], []
        q = tables.discover(tables.watch_files(spark, str(folder), each=3, log=log), lambda df, n: batches.append([r.path.removeprefix(f"{folder}/") for r in df.orderBy("modified").collect()]), check, lambda *x: told.append(x[1]), every=2)
        q.awaitTermination()
        assert not batches or told[-1] == sum(map(len, batches))
        assert not q.lastProgress or all(s["description"].endswith("/log]") for s in q.lastProgress["sources"])
        return batches

    seen_at: list[str] = []
    folder.mkdir()
    assert run() == []
    came("z.png", "1/y.PNG", "_x.png", ".w.jpg", "1/2/empty.png", "a.png", "1/b.png", "t.txt")
    came("_temporary-1/2/half.png")
    assert run() == [["z.png", "1/y.PNG", "_x.png"], [".w.jpg", "1/2/empty.png", "a.png"], ["1/b.png"]]
    assert run() == []
    came("0.png", "1/1.png", "z.png", "1/2/3/2.png", "3.png")
    assert run() == [["0.png", "1/1.png", "1/2/3/2.png"], ["3.png"]]
    assert [spark.read.parquet(str(p)).count() for p in sorted((tmp_path / "log").glob("*.parquet"))] == [3, 3, 1, 3, 1]
    assert not list((tmp_path / "log").glob("_*"))


def test_a_look_that_failed_is_made_up_for(spark, tmp_path):
    """Files whose table didn't get into the log are noted by the next look."""
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.png").write_bytes(b"x")
    tables.note_files(spark, str(tmp_path / "in"), str(tmp_path / "log"), each=2)
    next((tmp_path / "log").glob("*1.parquet")).unlink()
    tables.note_files(spark, str(tmp_path / "in"), str(tmp_path / "log"), each=2)
    found = [[r.path[-5:] for r in spark.read.parquet(str(p)).collect()] for p in sorted((tmp_path / "log").glob("*.parquet"))]
    assert [len(x) for x in found] == [2, 1, 2] and {n for x in found for n in x} == {f"{i}.png" for i in range(5)}
    times = [p.stat().st_mtime_ns for p in sorted((tmp_path / "log").glob("*.parquet"))]
    assert times == sorted(set(times))


def test_a_folder_is_listed_entry_by_entry(spark, tmp_path):
    """The same files as a whole list of the folder has; files of a flat folder are never a list."""
    for name in ("a.png", "deep/er/b.png", "deep/c.png", "_d/.e.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "link.png").symlink_to(tmp_path / "a.png")
    (tmp_path / "broken.png").symlink_to(tmp_path / "none.png")
    (tmp_path / "linked").symlink_to(tmp_path / "deep")
    fs = pafs.LocalFileSystem()
    for recursive in (True, False):
        found = _files(fs, str(tmp_path), recursive)
        assert iter(found) is found
        assert sorted(found) == sorted((f.path, f.size, f.mtime_ns) for f in fs.get_file_info(pafs.FileSelector(str(tmp_path), recursive=recursive)) if f.type == pafs.FileType.File)
    assert sorted(p.path.removeprefix(str(tmp_path)) for p in ListingReader([str(tmp_path)], True).partitions()) == ["", "/_d", "/deep", "/linked"]


def test_files_are_read_by_tasks(spark, tmp_path):
    rows = spark.range(50).select(F.format_string("%d/f%d.txt", F.col("id") % 3, "id").alias("file"), F.when(F.col("id") % 5 > 0, F.format_string("text ü %d", "id")).otherwise("").alias("text"), F.lit("utf-8").alias("encoding"))
    write_files(rows.repartition(4), str(tmp_path / "x"))
    got = {r.path.rpartition("/")[2]: (r.length, bytes(r.content)) for r in read_files(spark, str(tmp_path / "x")).collect()}
    want = {f"f{i}.txt": (f"text ü {i}" if i % 5 else "").encode() for i in range(50)}
    assert got == {k: (len(v), v) for k, v in want.items()}
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["0", "1", "2"]


def test_tables_are_read_in_parts(spark, tmp_path):
    """A table of one file larger than a part comes whole, and is never one value of a row."""
    n = 3 * tables.ROWS // 2
    df = spark.range(n).select(F.lit("j").alias("job_id"), F.col("id").cast("int").alias("seq"), F.lit(100).alias("code"), F.lit(None).cast("string").alias("message"), F.lit('汉 "x"\r\n').alias("text"), F.lit("p").alias("path"), F.format_string("n%d", "id").alias("name"))
    sinks.write_csv(df.coalesce(1), str(tmp_path / "t"))
    back = tables.read_tables(spark, str(tmp_path / "t"), spark.createDataFrame([("j", "gbk")], "job_id string, encoding string"))
    assert back.count() == n and back.select("Name").distinct().count() == n and back.select("OCR").distinct().first()[0] == '汉 "x"\r\n'
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "content" not in plan  # paths alone reach the reader


def test_blocks_of_results_move_once(spark, sf):
    """Blocks are derived once and meet their page's result without a join; what moves has no boxes of corners."""
    lines = outputs.result_lines(spark, sf)
    plan = lines._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 1 and "Join" not in plan
    partial = plan[plan.index("Exchange ") :]
    assert "array(array(" not in partial
    blocks = {(r.doc_id, r.page): r.texts for r in derive.blocks(spark, sf).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("block_no", "text"))).alias("texts")).collect()}
    for line in lines.limit(200).collect():
        r = json.loads(line.value)
        if r["code"] == 100:
            assert [b["text"] for b in r["data"]] == [t.text for t in blocks[int(r["path"]), r["page"]]] and all(len(b["box"]) == 4 for b in r["data"])


class _Handle:
    """A state store that counts its calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        outer = self

        class Map:
            def __getattr__(self, name):
                outer.calls += 1
                return {"containsKey": lambda k: k in outer.map, "updateValue": outer.map.__setitem__, "removeKey": outer.map.pop, "keys": lambda: list(outer.map), "clear": outer.map.clear}[name]

        return Map()

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_tasks_of_one_batch_never_reach_the_state():
    """A thousand tasks taken and done in one batch: the state is read and written for what stays in hand alone."""
    handle, states = _Handle(), TaskStates()
    states.init(handle)
    rows = [(0, 0, "start", None), *((i, 2 * i + k, a, i) for i in range(1, 1001) for k, a in enumerate(("take", "done"))), (2000, 5000, "take", 7)]
    frame = pd.DataFrame(rows, columns=["micros", "event_id", "action", "task"])
    out = pd.concat(list(states.handleInputRows((1,), iter([frame]), None)))
    assert len(out) == 1000 and set(out["outcome"]) == {"done"} and set(handle.map) == {(7,)}
    assert handle.calls < 10
    ended = pd.concat(list(states.handleInputRows((1,), iter([pd.DataFrame([(3000, 9000, "stop", None)], columns=frame.columns)]), None)))
    assert list(ended["outcome"]) == ["stopped", "dropped"] and not handle.map
