"""Sources, sinks and the recogniser contract by round trips."""

import csv
import io
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.sources import sinks, tables
from pagewright.sources.files import write_files


@pytest.fixture
def results(spark):
    rows = [("j1", 1, 100, None, "one\ntwo", "a b.pdf", "a b.pdf - 1", "a_1"), ("j1", 2, 101, None, "", "a b.pdf", "a b.pdf - 2", "a_2"), ("j1", 3, 902, "broke", None, "a b.pdf", "a b.pdf - 3", "a_3"), ("j2", 1, 100, None, 'ü, "x"', "c.png", "c.png - 1", "c_1")]
    return spark.createDataFrame(rows, "job_id string, seq int, code int, message string, text string, path string, name string, out_name string")


def lines(spark, path, job):
    from pathlib import Path

    return ["".join(p.read_text() for p in sorted(Path(path, f"job_id={job}").glob("part-*")))]


def test_find_files(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "deep/c.jpeg", "d.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(tables.find_files(spark, str(tmp_path))) == ["a.PNG", "c.jpeg"]
    assert names(tables.find_files(spark, str(tmp_path), recursive=False)) == ["a.PNG"]
    assert names(tables.find_files(spark, str(tmp_path), "document")) == ["d.pdf"]
    q = tables.watch_files(spark, str(tmp_path), each=1).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert names(spark.table("found")) == ["a.PNG", "c.jpeg"] and len(q.recentProgress) >= 2


def test_results_come_back(spark, tmp_path):
    block = {"box": [[10, 20], [110, 20], [110, 45], [10, 45]], "text": "t", "score": 0.75, "end": "\n"}
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(x) for x in ({"code": 100, "data": [block], "score": 0.75, "page": 1}, {"code": 101, "data": "no text", "page": 2})))
    a, b = sorted(tables.read_results(spark, str(tmp_path)).collect(), key=lambda r: r.page)
    assert a.blocks[0].text == "t" and a.blocks[0].box[2] == [110.0, 45.0] and a.message is None
    assert b.blocks is None and b.message == "no text"


def test_logs(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"level": s, "module": m, "message": "x"}) for s in tables.SEVERITY for m in ("a", "b")))
    ignored = spark.createDataFrame([("b",)], "module string")
    got = tables.log_threshold(tables.read_logs(spark, str(tmp_path)), "WARNING", ignored).collect()
    assert sorted(r.level for r in got) == ["CRITICAL", "ERROR", "WARNING"]


def test_text_sinks(spark, results, tmp_path):
    sinks.write_all(results, str(tmp_path), ["txt", "txtPlain", "txtIndividual", "md", "jsonl", "csv"], "2024-01-01 00:00:00")
    assert lines(spark, tmp_path / "txtPlain", "j1") == ["one\ntwo\n"]
    txt = lines(spark, tmp_path / "txt", "j1")[0]
    assert txt.startswith("2024-01-01 00:00:00\n\n≦") and lines(spark, tmp_path / "md", "j1")[0].startswith("> 2024-01-01 00:00:00\n\n\n---")
    assert (tmp_path / "txtIndividual" / "a_1").read_bytes() == b"one\ntwo" and not (tmp_path / "txtIndividual" / "a_2").exists()
    assert txt.index("≦ a b.pdf - 1 ≧\none\ntwo\n") < txt.index("≦ a b.pdf - 2 ≧\n") < txt.index("Code: 902, Msg: broke\n")
    md = lines(spark, tmp_path / "md", "j1")[0]
    assert "---\n![a b.pdf - 1](a%20b.pdf)\n[a b.pdf - 1](a%20b.pdf)\n\n> one  \n> two  \n" in md
    back = spark.read.json(f"{tmp_path}/jsonl")
    assert back.count() == 4 and back.filter("code = 101").count() == 1
    table = lambda job: "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv" / f"job_id={job}").glob("part-*")))
    assert table("j1") == 'Name,OCR,Path\r\na b.pdf - 1,"one\ntwo",a b.pdf\r\na b.pdf - 2,,a b.pdf\r\na b.pdf - 3,"[Error] OCR failed. Code: 902, Msg: broke .\n",a b.pdf\r\n'


def test_header(results):
    lines_ = sinks.with_header(sinks.lines_md(results), "2024-01-01 00:00:00", quoted=True)
    assert [r.line for r in lines_.filter("seq = -1").collect()] == ["> 2024-01-01 00:00:00\n\n"] * 2


@pytest.mark.parametrize("text, encoding", [("plain", "ascii"), ("汉字 é", "gbk"), ("漢字 ♁", "big5"), ("かな ｱ", "shift_jis"), ("가나", "euc-kr"), ("😀", "utf-8"), ("♁ ｱ", "utf-8")])
def test_csv_in_its_code_page(spark, tmp_path, text, encoding):
    """Against the csv module: the first encoding that holds all text, a large table in several files, one after the other."""
    rows = [("j", i, 100, None, f'{i}, "{text if i == 700 else "x"}"\r\n', "p" + "," * (i % 2), f"n {i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "job_id string, seq int, code int, message string, text string, path string, name string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_csv(df, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = io.StringIO(newline="")
    csv.writer(want).writerows([sinks.HEADER, *((r[6], r[4], r[5]) for r in rows)])
    parts = sorted((tmp_path / "job_id=j").glob("part-*"))
    assert len(parts) > 1 and b"".join(p.read_bytes() for p in parts) == want.getvalue().encode(encoding)
    assert [p.name for p in tmp_path.iterdir()] == ["job_id=j"]


def test_single_files(spark, results, tmp_path):
    sinks.write_single(results, str(tmp_path / "a"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "a").iterdir()} == {"a_1": b"one\ntwo", "c_1": 'ü, "x"'.encode()}
    sinks.write_single(results.withColumn("out_name", F.concat(F.lit("deep/er/"), "out_name")), str(tmp_path / "b"), ignore_blank=False)
    assert (tmp_path / "b/deep/er/a_2").read_bytes() == b""
    assert (tmp_path / "b/deep/er/a_3").read_text() == "[Error] OCR failed. Code: 902, Msg: broke\n【异常】OCR识别失败。\n"
    sinks.write_single(results.withColumns({"out_name": F.lit("one"), "code": F.lit(100), "text": F.col("name")}), str(tmp_path / "a"))
    assert (tmp_path / "a/one").read_text() in ("a b.pdf - 3", "c.png - 1") and (tmp_path / "a/c_1").exists()
    names = spark.createDataFrame([("/scans/x.y/a.png", "b.tar.png"), ("noext", ".hidden")], "path string, name string")
    assert [tuple(r) for r in names.select(sinks.single_name("path", "name", True), sinks.single_name("path", "name", False)).collect()] == [("/scans/x.y/a.txt", "b.tar.txt"), ("noext.txt", ".hidden.txt")]


def test_a_failed_run_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("f%d", "id").alias("file"), F.lit("ü").alias("text"), F.when(F.col("id") == 17, "ascii").otherwise("utf-8").alias("encoding"))
    with pytest.raises(Exception, match="ascii"):
        write_files(rows.repartition(4), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists() or not list((tmp_path / "x").iterdir())


def test_discovery_counts_as_it_goes(spark, tmp_path):
    for i in range(7):
        (tmp_path / "in" / str(i % 2)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / str(i % 2) / f"{i}.png").write_bytes(b"x")
    seen, told = [], []
    tables.discover(tables.watch_files(spark, str(tmp_path / "in"), each=3), lambda df, n: seen.extend(df.collect()), str(tmp_path / "c"), lambda *x: told.append(x)).awaitTermination()
    assert len(seen) == 7 and [(n, k) for n, k, _ in told] == [(0, 3), (1, 6), (2, 7)] and told[-1][2].endswith(".png")


def test_a_large_job_is_written_in_several_tasks(spark, tmp_path):
    from pathlib import Path

    rows = spark.range(20_000).select(F.lit("j").alias("job_id"), F.col("id").cast("int").alias("seq"), F.concat(F.lit("line "), "id", F.lit("\n")).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_lines(rows.repartition(3), str(tmp_path / "l"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(tmp_path / "l" / "job_id=j").glob("part-*"))) > 1
    assert lines(spark, tmp_path / "l", "j")[0].split() == [x for i in range(20_000) for x in ("line", str(i))]


def test_recogniser_contract(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def read(content: bytes):
            if content == b"bad":
                raise ValueError("unreadable")
            return [{"text": t, "score": 1.0, "x0": 0.0, "y0": 10.0 * i, "x1": 9.0, "y1": 10.0 * i + 9} for i, t in enumerate(content.decode().split("\n")) if t]

        return read

    files = spark.createDataFrame(pd.DataFrame({"path": ["a", "b", "c"], "content": [b"x\ny", b"bad", b""]})).coalesce(1)
    got = sorted((r.path, r.code, r.message, r.block_no, r.text) for r in tables.recognise(files, load).collect())
    assert got == [("a", 100, None, 0, "x"), ("a", 100, None, 1, "y"), ("b", 902, "[Error] unreadable", None, None), ("c", 101, None, None, None)]
    assert loads.value == 1


def test_payload(spark):
    df = spark.createDataFrame([("aGk=",), ("***",), (None,)], "data string")
    assert [(r.bytes, r.code) for r in tables.decode_payload(df).collect()] == [(b"hi", None), (None, 202), (None, None)]


def test_native_lines_with_an_empty_last_line(spark):
    rows = [(1, 1, 0, 0, 0, "First"), (1, 1, 0, 0, 1, " half"), (1, 1, 0, 1, 0, ""), (1, 1, 1, 0, 0, "Second")]
    df = spark.createDataFrame(rows, "doc_id long, page int, group int, line_no int, span_no int, text string")
    got = [(r.text, r.sep) for r in tables.native_lines(df).orderBy("group").collect()]
    assert got == [("First half", " "), ("Second", "\n")]
    assert F is not None
