"""Values worked out by hand, independent of the SQL twins."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import assembly, filters, results


def column(spark, value, of):
    return spark.createDataFrame([(value,)], of)


@pytest.mark.parametrize("first, last, count, want", [(-2, -1, 10, (9, 10)), (1, -1, 10, (1, 10)), (0, 5, 10, (1, 5)), (3, 2, 10, (3, 3)), (4, 99, 10, (4, 10)), (-99, -50, 10, (1, 1)), (12, 15, 10, (10, 10))])
def test_clamped_ranges(spark, first, last, count, want):
    a, b = filters.clamp_range(F.lit(first), F.lit(last), F.lit(count))
    assert tuple(spark.range(1).select(a, b).first()) == want


def test_literals(spark):
    want = {
        "12": ("int", 12, None), " -7 ": ("int", -7, None), "+1_000": ("int", 1000, None), "1__0": ("string", None, None), "12345678901234567890": ("int", 12345678901234567890, None),
        "1.5": ("float", None, 1.5), ".5": ("float", None, 0.5), "5.": ("float", None, 5.0), "1e3": ("float", None, 1000.0), "inf": ("float", None, float("inf")), "-Infinity": ("float", None, float("-inf")),
        "{bad}": ("string", None, None), "[1,,2]": ("string", None, None), '{"a": [1, null]}': ("json", None, None), '"x"': ("json", None, None), "true": ("json", None, None), "True": ("string", None, None), "": ("string", None, None), "a.png": ("string", None, None),
    }
    df = spark.createDataFrame([(k,) for k in want], "v string")
    values = t.literal_values(F.col("v"))
    for r in df.select("v", *[c.alias(k) for k, c in values.items()]).collect():
        assert (r.kind, None if r.int_value is None else int(r.int_value), r.float_value) == want[r.v], r
        assert (r.json_value is None) == (r.kind != "json") and (r.string_value == r.v) == (r.kind == "string")
    assert spark.range(1).select(t.literal_kind(F.lit("NaN"))).first()[0] == "float"
    whole = {"+" + "9" * 50: "9" * 50, "-000" + "1" * 60: "-" + "1" * 60, " 1_" + "0" * 45: "1" + "0" * 45, "-0": "0", "000": "0", "1.0": None}
    got = spark.createDataFrame([(k,) for k in whole], "v string").select("v", t.literal_values(F.col("v"))["int_text"].alias("t"))
    assert {r.v: r.t for r in got.collect()} == whole and all(v is None or int(v) == int(k) for k, v in whole.items())


def test_points_given_twice_come_twice(spark):
    points = spark.createDataFrame([(1, 5.0, 5.0, {"k": 1}), (1, 5.0, 5.0, {"k": 1}), (1, 99.0, 5.0, None)], "doc_id long, px double, py double, note map<string,int>")
    blocks = spark.createDataFrame([(1, 3, 0.0, 0.0, 10.0, 10.0), (1, 2, 5.0, 5.0, 6.0, 6.0)], "doc_id long, block_no long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.found for r in filters.point_lookup(points, blocks, ["doc_id"]).collect()) == [-1, 2, 2]


def test_barcodes(spark):
    codes = spark.createDataFrame([(1, 1, True, "a"), (1, 2, False, "b"), (1, 3, True, "c"), (2, 4, False, "d"), (2, 5, False, "e")], "img_id long, code_no long, valid boolean, text string")
    images = spark.createDataFrame([(1, None, None), (2, None, None), (3, None, None), (4, 202, "no image")], "img_id long, code int, message string")
    got = {r.img_id: (r.code, r.text) for r in results.barcode_texts(codes, images).collect()}
    assert got[1] == (100, "a\nc") and got[3] == (101, "No code in image.") and got[4] == (202, "[Error] Code: 202\nMessage: no image")
    assert got[2][0] == 102 and got[2][1].startswith("[Error] Code: 102\nMessage: ") and "2" in got[2][1].split("Message: ")[1]


def test_barcode_batches(spark):
    texts = spark.createDataFrame([("a", 3, "x\ny"), ("a", 1, "first"), ("b", 2, None), ("a", 7, ""), ("b", 9, "z")], "batch string, img_id long, text string")
    pieces = results.barcode_pieces(texts, ["batch"]).orderBy("batch", "img_id").collect()
    assert {b: "".join(r.piece for r in pieces if r.batch == b) for b in "ab"} == {"a": "first\nx\ny\n", "b": "\nz"}


def test_names_with_times(spark):
    at = F.timestamp_micros(F.lit(1_704_164_645_250_000))  # 2024-01-02 03:04:05.25
    show = lambda p: spark.range(1).select(t.formatted_time(at, p)).first()[0]
    assert show("%Y%m%d_%H%M%S") == "20240102_030405" and show("%unix") == "1704164645.25" and show("%d.%m.%y %j%%%Q") == "02.01.24 002%%Q"
    assert show("it's %Y 'quoted'") == "it's 2024 'quoted'" and show("") == ""
    assert spark.range(1).select(t.formatted_time(F.timestamp_seconds(F.lit(5)), "%unix")).first()[0] == "5.0"


def test_titles_and_states(spark):
    title = lambda *a: spark.range(1).select(t.result_title(*map(F.lit, a))).first()[0]
    assert title(None, 1.234, 0.0) == "time 1.23" and title(None, 1.0, 0.5) == "time 1.00 | confidence 0.50" and title("x", 1.0, 0.5) == "x"
    state = lambda *a: spark.range(1).select(t.state_label(*map(F.lit, a))).first()[0]
    assert [state("run", 1, 2), state("run", 2, 2), state("pause", 0, 2), state("stop", 0, 2), state("stop", 1, 2), state("stop", 2, 2)] == ["running", "saving", "paused", "", "stopped", "finished"]


def test_turns_begin_with_the_second_job(spark):
    tasks = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 1), ("c", 2, 1), ("c", 2, 2)], "job_id string, doc_id long, page int")
    order = [(r.job_id, r.page) for r in results.turns(tasks).orderBy("round", "turn").collect()]
    assert order == [("b", 1), ("c", 1), ("a", 1), ("c", 2), ("a", 2)]
    assert [r.turn for r in results.turns(tasks.filter("job_id = 'a'")).collect()] == [1, 1]


def test_spans_of_a_result_list(spark):
    rows = spark.createDataFrame([(1, 0, "first"), (1, 1, ""), (1, 2, "third"), (1, 3, "last")], "list long, seq int, text string")
    spans = spark.createDataFrame([(1, 7, 3, 2, 0, 2), (1, 8, 2, 1, 2, 3)], "list long, span_id int, left_block int, left_char int, right_block int, right_char int")
    got = {r.span_id: r.text for r in assembly.span_texts(rows, spans, ["list"], listed=True).collect()}
    assert got == {7: "rst\nthird\nla", 8: "hi"}


def test_passwords(spark):
    docs = spark.createDataFrame([(1, False, False, None), (2, True, True, "x"), (3, True, False, None), (4, True, False, ""), (5, True, False, "y")], "doc_id long, is_encrypted boolean, is_authenticated boolean, word string")
    got = {r.doc_id: (r.status, r.code) for r in filters.admit_documents(docs, "word").collect()}
    assert got == {1: ("ready", None), 2: ("ready", None), 3: ("password needed", 202), 4: ("password needed", 202), 5: ("wrong password", None)}


def test_chain(spark):
    blocks = spark.range(10).withColumnRenamed("id", "block_no")
    assert filters.post_process(blocks, lambda b: b.filter("block_no > 3"), lambda b: b.withColumn("x", F.lit(1))).count() == 6
    assert filters.post_process(blocks).count() == 10


def test_dictionary_columns(spark):
    rows = spark.createDataFrame([("k",), ("other",)], "word string")
    words = spark.createDataFrame([("k", "first", "second", "third")], "key string, zh_CN string, en_US string, ja_JP string")
    said = lambda language, d=words: [r.translated for r in filters.translate(rows, d, "word", language).orderBy("word").collect()]
    assert said("ja_JP") == ["third", "other"] and said("zh_TW") == ["first", "other"] and said("fr_FR") == ["second", "other"]
    assert said("fr_FR", words.select("key", "zh_CN")) == ["first", "other"]


def test_callbacks(spark, tmp_path):
    from pagewright.streaming.jobs import Callbacks

    seen = []
    listener = Callbacks(lambda i: seen.append("start"), lambda i, n: seen.append(n), lambda i, e: seen.append("end"))
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(lambda df, n: df.count() and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        import time

        for _ in range(100):
            if "end" in seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert seen[0] == "start" and 7 in seen and seen[-1] == "end"
