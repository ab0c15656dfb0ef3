"""Each stage of the pipeline on what the one before kept, and components against a plain union-find."""

import os
import random
import re
from collections import Counter

import corpus_pipeline
from pagewright.llm import pii, quality
from pagewright.llm.common import clear, saved, shared_folder, written
from pagewright.llm.components import components
from pagewright.llm.tokens import Encoder, vocabulary
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_tokens import pieces_hold


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, f9), (_, f7), (_, f6), (_, f3), (_, f10) = corpus_pipeline.STAGES

    model = quality.fit(docs)
    good = saved(f9(spark, docs, sf), "t9")
    assert good.columns == docs.columns
    judged = {r.doc_id: r.p_good >= quality.KEEP_AT for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    assert {d for d, _ in rows(good)} == {d for d, k in judged.items() if k}

    one = saved(f7(spark, good, sf), "t7")
    assert one.columns == docs.columns
    assert sorted(d for d, _ in rows(one)) == sorted(d for d, _, c in groups(rows(good)) if d == c)

    clean = saved(f6(spark, one, sf), "t6")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    few = [r for r in rows(one) if len(r[1] or "") < 1500]
    held = {d for d, _ in leaks(few, items)}
    left = {d for d, _ in rows(clean)}
    assert left <= {d for d, _ in rows(one)} and {d for d, _ in few} - left == held

    private = saved(f3(spark, clean, sf), "t3")
    assert private.columns == docs.columns and {d for d, _ in rows(private)} == left
    before = dict(rows(clean))
    for d, text in rows(private):
        assert not pii.base_spans(text or "")
        if not pii.base_spans(before[d] or "") and not re.search("[A-Za-z0-9_+/=-]{20}", before[d] or ""):
            assert text == before[d]

    packed = f10(spark, private, sf)
    tokens, sequences = pieces_hold(Encoder(vocabulary()), rows(private), packed.collect())
    assert sequences <= tokens // 1024 + 2


def test_stages_on_odd_rows(spark, sf):
    """Nulls, repeats, an empty and a long text, and columns named as the operators' own, through all stages."""
    few = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    long = " ".join(t for _, t, *_ in few if t)
    odd = [(None, None, None, None, None), (None, "a null id and the words of a sentence that is long enough to be one of the good ones here.", "en", None, 5), (900, "", "en", "x", 0), (901, long * (1 + 1_200_000 // len(long)), "en", "x", 9), few[3], few[3], (few[3][0], "another text under an id that is taken, and it is long enough to be one of the good ones too.", "en", "x", 1)]
    names = ["row_key", "risky", "p_good", "leak_key", "m_key", "pattern", "shard"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in few + odd], schema).repartition(3)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = Counter((r.doc_id, r.shard) for r in docs.select("doc_id", "shard").collect())
        docs = saved(stage(spark, docs, sf), f"odd{i}")
        assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
        assert not Counter((r.doc_id, r.shard) for r in docs.select("doc_id", "shard").collect()) - before, name
    pieces_hold(Encoder(vocabulary()), rows(docs), corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect())
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, sf).count() == 0


def test_run_of_an_empty_corpus(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_what_a_run_writes_is_removed(spark, sf, tmp_path):
    """``clear`` takes all tables that a run left in the shared folder, and nothing that was there before."""
    few = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    few.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = shared_folder(spark).removeprefix("file://")
    kept = saved(few, "kept")
    before, since = set(os.listdir(folder)), written()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and set(os.listdir(folder)) > before
    clear(spark, since)
    assert set(os.listdir(folder)) == before and kept.count() == few.count()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2001), (2001, 2000)]
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    size = Counter(root(x) for x in list(parent))
    expect = {x: root(x) for x in parent if size[root(x)] > 1}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == expect and len(got) == len(expect)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
