"""Operators 5 and 10, and the encoder they share, against the tokenizers library on whole texts."""

import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import packing, token_files
from pagewright.llm.tokens import Encoder, vocabulary

ODD = [None, "", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "a\tb c", "it's we'll they've", "über die Straße, 12 345.\nNein! x", "a b  c", "<|endoftext|> x", "x" * 3000, "日本 語", "\x1c \x1d", "don't.\n'tis, no.", "...\n,,, a., b", "a \x01b \x02", "\x01", "a\n\x02", "the.### of%%% It's,, x2-y", "\n"]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "b c"), (None, None), (40, "word " * 3000)]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary())


def whole(encoder, text):
    return encoder.whole.encode(text or "", add_special_tokens=False).ids


def check(encoder, texts):
    flat, at = encoder.encode_column(pa.array(texts, pa.string()), 7)
    assert len(at) == len(texts) + 1 and at[-1] == len(flat)
    for i, text in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == whole(encoder, text) + [7], text


def test_odd_texts(encoder):
    check(encoder, ODD)
    check(encoder, ODD[::-1])


def test_long_texts(encoder, monkeypatch):
    """Texts beyond a part: with spaces, without, and without any end of letters; and a memory that forgets."""
    from pagewright.llm import tokens

    monkeypatch.setattr(tokens, "PART_BYTES", 200)
    monkeypatch.setattr(tokens, "LONG_PIECE", 50)
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 4000)
    texts = ["of the. " * 200 + "end", "ab,cd" * 200, "日本，語1" * 100, "x" * 700, "a\t" + "b'c,d" * 100 + " e f", "short", None]
    check(Encoder(vocabulary()), texts)
    check(Encoder(vocabulary()), texts[:1])


def test_cut_before_a_mark(monkeypatch):
    """A long text is cut at a space; a mark after it doesn't lose that space."""
    from pagewright.llm import tokens

    monkeypatch.setattr(tokens, "PART_BYTES", 200)
    encoder = Encoder(vocabulary())
    for k in range(1, 12):
        check(encoder, ["x" * k + " of (the)" * 200])


def test_words_are_met_once():
    """Words of several batches stay remembered: 250,000 different ones, twice."""

    class Counting:
        def __init__(self, model):
            self.model, self.n = model, 0

        def tokenize(self, word):
            self.n += 1
            return self.model.tokenize(word)

    encoder = Encoder(vocabulary())
    counting = encoder.model = Counting(encoder.model)
    letters = np.array(list("abcdefghij"))
    words = ["".join(letters[[int(d) for d in f"{i:06d}"]]) for i in range(250_000)]
    texts = [" ".join(words[i : i + 50_000]) for i in range(0, len(words), 50_000)]
    first = [encoder.encode(t).tobytes() for t in texts]
    assert [encoder.encode(t).tobytes() for t in texts] == first
    assert counting.n < 1.05 * len(words)


def test_memory_of_words():
    """A worker that has met many words holds little of them: 47 MB here when they were Python objects."""
    encoder = Encoder(vocabulary())
    letters = np.array(list("abcdefghij"))
    words = ["".join(letters[[int(d) for d in f"{i:06d}"]]) for i in range(400_000)]
    texts = [" ".join(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
    encoder.encode(texts[0])
    tracemalloc.start()
    first = pa.total_allocated_bytes()
    for text in texts:
        encoder.encode(text)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - first
    tracemalloc.stop()
    assert held < 24 << 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abZé .,'\n\t -1  ß日")), max_size=25), min_size=1, max_size=4))
def test_any_text(encoder, texts):
    check(encoder, texts)


def test_documents(encoder, spark, sf):
    check(encoder, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(encoder, spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expect, start = [], 0
    for doc_id, text in sorted(rows):
        ids = whole(encoder, text) + [2]
        expect.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.op5_token_files(spark, sf).collect()) == expect


def test_token_files_of_odd_rows(encoder, spark, tmp_path):
    df = spark.createDataFrame([(a, b, 7) for a, b in ROWS], "doc_id long, text string, part int").repartition(3)
    token_files.write(df, str(tmp_path / "t"), vocabulary())
    files = token_files.read(spark, str(tmp_path / "t"))
    back = files.join(token_files.index(files), ["part", "row_no"]).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [(r.doc_id, r.ids) for r in back] == [(a, whole(encoder, b) + [2]) for a, b in order]
    assert [r.start for r in back] == np.cumsum([0, *(len(r.ids) for r in back)])[:-1].tolist()
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(none, str(tmp_path / "none"), vocabulary())
    assert token_files.index(token_files.read(spark, str(tmp_path / "none"))).count() == 0


def pieces_hold(encoder, rows, pieces):
    """Each document's pieces are its ids without gap or overlap, each sequence is gapless, at most 1024 long."""
    docs = defaultdict(list)
    for a, b in rows:
        ids = whole(encoder, b) + [0]
        docs[a, len(ids)].append(ids)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
        by_doc[p.doc_id, p.doc_tokens].append(p)
    for seq in by_seq.values():
        seq.sort(key=lambda p: p.offset)
        assert [p.offset for p in seq] == np.cumsum([0, *(p.length for p in seq)])[:-1].tolist()
        assert sum(p.length for p in seq) <= 1024
    assert set(docs) == set(by_doc)
    for key, copies in docs.items():
        assert sum(p.length for p in by_doc[key]) == sum(map(len, copies))
        for p in by_doc[key]:
            assert any(crc(ids[p.start : p.start + p.length]) == p.ids_crc32 for ids in copies)
        if len(copies) == 1:
            assert sorted((p.start, p.start + p.length) for p in by_doc[key])[0][0] == 0
            ends = sorted((p.start, p.start + p.length) for p in by_doc[key])
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    return sum(map(len, (i for c in docs.values() for i in c))), len(by_seq)


def test_packing(encoder, spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    tokens, sequences = pieces_hold(encoder, rows, packing.op10_retrieval_packing(spark, sf).collect())
    assert sequences <= tokens // 1024 + 2


def test_packing_of_odd_rows(encoder, spark):
    df = spark.createDataFrame([(a, b, 7) for a, b in ROWS], "doc_id long, text string, shard int").repartition(3)
    pieces_hold(encoder, ROWS, packing.pack(df, vocabulary()).collect())
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0


def test_neighbours_share_terms():
    rests = [np.array(x) for x in ([1, 2, 3, 9], [4, 5, 6], [1, 2, 7], [8], [2, 4])]
    index = packing.Index(rests)
    assert index.neighbours_of(0, np.array([False, True, True, True, True]), 9).tolist() == [2, 4]
    assert index.neighbours_of(0, np.array([False, True, True, True, True]), 1).tolist() == [2]
    unused = np.array([False, True, True, True, True])
    assert index.neighbours(rests[0], unused).tolist() == [2, 4]
    assert index.neighbours(np.array([8]), unused).tolist() == [3]
    assert index.neighbours_of(3, unused, 9).tolist() == []


def test_look_up_skips_row_groups(encoder, spark, tmp_path):
    """The files have row indexes, stripes and Bloom filters, and a look-up reads a few row groups only."""
    import glob

    import pyarrow.orc

    rows = [(i * 2, f"text {i} " * 20) for i in range(12_000)]
    folder = str(tmp_path / "files")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), folder, vocabulary())
    for path in glob.glob(folder + "/*.orc"):
        f = pyarrow.orc.ORCFile(path)
        assert f.row_index_stride == token_files.INDEX_ROWS and f.nstripes >= 1
        assert f.compression == "SNAPPY" or f.nrows == 0
    found = token_files.look_up(spark, folder, [4000])
    assert [(r.doc_id, r.ids) for r in found.collect()] == [(4000, whole(encoder, rows[2000][1]) + [2])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1]

    def read_rows(df):
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        metric = lambda node: node.metrics().apply("numOutputRows").value()
        return sum(metric(leaves.apply(i)) for i in range(leaves.size()))

    assert read_rows(found) <= 2 * token_files.INDEX_ROWS
    # An id that is in no file but within its range: the Bloom filter knows.
    assert read_rows(token_files.look_up(spark, folder, [4001])) <= token_files.INDEX_ROWS // 2
