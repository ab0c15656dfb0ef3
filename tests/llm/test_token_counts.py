"""Operator 4 against the tokenizers library's unigram model."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from pagewright.llm import token_counts
from pagewright.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def both():
    vocab = token_counts.unigram_vocabulary(vocabulary("piece_bpe_32k.model"))
    return token_counts.Counter(vocab), Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))


def library(tokenizer, text):
    return len(tokenizer.encode(token_counts.MARK + text.replace(" ", token_counts.MARK)).ids) if text else 0


TEXTS = ["", " ", "a", "  a  b ", "word " * 300, "日本語 \U0001f600\U0001f600 x", "<unk><unk>a<unk>", "▁▁ ▁a▁", "\n\t", "x" * 500, "ab\U0001f600 \U0001f600cd"]


def test_odd_texts(both):
    for text in TEXTS:
        assert both[0].count_text(text) == library(both[1], text), text


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("theandor  ▁é.日\U0001f600\n")), max_size=60))
def test_any_text(both, text):
    assert both[0].count_text(text) == library(both[1], text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("abc▁ ?")), max_size=20), st.dictionaries(st.text(st.sampled_from(list("abc▁")), min_size=1, max_size=3), st.sampled_from([-1.0, -1.5, -2.0, -3.0]), min_size=1, max_size=8))
def test_ties_of_any_vocabulary(text, pieces):
    vocab = [("<unk>", 0.0), *pieces.items()]
    assert token_counts.Counter(vocab).count_text(text) == library(Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False)), text)


def test_a_long_word_and_a_small_memory(both, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY_BYTES", 2000)
    counter = token_counts.Counter(token_counts.unigram_vocabulary(vocabulary("piece_bpe_32k.model")))
    for text in ("theand" * 20_000, "日本é" * 5_000, " ".join(f"word{i % 50}" for i in range(500))):
        assert counter.count_text(text) == library(both[1], text)


def test_documents(both, spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expect = {r.doc_id: library(both[1], r.text) for r in rows}
    assert {r.doc_id: r.n_pieces for r in token_counts.op4_token_counts(spark, sf).collect()} == expect


def test_odd_rows(spark):
    path = vocabulary("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, None, 2), (None, "", 3), (1, None, 2)], "doc_id long, text string, n_pieces int")
    assert sorted(str(tuple(r)) for r in token_counts.count_pieces(df, path).collect()) == ["(1, 0)", "(1, 0)", "(None, 0)"]
    assert token_counts.count_pieces(df.limit(0), path).count() == 0
