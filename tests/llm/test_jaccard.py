"""Operator 7 against all pairs."""

import random
import re

import pytest

from pagewright.llm import jaccard


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(jaccard.op7_ngram_jaccard_join(spark, sf)) == brute(rows)


@pytest.mark.parametrize("seed, frequent, heavy", [(1, 4, 4096), (2, 4, 4096), (3, 10**9, 3)])
def test_odd_texts(spark, seed, frequent, heavy, monkeypatch):
    """Near copies at every distance, chains, boiler-plate, nulls, short texts, equal rows; lists found to be long only when they are made."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    boiler = [word() for _ in range(40)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "a b c d"), (7, "É é é é é"), (None, "one two"), (None, None), (8, "x " * 50), (9, "x " * 70)]
    n = 20
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[rng.randint(0, 6) :]
            rows.append((n, " ".join(w)))
            n += 1
            base = w if rng.random() < 0.5 else base
    for _ in range(30):
        rows.append((n, " ".join([word() for _ in range(rng.randint(1, 30))] + boiler)))
        n += 1
    rows += rows[12:20]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, name int").repartition(3)
    assert got(jaccard.groups(df)) == brute(rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    expect = {c for _, n_s, c in brute(rows) if c is not None}
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(expect)


def test_empty(spark):
    assert jaccard.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_and_clashing_names(spark):
    """Different texts under one id, null ids, equal rows, and columns named as the operator's own."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text + " more"), (5, text), (9, text + " end"), (None, "only null of all the ids"), (None, "only null of all the ids"), (None, "another text with a null id here")]
    df = spark.createDataFrame([(a, b, "x", {"k": i}, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, row_key string, m_id map<string,int>, name int").repartition(3)
    kept = jaccard.one_of_each(df)
    assert kept.schema == df.schema
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 3 and [a for a, _ in got if a is not None] == [5]
    assert {b for a, b in got if a is None} == {rows[4][1], rows[6][1]}
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_long_text(spark, monkeypatch):
    """A text of many pieces has the same set as it has in one."""
    import numpy as np

    from pagewright.llm import kernels

    text = ("aé b " * 40 + "x" * 700 + "\n").encode() * 3 + "".join(f"word{i} " for i in range(3000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = kernels.words(data, offsets), jaccard._sets(data, offsets)
    monkeypatch.setattr(kernels, "CHUNK_BYTES", 97)
    parts = kernels.words(data, offsets), jaccard._sets(data, offsets)
    for a, b in zip((*whole[0], *whole[1]), (*parts[0], *parts[1])):
        assert np.array_equal(a, b)
    several = np.array([0, 5, 5, 9, 150, len(text)])
    monkeypatch.setattr(kernels, "CHUNK_BYTES", 1 << 18)
    want = kernels.words(data, several)
    monkeypatch.setattr(kernels, "CHUNK_BYTES", 50)
    assert all(np.array_equal(a, b) for a, b in zip(want, kernels.words(data, several)))
