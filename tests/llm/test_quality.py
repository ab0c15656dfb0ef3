"""Operator 9: held-out accuracy, the estimates on data whose accuracies are known, odd rows."""

import numpy as np
import pytest

from pagewright.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in quality.op9_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [got[d] for d, q in labels.items() if q == 1]
    bad = [got[d] for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_em_finds_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(40_000) < 0.8
    accuracy = [0.9, 0.8, 0.7, 0.85]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 1, np.where((rng.random(len(truth)) < a) == truth, 2, 0)) for a in accuracy], 1)
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    _, table, share = quality.em(patterns, count.astype(float))
    assert abs(share - 0.8) < 0.03
    for i, a in enumerate(accuracy):
        assert abs(table[1, i, 2] - 0.7 * a) < 0.03 and abs(table[0, i, 0] - 0.7 * a) < 0.04


def test_scorer_agrees_with_its_features(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + ["", "ab", "x y z"]
    data = b"".join(t.encode() for t in texts)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    buffer = np.frombuffer(data, np.uint8)
    w = np.random.default_rng(0).normal(size=quality.DIMENSIONS).astype(np.float32)
    model = quality.Model(w, 0.1, {}, 0.5)
    score = quality.features(buffer, offsets) @ w + 0.1
    expect = 1 / (1 + np.exp(-score))
    expect[-3] = 0
    assert np.allclose(model.probability(buffer, offsets), expect, atol=1e-4)


def plainly(texts, sample):
    """The whole in plain steps on the driver: votes, expectation-maximisation, sample, scorer, probabilities."""
    import xxhash

    def buffer(some):
        data = [t.encode() for t in some]
        return np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)

    worded = [t for t in texts if t and t.split()]
    votes = {t: quality.votes(*buffer([t]))[0] for t in set(worded)}
    patterns, count = np.unique(np.stack([votes[t] for t in worded]), axis=0, return_counts=True)
    post, _, _ = quality.em(patterns, count.astype(float))
    by = {tuple(p): q for p, q in zip(patterns.tolist(), post)}
    name = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    chosen = sorted(set(worded), key=name)[:sample]
    x = np.concatenate([quality.features(*buffer([t])) for t in chosen])
    w, b, _ = quality.train(x, np.array([by[tuple(votes[t].tolist())] for t in chosen], np.float32))
    out = []
    for t in texts:
        p = 0.0
        if t and t.split():
            p = 1 / (1 + np.exp(-np.clip(float(quality.features(*buffer([t]))[0] @ w) + b, -30, 30)))
        out.append(p)
    return out


@pytest.mark.parametrize("sample", [60, 4096])
def test_whole_against_plain_steps(spark, sf, sample):
    """Every row's probability; copies neither add to the sample nor make it smaller."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(1000 + i, docs[7][1]) for i in range(300)] + [(2000 + i, "") for i in range(300)] + [(3000, None), (3001, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.p_good for r in quality.score(df, quality.fit(df, sample)).collect()}
    want = plainly([t for _, t in rows], sample)
    assert all(abs(got[d] - p) < 0.02 for (d, _), p in zip(rows, want))
    assert sum((got[d] >= 0.5) != (p >= 0.5) for (d, _), p in zip(rows, want) if abs(p - 0.5) > 0.02) == 0


def test_two_texts_many_times(spark):
    """However often two texts stand there, both are in the sample."""
    good = "the plain words of this text are what one would expect of prose in a book and it goes on for a while. " * 3
    bad = "### $$$ %%% ||| *** !!! " * 20
    for n in (100, 6000):
        df = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(n)], "doc_id long, text string").repartition(3)
        got = {r.doc_id % 2: r.p_good for r in quality.score(df, quality.fit(df)).filter("doc_id < 2").collect()}
        assert got[1] > 0.5 > got[0]


def test_features_are_packed_and_unpacked():
    x = np.zeros((3, quality.DIMENSIONS), np.float32)
    x[0, [0, 5, 2047]] = [1, 0.25, 3e-5]
    assert np.array_equal(quality.unpacked([quality.packed(r) for r in x]), x)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x y z", 0.5, 1), (2, None, 0.5, 1)], "doc_id long, text string, p_good double, pattern int")
    assert quality.keep_good(df).schema == df.schema
    with pytest.raises(ValueError):
        quality.score(df, quality.Model(np.zeros(quality.DIMENSIONS, np.float32), 0.0, {}, 0.5))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "one two"), (4, "A " * 9000), (5, "x y"), (5, "x y")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, pattern int").repartition(2)
    got = quality.score(df, quality.fit(df)).collect()
    assert len(got) == 7 and {r.p_good for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    assert quality.keep_good(df).columns == df.columns
    none = df.limit(0)
    assert quality.keep_good(none).count() == 0
