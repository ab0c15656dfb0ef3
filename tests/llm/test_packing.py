"""Operator 10: the corpus's statistics, and how many of the best neighbours share a shard as documents grow."""

import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import SparkContext

from pagewright.llm import packing, pii
from pagewright.llm.tokens import Encoder, vocabulary

TOPICS = 40


def corpus(n):
    """Texts on 40 topics of 30 words each, a third of the words common to all."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    common, topics = [word() for _ in range(60)], [[word() for _ in range(30)] for _ in range(TOPICS)]
    return [(i, " ".join(rng.choice(common if rng.random() < 0.33 else topics[i % TOPICS]) for _ in range(60))) for i in range(n)]


def scores(rests, seed):
    """Plain BM25 of every document for all terms of one."""
    tf = [Counter(r.tolist()) for r in rests]
    df = Counter(t for c in tf for t in c)
    n, mean = len(rests), sum(map(len, rests)) / len(rests)
    idf = lambda t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
    return [sum(idf(t) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(r) / mean)) for t in tf[seed] if t in c) for c, r in zip(tf, rests)]


@pytest.mark.parametrize("n", [600, 1200, 2400])
def test_best_neighbours_share_a_shard(spark, n):
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shard = {}
    for p in packing.pack(df, vocabulary(), length=512, shard_tokens=75 * 256).collect():
        shard[p.doc_id] = p.sequence_id >> 40
    sizes = Counter(shard.values())
    assert len(sizes) >= n // 150 and max(sizes.values()) <= 300
    ids = list(map(Encoder(vocabulary()).encode, (t for _, t in rows)))
    found = []
    for seed in range(0, n, n // 24 + 1 | 1):  # an odd step, so that all sorts of topics come
        s = scores(ids, seed)
        s[seed] = -1
        found += [shard[d] == shard[seed] for d in np.argsort(-np.array(s), kind="stable")[:10].tolist()]
    print(f"{n} documents, {len(sizes)} shards: {np.mean(found):.2f} of the ten best neighbours in the seed's shard")
    assert np.mean(found) >= 0.7  # by a hash of the row: 75 / n


def test_statistics_are_those_of_all_shards(spark):
    rows = [(i, "alpha beta gamma " + "delta " * (i % 7)) for i in range(300)] + [(None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(a, b, i, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, shard_key long, row_no long").repartition(5)
    path = vocabulary()
    encoded = docs.mapInArrow(lambda b: packing._encode(b, path, 0, 8), packing.ENCODED)
    got, rest_tokens = packing.statistics_of(encoded, 8)
    whole = [np.append(Encoder(path).encode(b), 0) for _, b in rows]
    want = packing.Statistics.of(whole)
    assert rest_tokens == sum(len(w) % 8 for w in whole)
    assert (got.documents, got.mean) == (want.documents, want.mean) and np.array_equal(got.idf, want.idf)


def test_equal_rows_are_spread(spark):
    rows = [(7, "the same row of words " * 20)] * 900 + corpus(300)
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary(), length=512, shard_tokens=100 * 256).collect()
    assert sum(p.doc_id == 7 and p.start == 0 for p in pieces) >= 900
    size = defaultdict(int)
    for p in pieces:
        size[p.sequence_id >> 40] += p.length
    assert max(size.values()) <= 1.5 * 100 * 256


def test_all_terms_of_a_seed_count():
    """Against plain BM25 over every term; documents that share only a seed's common terms are neighbours."""
    rng = np.random.default_rng(3)
    rests = [np.append(np.arange(100), np.arange(1000, 1040)), np.arange(100)]
    rests += [np.array([1000 + i]) for i in range(40)] + [rng.integers(0, 100, 50) for _ in range(60)] + [np.arange(2000, 2050)]
    unused = np.ones(len(rests), bool)
    unused[[0, 50]] = False
    got = packing.Index(rests).neighbours(rests[0], unused).tolist()
    s = scores(rests, 0)
    assert got[0] == 1 and len(rests) - 1 not in got
    assert set(got) == {d for d in range(len(rests)) if unused[d] and s[d] > 0}
    assert np.allclose([s[d] for d in got], sorted((s[d] for d in got), reverse=True))


def split(ids, length):
    """Full sequences' terms with counts, and the rest."""
    whole = len(ids) // length * length
    return np.stack(np.unique(ids[:whole], return_counts=True)), ids[whole:]


def test_windows_are_filled_by_the_best_of_brute_force():
    """Every sequence by plain BM25 of whole documents: seeds are the longest unused rests, neighbours come by falling score."""
    rng, length = np.random.default_rng(8), 32
    docs = [rng.integers(0, 40, rng.integers(1, 120)) + 40 * (i % 3) for i in range(60)] + [np.arange(64)]
    leads, rests = map(list, zip(*(split(d, length) for d in docs)))
    got = list(packing.fill(rests, length, None, leads))

    left, expect, offset, queue = {i for i, r in enumerate(rests) if len(r)}, [], 0, []
    sequence = 0
    while left:
        queue = [d for d in queue if d in left]
        doc = queue.pop(0) if queue else min(left, key=lambda i: (-len(rests[i]), i))
        left.discard(doc)
        best = lambda: [d for d, s in sorted(enumerate(scores(docs, doc)), key=lambda x: (-round(x[1], 9), x[0])) if s > 0 and d in left]  # noqa: B023, E731
        queue = queue if offset else best()
        start = 0
        while start < len(rests[doc]):
            n = min(len(rests[doc]) - start, length - offset)
            expect.append((doc, start, n, sequence, offset))
            start, offset = start + n, offset + n
            if offset == length:
                sequence, offset = sequence + 1, 0
                if start < len(rests[doc]):
                    queue = best()
    assert got == expect


def test_shards_go_by_tokens():
    assert packing.shards_of([(0, 10), (1, 250), (2, 40), (3, 50), (4, 30)], 100) == [(0, 0, 1), (1, 1, 3), (2, 4, 1), (3, 4, 1), (4, 5, 1)]


def test_counts_of_large_ids_and_of_what_comes_before():
    """Terms, and counts before the rest, of up to 32 bits."""
    top = 2**32 - 1
    rests = [np.array([top, 7, 7], "<u4"), np.zeros(0, "<u2"), np.array([7], "<u2")]
    leads = [np.array([[7], [top]], "<u4"), np.array([[1, 9], [2, 3]], "<u4"), np.zeros((2, 0), "<u4")]
    by_doc = [(0, 7, top + 2), (0, top, 1), (1, 1, 2), (1, 9, 3), (2, 7, 1)]
    for by_term in (False, True):
        doc, term, count, size = packing.counted(rests, leads, by_term)
        want = sorted(by_doc, key=lambda r: (r[1], r[0])) if by_term else by_doc
        assert list(zip(doc.tolist(), term.tolist(), count.tolist())) == want and size.tolist() == [top + 3, 5, 1]


@pytest.mark.parametrize("nearest", [1, 2, 5])
def test_neighbours_beyond_the_nearest_come_in_order(monkeypatch, nearest):
    monkeypatch.setattr(packing, "NEAREST", nearest)
    test_windows_are_filled_by_the_best_of_brute_force()


def test_used_documents_leave_the_table():
    rng = np.random.default_rng(5)
    rests, unused = [rng.integers(0, 50, 30) for _ in range(40)], np.arange(40) > 25
    whole, less = packing.Index(rests), packing.Index(rests)
    less.shrink(unused)
    assert less.table.shape[1] == 14 and whole.table.shape[1] == 40
    for seed in range(40):
        assert less.neighbours_of(seed, unused, 9).tolist() == whole.neighbours_of(seed, unused, 9).tolist()


def test_workers_of_one_kind_without_pandas(spark, monkeypatch):
    """Executors hold no second kind of Python workers for small tables, and workers that encode don't load pandas."""

    def refused(*_):
        raise AssertionError("rows of a list go through Python workers")

    docs = spark.createDataFrame(corpus(60), "doc_id long, text string").localCheckpoint()
    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert packing.pack(docs, vocabulary(), length=64, shard_tokens=500).count() >= 60
    assert pii.find(docs).count() == 60
    code = "import sys, pagewright.llm.packing, pagewright.llm.tokens; sys.exit('pandas' in sys.modules)"
    assert not subprocess.run([sys.executable, "-c", code]).returncode
