"""Operator 12 against all pairs of fingerprints made shingle by shingle."""

import random
import re

import numpy as np
import pytest
import xxhash

from pagewright.llm import simhash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints, ids):
    """The least id that isn't null of each row's component, by comparing all pairs."""
    x = np.array(prints, np.uint64)
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3):
            parent[root(i)] = root(int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(x))]


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], components(prints, [r.doc_id for r in rows])))
    assert sorted(map(tuple, simhash.op12_simhash_near_dedup(spark, sf).collect())) == want


def test_odd_texts(spark):
    rng = random.Random(5)
    base = [f"word{rng.randrange(900)}" for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\x0b TWO"), (6, "a b c"), (7, "A  B\nC"), (8, "É é é"), (None, "one two"), (None, None), (9, "x " * 50), (10, "x " * 70), (11, "x"), (12, "\x1fa b\x1c c d e")]
    for i in range(40):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = "other"
        rows.append((20 + i, " ".join(w)))
    rows += rows[3:18]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1, "y") for a, b in rows], "doc_id long, text string, fp int, label string").repartition(3)
    prints = [fingerprint(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], prints, components(prints, [d for d, _ in rows])), key=str)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_copies(df).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_link_is_found(spark, seed):
    """Dense clouds, chains at distance three, clouds that meet, and strangers that share half of their bits with a cloud."""
    rng = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = {0, 2**64 - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints |= {flip(centre, rng.randint(0, 4)) for _ in range(120)}
        prints |= {(centre & ~0xFFFFFFFF) | rng.getrandbits(32) for _ in range(30)}
        prints |= {(centre & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(30)}
        at = centre
        for _ in range(25):
            prints.add(at)
            at = flip(at, 3)
        prints |= {flip(centre, 6) for _ in range(40)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    got = {r.fp: r.label for r in simhash.labelled(df).collect()}
    want = components(prints, signed)
    assert got == dict(zip(signed, want))


def test_slices_and_empty(spark, monkeypatch):
    text = "".join(f"w{i % 977} " for i in range(5000)).encode()
    data, offsets = np.frombuffer(text + b"a b" + text[:600], np.uint8), np.array([0, len(text), len(text) + 3, len(text) + 3, len(text) + 603])
    whole = simhash.fingerprints(data, offsets)
    monkeypatch.setattr(simhash, "SLICE", 37)
    assert np.array_equal(whole, simhash.fingerprints(data, offsets)) and whole[2] == 0
    assert int(whole[0]) == fingerprint(text.decode())
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_table_is_broadcast(spark, monkeypatch):
    """Tables of fingerprints grow with the corpus; just below the size that Spark broadcasts they would fill the driver."""
    from pagewright.llm import components as stars

    plans = []

    def recorded(df, name, *more, of=simhash.saved):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return of(df, name, *more)

    monkeypatch.setattr(simhash, "saved", recorded)
    monkeypatch.setattr(stars, "saved", recorded)
    docs = spark.createDataFrame([(i, f"a text of {i % 30} words that come again and again, {'x ' * (i % 7)}") for i in range(90)], "doc_id long, text string")
    plans.append(simhash.near_copies(docs)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
