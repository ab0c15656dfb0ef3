"""Operator 13 against counts of all n-grams, and its transducers against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import collocations
from pagewright.llm.automata import union


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ngrams(rows, most=5):
    found, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, most + 1):
                    if i + k <= len(w):
                        found[lang][tuple(w[i : i + k])] += 1
    return found, n


def brute(rows, least, top):
    out = []
    for lang, f in (grams := ngrams(rows))[0].items():
        n = grams[1][lang]
        some = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        longer = Counter()
        for p, a in some.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], a)
        scored = []
        for p, a in some.items():
            if 100 * longer[p] < 100 * a:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    want = brute(rows, 100, 2000)
    assert len(want) > 50 and got(collocations.op13_phrase_collocations(spark, sf)) == want


@pytest.mark.parametrize("seed, arcs, block, wide", [(1, 1 << 20, 1 << 20, 1 << 14), (2, 60, 200, 3), (3, 600, 97, 1)])
def test_odd_texts(spark, seed, arcs, block, wide, monkeypatch):
    """Small blocks and transducers, so that prefixes come from many rows; ties, nulls, other white space, letters of several bytes."""
    monkeypatch.setattr(collocations, "ARCS", arcs)
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "WIDE", wide)
    rng = random.Random(seed)
    words = ["a", "B", "c", "É", "é", "日本", "x-y", " z", "'s"]
    rows = [(None, None), ("en", ""), (None, " \t,;\n"), ("und", "a b c a b"), ("", "a b a b a b"), ("en", "a"), ("fr", "a b c d " * 90)]
    for i in range(150):
        lang = rng.choice(["en", "en", "fr", None, "de"])
        rows.append((lang, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ; "]) for _ in range(rng.randint(0, 60)))))
    rows += rows[:40]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "lang string, text string, n int, first string").repartition(5)
    want = brute(rows, 6, 40)
    assert len(want) > 60 and got(collocations.collocations(df, 6, 40)) == want


def test_sql(sf):
    """The query's SQL on odd rows and on a table, against the counts of all n-grams."""
    con = duckdb.connect()
    con.execute("set temp_directory = ''")
    con.execute(f"create table documents as select lang, text from read_parquet('{sf}/documents.parquet')")
    con.execute("insert into documents values (null, repeat('A b, c d ', 150)), ('und', repeat('a b' || chr(11) || 'É  x' || chr(9) || 'y; ', 120)), ('', null), (null, '')")
    rows = con.execute("select lang, text from documents").fetchall()
    assert sorted(con.execute(collocations.oracle()).fetchall()) == brute(rows, 100, 2000)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "one word only")], "lang string, text string")).count() == 0


def rows_of(counter):
    """Slices of a dictionary of counts, each path with all its beginnings."""
    batch = {c: [] for c in ("lang", "first", "second", "n", "depth", "label", "weight")}
    for (lang, grams) in counter.items():
        for p in sorted(g for g in grams if len(g) <= 2):
            under = sorted(g for g in grams if len(g) > 2 and g[:2] == p)
            row = (lang, p[0], p[1] if len(p) > 1 else "", grams[p], [len(g) for g in under], [g[-1] for g in under], [grams[g] for g in under])
            for c, v in zip(batch, row):
                batch[c].append(v)
    kinds = {"n": pa.int64(), "depth": pa.list_(pa.int32()), "label": pa.list_(pa.string()), "weight": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.string())) for c, v in batch.items()})


def paths_of(t, wide=np.zeros(8, np.uint8)):
    out = defaultdict(Counter)
    for b in collocations.slices(t, wide):
        for r in b.to_pylist():
            path = (r["first"],) + ((r["second"],) if r["second"] else ())
            if r["n"]:
                out[r["lang"]][path] += r["n"]
            way = list(path)
            for d, label, weight in zip(r["depth"], r["label"], r["weight"]):
                way[d - 1 :] = [label]
                out[r["lang"]][tuple(way)] += weight
    return out


def test_transducers():
    rng = random.Random(9)
    texts = [[(rng.choice("xy"), " ".join(rng.choices(["a", "b", "é", "zz"], k=30))) for _ in range(4)] for _ in range(3)]
    counted = [ngrams(t)[0] for t in texts]
    parts = [collocations.transducer_of(rows_of(c)) for c in counted]
    assert [paths_of(p) for p in parts] == counted == [paths_of(p, np.full(8, 255, np.uint8)) for p in parts]
    halves = np.full(8, 0x55, np.uint8)  # some words by pair, the others whole
    rows = [r for b in collocations.slices(parts[0], halves) for r in b.to_pylist()]
    assert any(r["second"] for r in rows) and any(r["depth"] and not r["second"] for r in rows) and paths_of(parts[0], halves) == counted[0]
    whole = defaultdict(Counter)
    for c in counted:
        for lang, grams in c.items():
            whole[lang].update(grams)
    together = union(parts)
    assert paths_of(together) == whole
    assert paths_of(together.at_least(4)) == {k: Counter({p: a for p, a in v.items() if a >= 4}) for k, v in whole.items()}
    wanted = [("x", ["a", "b"]), ("y", ["zz"]), ("x", ["é", "é", "a", "b"]), ("x", ["never"]), ("q", ["a"]), ("y", ["a", "b", "a", "b", "zz"])]
    acceptor, ends = collocations._acceptor(pa.array([w[0] for w in wanted]), pa.array([w[1] for w in wanted]))
    found = {}
    for weight, end in zip(together.weights_of(acceptor)[1:], ends):
        found |= {int(e): int(w) for w, e in zip(weight, end) if e >= 0}
    assert [found[i] for i in range(len(wanted))] == [whole.get(lang, {}).get(tuple(p), 0) for lang, p in wanted]
