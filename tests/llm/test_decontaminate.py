"""Operator 6 against every window of every document."""

import random
import re
from collections import Counter

import pytest

from pagewright.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def similarity(window, item):
    k = min(5, len(item))
    a, b = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (window, item))
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def brute(rows, items):
    out = {}
    for doc_id, text in rows:
        w = words(text)
        for item_id, item in items:
            m = words(item)
            if m and w:
                best = max((similarity(w[s : s + len(m)], m), -s) for s in range(max(len(w) - len(m), 0) + 1))
                if best[0] >= 0.8:
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), (0, 0)), (-best[1], round(best[0], 6)), key=lambda x: x[1])
    return out


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_planted(spark, monkeypatch, most):
    monkeypatch.setattr(d, "BROADCAST_SHINGLES", most)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([14, 20, 30, 45, 60, 60, 70, 3, 5])] + [(20, None), (21, ""), (22, "the " * 12)]
    items += [items[2], items[2], (None, " ".join(word() for _ in range(25))), (4, " ".join(word() for _ in range(33))), (23, " ".join(word() for _ in range(24)) + " and so on" * 30)]
    rows = [(1, None), (2, ""), (3, "the " * 30), (4, "the the the")]
    n = 10
    for i, item in items[:9]:
        for edits in (0, 0, 1, 1, 2, 3):
            w = item.split()
            for _ in range(edits):
                at, kind = rng.choice([0, len(w) - 1, rng.randrange(len(w))]), rng.random()
                w[at : at + 1] = [word()] if kind < 0.5 else [] if kind < 0.75 else [w[at], word()]
            rows.append((n, " ".join([word() for _ in range(rng.randint(0, 40))] + w + [word().upper() + "!" for _ in range(rng.randint(0, 40))])))
            n += 1
    rows += [(None, items[1][1] + " more"), (n, "x " + items[-3][1]), (n + 1, items[-2][1] + " y"), (n + 2, items[4][1])]
    # A cut item, with one phrase over and over: repeats turn no more bits than new words.
    rows += [(n + 3, items[-1][1] + " so on" * 3), (n + 4, items[-1][1][: -10 * 4])]
    docs = spark.createDataFrame([(a, b, "m", 1) for a, b in rows], "doc_id long, text string, m string, row_key int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in d.matches(docs, bench).collect()}
    expect = brute(rows, items)
    assert {k for k in expect} == {k for k in got}
    assert all(got[k][1] == expect[k][1] for k in got)
    kept = d.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {a for a, _ in rows} - {a for a, _ in expect}
    assert (n, None) in expect and (n + 1, 4) in expect and (n + 2, 4) in expect and (n + 3, 23) in expect
    assert d.matches(docs.limit(0), bench).count() == 0 and d.matches(docs, bench.limit(0)).count() == 0


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in d.op6_decontaminate(spark, sf).collect()}
    flat = {i: " " + " ".join(words(t)) + " " for i, t in rows}
    verbatim = {(a, i) for a, t in flat.items() for i, item in items if " " + " ".join(words(item)) + " " in t}
    assert verbatim <= set(got)
    for (a, i), (start, sim) in got.items():
        m = words(dict(items)[i])
        assert round(similarity(words(dict(rows)[a])[start : start + len(m)], m), 6) == sim >= 0.8


def bags_of(spark, key, rows):
    """(key columns, shingle, c) of lists of words."""
    out = []
    for k, w in rows:
        for shingle, c in Counter(hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)).items():
            out.append((*k, shingle, c))
    return spark.createDataFrame(out, ", ".join(f"{c} long" for c in key) + ", shingle long, c int")


def test_what_the_index_lets_through(spark):
    """At most a tenth of unrelated pairs meet in a block; of pairs at similarity 0.8 or more nearly all do, within the radius."""
    rng = random.Random(7)
    word = lambda: rng.randrange(10**6)
    items = [[word() for _ in range(40)] for _ in range(60)]
    windows, pairs = [], 0
    for i in range(300):
        w = list(items[i % 60])
        if i < 240:  # one changed word near an end: up to five of 36 shingles
            w[rng.choice([0, 1, 2, 3, 37, 38, 39])] = word()
        else:
            w = [word() for _ in range(40)]
        windows.append(w)
        pairs += similarity(w, items[i % 60]) >= 0.8
    index = d.probed(d.simhash(bags_of(spark, ["item"], [((i,), w) for i, w in enumerate(items)]), "item").withColumnRenamed("print", "print_i").drop("size"), "print_i")
    prints = d.simhash(bags_of(spark, ["window"], [((i,), w) for i, w in enumerate(windows)]), "window")
    assert index.count() == 60 * d.BLOCKS * 988
    met = d.indexed(prints, "print").join(index, ["block", "value"])
    unrelated = met.filter("window % 60 <> item").count()
    near = met.filter(d.within_radius("print", "print_i")).select("window", "item").collect()
    assert len(near) == len(set(near))
    found = sum(similarity(windows[a], items[b]) >= 0.8 for a, b in near)
    print(f"{unrelated / (300 * 59):.3f} of unrelated pairs let through by the index, {len(near) - found} by the radius; {found} of {pairs} near pairs found")
    assert unrelated <= 0.1 * 300 * 59 and len(near) - found <= 3 + (240 - pairs) and found >= 0.98 * pairs
