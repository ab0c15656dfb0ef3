"""Operator 11 against both libraries on whole texts and counts of all links."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagewright.llm import alignment
from pagewright.llm.tokens import _visible, vocabulary

A = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
BYTE = {c: i for i, c in enumerate(_visible())}
ENTRY = {i: t for t, i in A.get_vocab().items()}


def groups(text):
    """Lists of (A ids, B ids), or none."""
    if not text:
        return []
    a = [(i, bytes(BYTE[c] for c in ENTRY[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    if b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
        return []
    ends = []
    for side in (a, b):
        at, mine = 0, []
        for _, x in side:
            at += len(x)
            mine.append(at)
        ends.append(mine)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    return [tuple([i for (i, _), e in zip(side, end) if low < e <= high] for side, end in zip((a, b), ends)) for low, high in zip([0, *cuts], cuts)]


def brute(rows):
    held = {t: groups(t) for t in {t for _, t in rows}}
    links = {t: Counter((x, y) for a, b in g for x in a for y in b) for t, g in held.items()}
    count, most = Counter(), Counter()
    for _, t in rows:
        count.update(links[t].keys())
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for d, t in rows:
        g, k = held[t], links[t]
        line = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        best = sum(n for p, n in k.items() if count[p] == most[p[0]])
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(k.values()), best, sum(n * count[p] for p, n in k.items()), hashlib.sha256(line.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(alignment.op11_token_alignment(spark, sf)) == brute(rows)


@pytest.mark.parametrize("seed, memory", [(1, 64 << 20), (2, 4000)])
def test_odd_texts(spark, seed, memory, monkeypatch):
    """White space of all kinds, marks of B, byte pieces, strings of special tokens, copies and nulls; a memory that turns over."""
    monkeypatch.setattr(alignment, "MEMORY_BYTES", memory)
    rng = random.Random(seed)
    parts = ["word", "Wörter", "don't", "(e.g.", "1234", "日本語", "é", "é", "́", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "😀", "①", " ", " ", "\u0085", "\x1c", "\x00", "x" * 300, "ab" * 40, "▁", "\x01", "\x02"]
    gaps = [" ", " ", " ", "\n", "\n\n", "  ", "\t", " \n", "\n ", "   \n  ", "\r\n", "", ""]
    rows = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "  two blanks before"), (6, "after "), (7, "a\nb"), (8, "\na"), (9, "a\n"), (10, "a \n b"), (11, "one two"), (12, "one two"), (None, "one two"), (None, None), (13, "x▁y z"), (14, "▁"), (15, "<|endoftext|>")]
    for i in range(160):
        plain = i % 3 == 0
        rows.append((20 + i, "".join(rng.choice(parts[:6] if plain else parts[: rng.choice([12, 23, 26])]) + rng.choice(gaps[:4] if plain else gaps) for _ in range(rng.randint(1, 40)))))
    rows += rows[8:60]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "doc_id long, text string, count int, key string").repartition(3)
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) > 60
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    found = alignment.align(df, vocabulary(alignment.A), vocabulary(alignment.B)).select(*columns)
    assert got(found) == want
    written = {r.doc_id: r.groups for r in alignment.align(df, vocabulary(alignment.A), vocabulary(alignment.B), whole=True).collect()}
    assert all(hashlib.sha256(written[r[0]].encode()).hexdigest() == r[-1] for r in want if r[0] is not None and r[-1])


def test_units_are_aligned_once():
    """Units of several blocks stay remembered: 120,000 different ones, twice."""
    tool = alignment.Aligner(vocabulary(alignment.A), vocabulary(alignment.B))
    made, met = tool._made, []
    tool._made = lambda units: met.append(len(units)) or made(units)
    words = ["".join("abcdefghij"[int(d)] for d in f"{i:06d}") for i in range(120_000)]
    for first in [*range(0, len(words), 30_000)] * 2:
        alignment._block(pa.array([" ".join(words[first : first + 30_000])]), np.ones(1, np.int64), tool, False)
    assert sum(met) < 1.05 * len(words)


def test_empty(spark):
    paths = vocabulary(alignment.A), vocabulary(alignment.B)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *paths).count() == 0
    assert got(alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *paths)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
