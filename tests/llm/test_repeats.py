"""Operator 1 against every window of every text."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import repeats

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, window):
    seen = Counter(t[i : i + window] for _, x in rows for t in [(x or "").encode()] for i in range(len(t) - window + 1))
    out = []
    for doc_id, x in rows:
        t = (x or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        n_spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in repeats.op1_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows, 200)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("wide", [4096, 1])
def test_odd_texts(spark, monkeypatch, wide):
    """Nulls, empty and short texts, equal rows, runs of one letter, periods, overlaps; also by the path for wide groups."""
    monkeypatch.setattr(repeats, "WIDE", wide)
    rng = np.random.default_rng(3)
    prose = "".join(rng.choice(list("abcdefgh ä"), 900))
    rows = [(1, None), (2, ""), (3, "x" * 150), (4, "x" * 500), (5, prose), (6, prose[100:420] + "!" + prose[300:700]), (7, prose[150:400]), (7, prose[150:400]), (None, "ab" * 300), (None, None), (8, prose[:199]), (9, "?" + prose[50:249] + "?"), (10, "?" + prose[50:250] + "?")]
    rows += [(20 + i, f"{i}" * 9 + prose[200:450] + f"<{i * 7}>" * 30) for i in range(12)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], SCHEMA)
    assert result(repeats.remove_repeats(df)) == brute(rows, 200)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
