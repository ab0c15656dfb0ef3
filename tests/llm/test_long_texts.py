"""Texts of over a megabyte through Spark, one of fifty megabytes through the kernels in bounded memory."""

import hashlib
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import decontaminate, jaccard, packing, pii, quality, repeats, telephony, token_counts, token_files
from pagewright.llm.tokens import Encoder, vocabulary

PASSAGE = "One passage of some length that stands twice in the long text and once elsewhere. " * 4


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    words = np.array(["".join(rng.choice(list("abcdeé"), rng.integers(2, 9))) for _ in range(4000)])
    prose = [" ".join(rng.choice(words, 12)) + (".\n" if i % 3 else ", ") for i in range(18_000)]
    prose[9000] += PASSAGE + "call a.b@x.example now\n"
    prose[15_000] += PASSAGE
    text = "".join(prose)
    assert len(text.encode()) > 1 << 20
    return [(1, text), (2, "short text before " + PASSAGE + " and after"), (3, text[:-4000] + "other words at the end of it"), (4, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_repeats(docs, rows):
    window = 48
    texts = {d: (t or "").encode() for d, t in rows}
    # Names of windows by a plain polynomial, wide enough for this.
    seen = Counter(t[i : i + window] for t in texts.values() for i in range(len(t) - window + 1))
    for r in repeats.remove_repeats(docs, window, 16).collect():
        t = texts[r.doc_id]
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        assert r.n_removed == covered.sum() and bytes(r.kept) == np.frombuffer(t, np.uint8)[~covered].tobytes()


def test_token_operators(spark, docs, rows, tmp_path):
    encoder = Encoder(vocabulary())
    ids = {d: encoder.whole.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    token_files.write(docs, str(tmp_path / "t"), vocabulary())
    assert {r.doc_id: r.ids for r in token_files.read(spark, str(tmp_path / "t")).collect()} == {d: [*i, 2] for d, i in ids.items()}
    whole = {d: np.array([*i, 0], "<u4") for d, i in ids.items()}
    held = Counter()
    for p in packing.pack(docs, vocabulary()).collect():
        assert p.ids_crc32 == zlib.crc32(whole[p.doc_id][p.start : p.start + p.length].tobytes())
        held[p.doc_id] += p.length
    assert held == {d: len(w) for d, w in whole.items()}
    counter = token_counts.Counter(token_counts.unigram_vocabulary(vocabulary("piece_bpe_32k.model")))
    got = {r.doc_id: r.n_pieces for r in token_counts.count_pieces(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert got == {d: counter.count(token_counts.MARK + t.replace(" ", token_counts.MARK)) if t else 0 for d, t in rows}


def test_text_operators(spark, docs, rows):
    texts = dict(rows)
    for r in pii.find(docs).collect():
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(texts[r.doc_id] or ""))
    found = {r.doc_id: r for r in jaccard.groups(docs).collect()}
    for d, t in rows:
        w = (t or "").lower().split(" ") and [x for x in (t or "").replace("\n", " ").split(" ") if x]
        assert found[d].n_shingles == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert [found[d].component_id for d in (1, 2, 3)] == [1, 2, 1]
    bench = spark.createDataFrame([(7, PASSAGE.strip())], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(docs, bench).collect()} == {1, 2, 3}
    for r in telephony.op8_telephony_audio.__globals__["expanded"](telephony.media(docs), False).collect():
        payload = telephony.payload_of((texts[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
    model = quality.fit(docs, 3)
    for r in quality.score(docs, model).collect():
        data = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        score = float((quality.features(data, np.array([0, len(data)])) @ model.weights)[0] + model.bias)
        assert abs(r.p_good - (1 / (1 + np.exp(-score)) if len(data) else 0)) < 1e-3


CODE = """
import resource, sys
import numpy as np
sys.path.insert(0, {root!r})
from pagewright.llm import jaccard, kernels, pii, quality, repeats
rng = np.random.default_rng(1)
data = rng.choice(np.frombuffer(b"abcdefgh    .\\n", np.uint8), {size})
offsets = np.array([0, len(data)])
import pyarrow as pa
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
batch = pa.RecordBatch.from_pydict({{"text": pa.array([data.tobytes().decode()]), "doc_id": pa.array([1]), "row_key": pa.array([1])}})
n = sum(b.num_rows for b in repeats._runs_of(iter([batch]), 200, 64, True))
s = jaccard._sets(data, offsets)[2]
quality.Model(np.ones(quality.DIMENSIONS, np.float32), 0.0, {{}}, 0.5).probability(data, offsets)
list(pii._pair_counts(iter([batch])))
print(n, s, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_kernels_take_memory_for_the_words_alone():
    """Fifty megabytes: the sets take eight bytes a word a few times over, nothing takes eight bytes a byte."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root, size=50 << 20)], capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) < 1_400_000, out.stdout  # kilobytes; whole arrays took over five gigabytes
