"""Operator 9: a quality classifier from weak labels.

Nine overlapping heuristics vote on every document: good, bad or no opinion.
Expectation-maximisation over the counts of vote patterns of all documents (at
most 3**9 patterns, whatever the corpus) estimates how accurate each heuristic is
and how common good documents are, without any label. The posterior labels of a
bounded sample train a linear scorer on hashed features, and this scorer judges all
documents by their whole texts. The sample is the ``SAMPLE`` different texts with
words whose hashes are least, so copies don't make it smaller.

Features of a document: the shares of each run of four character classes, and of
repeated words at distances up to eight, hashed into ``DIMENSIONS`` places.

Defined cases: null, empty and wordless texts are rejected with probability 0, don't
vote and aren't sampled; equal texts get equal results; ties of hashes are equal
texts; null ids stay; extra columns stay or are ignored; an empty table gives an empty
result. Very long texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagewright.llm.common import plain, table, unused
from pagewright.llm.kernels import U64, chunks, pieces, utf8, words

SAMPLE = 4096
DIMENSIONS = 2048
KEEP_AT = 0.5
#: Heuristics in the order of the votes.
HEURISTICS = ("symbols", "capitals", "bars", "exclamations", "repeated words", "near repeats", "symbol words", "function words", "plain prose")
#: A document of fewer words gets no vote on its style.
ENOUGH_WORDS = 8
#: So many bytes without features are added to each document, which keeps short texts near the bias.
SMOOTHING = 100
STOPWORDS = "the of and to in is it that for on with as was at by be this from or an are la le de les des et en un une que qui dans pour du est sur par der die das und ist den von zu mit im ein eine el los las del y se no con para su".split()

# Character classes: 0 lower case and letters beyond ASCII, 1 upper case, 2 digit, 3 blank, 4 line end, then punctuation.
_CLASS = np.full(256, 15, np.uint8)
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 32]] = 3
_CLASS[[10, 11, 12, 13]] = 4
for _code, _marks in enumerate((".,", "'-", "!", "|", ";:?", "()\"", "#", "$", "%", "&*"), 5):
    for _mark in _marks:
        _CLASS[ord(_mark)] = _code
_SYMBOL = np.isin(np.arange(16), [7, 8, 11, 12, 13, 14, 15])


@lru_cache(maxsize=1)
def _stop_hashes() -> np.ndarray:
    data = " ".join(STOPWORDS).encode()
    return np.sort(words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each document: counts of character classes, words, repeated words by distance 1 to 8, function words."""
    n = len(offsets) - 1
    classes = np.zeros((n, 16), np.int64)
    for _, part, at in pieces(data, offsets):
        doc = np.repeat(np.arange(n), np.diff(at))
        classes += np.bincount(doc * 16 + _CLASS[part], minlength=16 * n).reshape(n, 16)
    hashes, bounds = words(data, offsets)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(n), count)
    repeats = np.zeros((n, 8), np.int64)
    for d in range(1, 9):
        if len(hashes) > d:
            same = (hashes[d:] == hashes[:-d]) & (owner[d:] == owner[:-d])
            repeats[:, d - 1] = np.bincount(owner[d:][same], minlength=n)
    stop = _stop_hashes()
    known = stop[np.minimum(np.searchsorted(stop, hashes), len(stop) - 1)] == hashes
    return classes, count, repeats, np.bincount(owner[known], minlength=n)


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x heuristics: 2 good, 0 bad, 1 no opinion."""
    classes, count, repeats, stops = measures(data, offsets)
    size, w = np.maximum(classes.sum(1), 1), np.maximum(count, 1)
    letters = np.maximum(classes[:, :2].sum(1), 1)

    enough = count >= ENOUGH_WORDS
    near = repeats[:, 1:].sum(1) / w
    # (measure, usual in prose up to, a symptom from)
    signs = [
        (classes[:, _SYMBOL].sum(1) / size, 0.02, 0.06),
        (classes[:, 1] / letters, 0.12, 0.3),
        (classes[:, 8] / w, 0.02, 0.1),
        (classes[:, 7] / w, 0.05, 0.25),
        (repeats[:, 0] / w, 0.1, 0.25),
        (near, 0.9, 1.8),
        (classes[:, 11:16].sum(1) / w, 0.15, 0.8),
    ]
    out = [np.where(enough & (value >= bad), 0, 1) for value, _, bad in signs]
    usual = np.all([value <= good for value, good, _ in signs], axis=0)
    out.append(np.where(stops / w >= 0.12, 2, np.where((count >= 20) & (stops / w <= 0.03), 0, 1)))
    out.append(np.where(enough & usual, 2, 1))
    return np.stack(out, 1).astype(np.uint8)


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and code of every run of four characters' classes, a piece at a time."""
    for _, part, at in pieces(data, offsets, 3):
        c = _CLASS[part].astype(np.uint32)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        if len(c) >= 4:
            inside = doc[:-3] == doc[3:]
            yield doc[:-3][inside], ((c[:-3] << 12) | (c[1:-2] << 8) | (c[2:-1] << 4) | c[3:])[inside]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x DIMENSIONS."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    for doc, code in _runs(data, offsets):
        out += np.bincount(doc * DIMENSIONS + _PLACE[code], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)
    out /= (np.diff(offsets) + SMOOTHING)[:, None]
    _, count, repeats, stops = measures(data, offsets)
    for d in range(8):
        out[:, _EXTRA[d]] += repeats[:, d] / (count + SMOOTHING / 8)
    out[:, _EXTRA[8]] += stops / (count + SMOOTHING / 8)
    return out


def _hashed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(53)).astype(np.int64) % DIMENSIONS


_PLACE = _hashed(np.arange(1, 65537))
_EXTRA = _hashed(np.arange(70001, 70010))


def em(patterns: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, P(vote | class) for each heuristic, and the share of good documents.

    The start is the majority vote; a class keeps its name since every heuristic
    starts out better than chance.
    """
    k = patterns.shape[1]
    lean = (patterns == 2).sum(1) - (patterns == 0).sum(1)
    post = 1 / (1 + np.exp(-lean.astype(float)))
    hot = np.stack([patterns == v for v in range(3)], 2).astype(float)  # pattern, heuristic, vote
    table = np.zeros((2, k, 3))
    prior = 0.5
    for _ in range(rounds):
        for c, p in ((1, post), (0, 1 - post)):
            counts = np.einsum("p,pkv->kv", weight * p, hot) + 1
            table[c] = counts / counts.sum(1, keepdims=True)
        prior = float(np.clip((weight * post).sum() / max(weight.sum(), 1), 0.02, 0.98))
        logs = np.einsum("pkv,ckv->pc", hot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1] + np.log(1 - prior) - np.log(prior), -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, table, prior


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression on soft labels by gradient steps. Returns the weights for unscaled features, the bias and the scale."""
    scale = 1 / np.maximum(np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)), 1e-4).astype(np.float32)
    x = x * scale
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = ((p - y) / len(y)).astype(np.float32)
        gw, gb = x.T @ g + ridge * w, float(g.sum())
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= (0.01 * (mw / a) / (np.sqrt(vw / c) + 1e-8)).astype(np.float32)
        b -= 0.01 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return (w * scale).astype(np.float32), float(b), scale


#: Of a document without words.
NO_WORDS = -1


def _pattern(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    code = votes(data, offsets) @ 3 ** np.arange(len(HEURISTICS))
    return np.where(np.diff(words(data, offsets)[1]) > 0, code, NO_WORDS)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        if batch.num_rows:
            got = [_pattern(part, at) for _, part, at in chunks(data, offsets)]
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(np.concatenate(got).astype(np.int64)), "text_hash": batch.column("text_hash")})


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns and features of texts with words, some at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            part = batch.slice(first, 64)
            data, offsets = utf8(part.column("text"))
            for start, some, at in chunks(data, offsets):
                code = _pattern(some, at)
                has = np.flatnonzero(code != NO_WORDS)
                x = features(some, at)
                yield pa.RecordBatch.from_pydict({"text_hash": part.column("text_hash").take(pa.array(start + has)), "pattern": pa.array(code[has].astype(np.int64)), "x": pa.array([packed(r) for r in x[has]], pa.binary())})


def packed(x: np.ndarray) -> bytes:
    """The places that aren't zero, then their values."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        n = len(r) // 6
        out[i, np.frombuffer(r, "<u2", n)] = np.frombuffer(r, "<f4", n, 2 * n)
    return out


class Model:
    """A fitted scorer: plain arrays of a fixed size."""

    def __init__(self, weights: np.ndarray, bias: float, accuracy: dict[str, tuple[float, float]], share: float):
        self.weights, self.bias, self.accuracy, self.share = weights, bias, accuracy, share

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The scorer's probability of good, without making the features one by one."""
        n, size = len(offsets) - 1, np.diff(offsets) + SMOOTHING
        score, weight = np.full(n, self.bias), self.weights[_PLACE].astype(np.float64)
        for doc, code in _runs(data, offsets):
            score += np.bincount(doc, weight[code], n) / size
        _, count, repeats, stops = measures(data, offsets)
        words_ = count + SMOOTHING / 8
        for d in range(8):
            score += repeats[:, d] / words_ * self.weights[_EXTRA[d]]
        score += stops / words_ * self.weights[_EXTRA[8]]
        return np.where(count > 0, 1 / (1 + np.exp(-np.clip(score, -30, 30))), 0.0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Weak labels of all documents, and the scorer trained on those of the ``sample`` different texts of least hash."""
    few = plain(docs, "text").select("text", F.xxhash64("text").alias("text_hash"))
    # Equal texts have equal patterns, so the patterns' numbers of different texts add up.
    voted = few.mapInArrow(_patterns, "pattern long, text_hash long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("text_hash", 0.02).alias("different"))
    rows = [r for r in voted.collect() if r["pattern"] != NO_WORDS]  # at most 3 ** 9 rows
    code = np.array([r["pattern"] for r in rows], np.int64)
    patterns = (code[:, None] // 3 ** np.arange(len(HEURISTICS))) % 3 if len(code) else np.zeros((0, len(HEURISTICS)), np.int64)
    weight = np.array([r["n"] for r in rows], float)
    post, votes_given, share = em(patterns, weight)
    accuracy = {h: (float(votes_given[1, i, 2]), float(votes_given[0, i, 0])) for i, h in enumerate(HEURISTICS)}
    if not len(rows):
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0, accuracy, share)
    # Hashes are even, so half as many again as the sample lie in this part of their range; the least of them are the sample.
    part = min(1.0, 1.5 * sample / max(sum(r["different"] for r in rows), 1))
    bound = min(int(part * 2**64) - 2**63, 2**63 - 1)
    chosen = few.filter(F.col("text_hash") <= F.lit(bound)).groupBy("text_hash").agg(F.first("text").alias("text"))
    got = chosen.mapInArrow(_sampled, "text_hash long, pattern long, x binary").orderBy("text_hash").limit(sample).collect()
    by = dict(zip(code.tolist(), post.tolist()))
    x = unpacked([bytes(r["x"]) for r in got])
    y = np.array([by[r["pattern"]] for r in got], np.float32)
    weights, bias, _ = train(x, y)
    return Model(weights, bias, accuracy, share)


def _score(batches: Iterator[pa.RecordBatch], model: Model, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column("text"))
        p = np.concatenate([model.probability(part, at) for _, part, at in chunks(data, offsets)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(p, 6))], [*batch.schema.names, name])


def score(docs: DataFrame, model: Model, name: str = "p_good") -> DataFrame:
    """``docs`` with the probability that a document is good in a new column ``name``."""
    if unused(docs, name) != name:
        raise ValueError(f"column {name} is there already")
    return docs.mapInArrow(lambda b: _score(b, model, name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep_good(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with, whatever their names."""
    name = unused(docs, "p_good")
    return score(docs, model or fit(docs), name).filter(F.col(name) >= KEEP_AT).select(*docs.columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select("doc_id", "p_good", (F.col("p_good") >= KEEP_AT).alias("kept"))
