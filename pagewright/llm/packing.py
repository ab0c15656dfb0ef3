"""Operator 10: packing by lexical retrieval.

Documents longer than a sequence give as many full sequences as they hold; the
rest of each goes to the packer. Terms are token ids, of whole documents. Document
counts of terms and the mean length are taken over all documents. The rests are dealt to
shards of about ``SHARD_TOKENS`` tokens by content: a tree of mean directions, grown on
at most ``SAMPLE`` documents, sends each document's BM25 vector (hashed to
``DIMENSIONS`` places) to a leaf; leaves that lie side by side share a shard, and a
leaf of more tokens than a shard is dealt evenly to several, equal rows as well. A
shard builds a BM25 index of its documents with the statistics of the whole corpus.
The longest unused rest is the next seed; the index scores by all terms of the
seed's document and returns its unused neighbours, best first, and their rests fill
the seed's sequence in turn. The neighbour that no longer fits is cut and what is left of
it is the next seed, so that only a shard's last sequence can be short. Without
neighbours left that share a term, the longest unused rest follows.

Defined cases: null text counts as empty and is its end token alone; equal rows
are packed each; null ids stay; extra columns are ignored; an empty table gives an
empty result. Ties of scores and lengths go to the earlier document of the shard, by
doc_id, length and ids. A text of any length is encoded in parts; a task holds its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import plain, saved, table
from pagewright.llm.kernels import U64, mix, segments_of
from pagewright.llm.tokens import encoder, parts_of, vocabulary

LENGTH = 1024
END = 0
SHARD_TOKENS = 1 << 19
#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Numbers in an index's table of common terms at most (16 MB).
DENSE = 1 << 21
#: Neighbours that are ordered at first; all of them are where a sequence takes more.
NEAREST = 64
#: Places of a hashed vector; documents sampled to grow the tree; sampled documents a leaf has at least; branches of a node.
DIMENSIONS, SAMPLE, LEAF, BRANCHES = 128, 32_768, 8, 8
ENCODED = "doc_id long, shard_key long, row_no long, doc_tokens long, sums array<long>, rest binary, lead binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, length: int) -> Iterator[pa.RecordBatch]:
    """A row for each document: checksums of its full sequences and the counts of their terms, and the ids of the rest."""
    for batch in batches:
        first = 0
        for texts in parts_of(batch.column("text")):
            flat, at = encoder(path).encode_column(texts, end)
            small = flat.astype("<u2") if not len(flat) or flat.max() < 65536 else flat
            n = len(texts)
            sums, rests, ahead = [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                whole = (j - i) // length * length
                sums.append([zlib.crc32(flat[k : k + length]) for k in range(i, i + whole, length)])
                rests.append(small[i + whole : j].tobytes())
                ahead.append(small[i : i + whole])
            doc, term, count, _ = counted(ahead, by_term=False)
            both, bounds = np.stack((term, count)).astype("<u4"), np.searchsorted(doc, np.arange(n + 1)).tolist()
            leads = [both[:, i:j].tobytes() for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c).slice(first, n) for c in ("doc_id", "shard_key", "row_no")}, "doc_tokens": pa.array(np.diff(at)), "sums": pa.array(sums, pa.list_(pa.int64())), "rest": pa.array(rests, pa.binary()), "lead": pa.array(leads, pa.binary())})
            first += n


def counted(rests: list[np.ndarray], leads: list[np.ndarray] | None = None, by_term: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each different term of each document, by term (or not), then document; the documents' lengths.

    ``leads``: terms (first row) and counts of what each document has before its rest.
    """
    size = np.fromiter(map(len, rests), np.int64, len(rests))
    doc, term = np.repeat(np.arange(len(rests)), size), _joined(rests)
    count = None
    if leads and any(x.shape[1] for x in leads):
        ahead, more = np.array([x.shape[1] for x in leads], np.int64), _joined([x[1] for x in leads])
        end, before = np.cumsum(ahead), np.append(0, np.cumsum(more, dtype=np.int64))
        size = size + before[end] - before[end - ahead]
        count = np.concatenate((np.ones(len(term), np.uint32), more.astype(np.uint32)))
        doc, term = np.concatenate((doc, np.repeat(np.arange(len(leads)), ahead))), np.concatenate((term, _joined([x[0] for x in leads])))
    # Document and term as one number, in the order asked for: sorting numbers of 32 bits is far faster than a sort for each document.
    terms = int(term.max()) + 1 if len(term) else 1
    kind = np.uint32 if terms * max(len(rests), 1) < 1 << 32 else np.uint64
    key = term.astype(kind) * kind(len(rests)) + doc.astype(kind) if by_term else doc.astype(kind) * kind(terms) + term.astype(kind)
    if count is None:
        key.sort()
    elif kind is np.uint32:
        both = key.astype(np.uint64) << U64(32) | count
        both.sort()
        key, count = (both >> U64(32)).astype(kind), both & U64(2**32 - 1)
    else:
        order = np.argsort(key)
        key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key))) if count is None else np.add.reduceat(count, first, dtype=np.int64)
    more, less = np.divmod(key[first], kind(len(rests) if by_term else terms))
    doc, term = (less, more) if by_term else (more, less)
    return doc.astype(np.int64), term.astype(np.int64), tf, size


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if len(parts) else np.zeros(0, "<u4")


class Statistics:
    """What BM25 knows of a corpus: its number of documents and tokens, and how many documents hold each term."""

    def __init__(self, documents: int, tokens: int, df: np.ndarray):
        self.documents, self.mean = documents, max(tokens / max(documents, 1), 1)
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5))

    @staticmethod
    def of(rests: list[np.ndarray], leads: list[np.ndarray] | None = None) -> Statistics:
        _, term, _, size = counted(rests, leads)
        return Statistics(len(rests), int(size.sum()), np.bincount(term))

    def weights(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean)) * self.idf[term]


class Index:
    """A BM25 index of documents as token ids, by the statistics of the corpus that they are part of."""

    def __init__(self, rests: list[np.ndarray], statistics: Statistics | None = None, leads: list[np.ndarray] | None = None):
        self.doc, term, tf, size = counted(rests, leads)
        statistics = statistics or Statistics.of(rests, leads)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.bounds = np.append(first, len(term))
        self.terms = term[first]
        self.df = np.diff(self.bounds)
        self.weight = statistics.weights(term, tf, size[self.doc])
        # The lists of the commonest terms, which most of the work would be, as rows of a table.
        common = np.argsort(-self.df, kind="stable")[: DENSE // max(len(rests), 1)]
        self.row = np.full(len(self.terms), -1, np.int64)
        self.row[common] = np.arange(len(common))
        mine = np.repeat(self.row, self.df)
        self.table = np.zeros((len(common), len(rests)))
        self.table[mine[mine >= 0], self.doc[mine >= 0]] = self.weight[mine >= 0]
        self.held = np.arange(len(rests))  # the documents of the table's columns
        order = np.argsort(self.doc, kind="stable")
        self.lists_of_doc = np.repeat(np.arange(len(self.terms)), self.df)[order]
        self.doc_bounds = np.searchsorted(self.doc[order], np.arange(len(rests) + 1))

    def neighbours(self, terms: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term, by falling score over all ``terms``, then in order."""
        terms = np.unique(terms)
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        return self._best(at[known][self.terms[at[known]] == terms[known]], unused, len(unused))

    def neighbours_of(self, doc: int, unused: np.ndarray, most: int) -> np.ndarray:
        """The same for the terms of a document of the index, at least the best ``most``."""
        at = self.lists_of_doc[self.doc_bounds[doc] : self.doc_bounds[doc + 1]]
        return self._best(at[self.df[at] > 1], unused, most)  # the others stand in this document alone

    def shrink(self, unused: np.ndarray) -> None:
        """Used documents, which stay so, leave the table of common terms once they are half of it."""
        left = unused[self.held]
        if 2 * np.count_nonzero(left) < len(left):
            self.table, self.held = np.ascontiguousarray(self.table[:, left]), self.held[left]

    def _best(self, at: np.ndarray, unused: np.ndarray, most: int) -> np.ndarray:
        row = self.row[at]
        rare = at[row < 0]
        rows = segments_of(self.bounds[rare], self.df[rare])
        score = np.bincount(self.doc[rows], self.weight[rows], len(unused)).astype(np.float64, copy=False)  # whole numbers, where no row is
        score[self.held] += self.table.take(row[row >= 0], 0).sum(0)
        found = np.flatnonzero((score > 0) & unused)  # every weight is positive
        if len(found) > most:
            found = found[score[found] >= np.partition(score[found], -most)[-most]]
        return found[np.argsort(-score[found], kind="stable")]


def fill(rests: list[np.ndarray], length: int, statistics: Statistics | None = None, leads: list[np.ndarray] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start in its rest, tokens, sequence, offset) of every piece, in order."""
    index, unused = Index(rests, statistics, leads), np.array([len(r) > 0 for r in rests], bool)
    longest = np.argsort([-len(r) for r in rests], kind="stable")
    cursor, sequence, offset, seed, most = 0, 0, 0, -1, length
    queue: list[int] = []  # the best neighbour last

    def nearest(n: int) -> list[int]:
        index.shrink(unused)
        return index.neighbours_of(seed, unused, n).tolist()[::-1]

    while True:
        while queue and not unused[queue[-1]]:
            queue.pop()
        if not queue and most < length:  # the others come in the same order, without those used since
            most = length
            queue = nearest(most)
        if queue:
            doc = queue.pop()
        else:
            while cursor < len(longest) and not unused[longest[cursor]]:
                cursor += 1
            if cursor == len(longest):
                return
            doc = int(longest[cursor])
        unused[doc] = False
        if not offset:  # it is a seed; each neighbour fills a place at least
            seed, most = doc, min(NEAREST, length)
            queue = nearest(most)
        start = 0
        while start < len(rests[doc]):
            n = min(len(rests[doc]) - start, length - offset)
            yield doc, start, n, sequence, offset
            start, offset = start + n, offset + n
            if offset == length:
                sequence, offset = sequence + 1, 0
                if start < len(rests[doc]):  # what is left of it is the next seed
                    seed, most = doc, min(NEAREST, length)
                    queue = nearest(most)


def _rests(rest: Iterable[bytes], tokens: Iterable[int], sums: Iterable[list], length: int) -> list[np.ndarray]:
    """Ids of stored rests, as they are stored: four bytes an id where that is their number, else two."""
    return [np.frombuffer(r, "<u4" if len(r) == 4 * (n - len(s) * length) else "<u2") for r, n, s in zip(rest, tokens, sums)]


def _leads(lead: Iterable[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4").reshape(2, -1) for x in lead]


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray]]]:
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            yield part, _rests(*(part.column(c).to_pylist() for c in ("rest", "doc_tokens", "sums")), length), _leads(part.column("lead").to_pylist())


#: What ``_statistics`` counts besides the documents that hold each term: documents, tokens, tokens of rests.
DOCUMENTS, TOKENS, REST_TOKENS = -1, -2, -3


def _statistics(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """What a task adds to the corpus's counts."""
    df, documents, tokens, rest_tokens = np.zeros(0, np.int64), 0, 0, 0
    for _, rests, leads in _parts(batches, length):
        _, term, _, size = counted(rests, leads, by_term=False)
        documents, tokens, rest_tokens = documents + len(rests), tokens + int(size.sum()), rest_tokens + sum(map(len, rests))
        more = np.bincount(term, minlength=len(df))
        more[: len(df)] += df
        df = more
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(held, [DOCUMENTS, TOKENS, REST_TOKENS])), "n": pa.array(np.append(df[held], [documents, tokens, rest_tokens]))})


def statistics_of(encoded: DataFrame, length: int) -> tuple[Statistics, int]:
    """BM25 statistics, and the number of tokens of rests."""
    rows = encoded.mapInArrow(lambda b: _statistics(b, length), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    n = {r["term"]: r["n"] for r in rows}
    df = np.zeros(max(0, *n) + 1 if n else 0, np.int64)
    for term, k in n.items():
        if term >= 0:
            df[term] = k
    return Statistics(n.get(DOCUMENTS, 0), n.get(TOKENS, 0), df), n.get(REST_TOKENS, 0)


def vectors(rests: list[np.ndarray], leads: list[np.ndarray], statistics: Statistics) -> np.ndarray:
    """The BM25 weights of each document's terms with hashed signs in ``DIMENSIONS`` hashed places, at length 1."""
    doc, term, tf, size = counted(rests, leads, by_term=False)
    code = mix(np.arange(len(statistics.idf)))
    sign, place = np.where(code & U64(1), 1.0, -1.0), ((code >> U64(1)) % U64(DIMENSIONS)).astype(np.int64)
    out = np.bincount(doc * DIMENSIONS + place[term], sign[term] * statistics.weights(term, tf, size[doc]), len(rests) * DIMENSIONS).reshape(len(rests), DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def grown(x: np.ndarray, most: int, leaf: int = 0) -> tuple[tuple | int, int]:
    """A tree of mean directions over sampled vectors, and the next free leaf. Nodes of up to ``most`` vectors are leaves; like branches lie side by side."""
    if len(x) <= most:
        return leaf, leaf + 1
    centres = x[np.linspace(0, len(x) - 1, min(BRANCHES, len(x))).astype(int)]
    for _ in range(6):
        near = (x @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (near == k).any():
                mean = x[near == k].mean(0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-9)
    near = (x @ centres.T).argmax(1)
    used = np.unique(near)
    if len(used) < 2:
        return leaf, leaf + 1
    line = np.linalg.svd(centres[used] - centres[used].mean(0), full_matrices=False)[2][0]
    used = used[np.argsort(centres[used] @ line, kind="stable")]
    children = []
    for k in used:
        child, leaf = grown(x[near == k], most, leaf)
        children.append(child)
    return (centres[used], children), leaf


def leaves_of(tree: tuple | int, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree, np.int64)
    near, out = (x @ tree[0].T).argmax(1), np.zeros(len(x), np.int64)
    for k, child in enumerate(tree[1]):
        if (at := near == k).any():
            out[at] = leaves_of(child, x[at])
    return out


def _sampled(batches: Iterator[pa.RecordBatch], statistics: Statistics, length: int) -> Iterator[pa.RecordBatch]:
    for part, rests, leads in _parts(batches, length):
        yield pa.RecordBatch.from_pydict({"shard_key": part.column("shard_key"), "x": pa.array([r.tobytes() for r in vectors(rests, leads, statistics)], pa.binary())})


def _dealt(batches: Iterator[pa.RecordBatch], statistics: Statistics, tree: tuple | int, length: int) -> Iterator[pa.RecordBatch]:
    for part, rests, leads in _parts(batches, length):
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves_of(tree, vectors(rests, leads, statistics)))], [*part.schema.names, "leaf"])


def shards_of(counts: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(leaf, first shard, shards) from the tokens of each leaf: neighbours together up to ``most``, larger ones in several."""
    out, shard, held = [], 0, 0
    for leaf, n in sorted(counts):
        parts = max(1, -(-n // most))
        if held and (parts > 1 or held + n > most):
            shard, held = shard + 1, 0
        out.append((leaf, shard, parts))
        if parts > 1:
            shard += parts
        else:
            held += n
    return out


def deal(encoded: DataFrame, statistics: Statistics, rest_tokens: int, length: int, shard_tokens: int) -> DataFrame:
    """``encoded`` with the shard of each row."""
    shards = rest_tokens // shard_tokens
    if shards < 2:
        return encoded.withColumn("shard", F.lit(0).cast("long"))
    # Rows whose hash lies in the first part of its range: the same ones every time, equal rows once.
    bound = min(int(min(1.0, SAMPLE / statistics.documents) * 2**64) - 2**63, 2**63 - 1)
    sampled = encoded.filter(F.col("shard_key") <= F.lit(bound)).mapInArrow(lambda b: _sampled(b, statistics, length), "shard_key long, x binary")
    rows = sorted((r["shard_key"], bytes(r["x"])) for r in sampled.dropDuplicates(["shard_key"]).collect())  # about SAMPLE
    x = np.stack([np.frombuffer(r, np.float32) for _, r in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    tree, _ = grown(x, max(LEAF, len(x) // (3 * shards)))
    dealt = saved(encoded.mapInArrow(lambda b: _dealt(b, statistics, tree, length), ENCODED + ", leaf long"), "dealt")
    tokens = F.sum(F.col("doc_tokens") - length * F.size("sums"))
    places = shards_of([tuple(r) for r in dealt.groupBy("leaf").agg(tokens).collect()], shard_tokens)  # at most SAMPLE leaves
    # From Arrow: a list of rows would go through Python workers of another kind, which executors then keep as well.
    columns = np.array(places, np.int64).reshape(-1, 3).T
    by_leaf = encoded.sparkSession.createDataFrame(pa.table(dict(zip(("leaf", "first", "parts"), columns))))
    # By row, not by content: a leaf of many equal rows isn't one lump.
    return dealt.join(F.broadcast(by_leaf), "leaf").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row_no"), F.col("parts")))


def _pack(key: tuple, rows: pa.Table, length: int, statistics: Statistics) -> pa.Table:
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("doc_id", "doc_tokens", "rest", "lead")]))
    ids, sizes, whole, rest, lead = (rows.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "sums", "rest", "lead"))
    rests = _rests(rest, sizes, whole, length)
    out, sequence = [], key[0].as_py() << 40
    for doc, sums in enumerate(whole):
        for i, crc in enumerate(sums):
            out.append((ids[doc], i * length, length, crc, sizes[doc], sequence, 0))
            sequence += 1
    for doc, start, n, number, offset in fill(rests, length, statistics, _leads(lead)):
        before = sizes[doc] - len(rests[doc])
        out.append((ids[doc], before + start, n, zlib.crc32(rests[doc][start : start + n].astype("<u4").tobytes()), sizes[doc], sequence + number, offset))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * len(names), names)


def pack(docs: DataFrame, path: str, end: int = END, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    docs = plain(docs, "doc_id", "text").withColumns({"shard_key": F.xxhash64("doc_id", "text"), "row_no": F.monotonically_increasing_id()})
    encoded = saved(docs.mapInArrow(lambda b: _encode(b, path, end, length), ENCODED), "encoded")
    statistics, rest_tokens = statistics_of(encoded, length)
    dealt = deal(encoded, statistics, rest_tokens, length, shard_tokens).select("doc_id", "doc_tokens", "sums", "rest", "lead", "shard")
    return dealt.groupBy("shard").applyInArrow(lambda key, rows: _pack(key, rows, length, statistics), PIECES)


def op10_retrieval_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), path or vocabulary())
