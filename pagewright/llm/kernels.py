"""Numpy kernels shared by the text operators: hashes of byte ranges, words and shingles.

Every kernel works on many documents at a time: their UTF-8 bytes lie one after
the other in a buffer and ``offsets`` (one more than documents) tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Documents are taken together up to so many bytes, so that the arrays stay in the CPU's caches; longer ones in pieces of this size.
CHUNK_BYTES = 1 << 18
#: Documents taken together at most: what a kernel makes for each document is bounded too.
CHUNK_ROWS = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of any range of a buffer, from one running sum."""

    def __init__(self, seed: int):
        self.table = _stream(seed, 256)
        self.base = int(_stream(seed + 1, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def _grow(self, n: int) -> None:
        """The callers' buffers are bounded by a few chunks, and so are these tables."""
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1024)
            self.up = _powers(self.base, n)
            self.down = _powers(self.inverse, n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def fixed(self, sums: np.ndarray, width: int) -> np.ndarray:
        """The hash of the range of ``width`` bytes at every place."""
        n = len(sums) - width
        return (sums[width:] - sums[:n]) * self.down[:n]

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of up to ``most`` bytes and ``CHUNK_ROWS``, a longer document alone: first document, bytes, offsets from 0."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n, first + CHUNK_ROWS)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


# Words: runs of bytes other than the space and the bytes 9 to 13, A-Z in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORDS = Rolling(101)


def _fragments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Start, length and plain hash of the runs of word bytes in a piece of up to ``CHUNK_BYTES``, and whether the last one reaches its end."""
    data = _LOWER[data]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = inside[inner]  # a document's edge parts words as well
    ends[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end - start, _WORDS.ranges(_WORDS.sums(data), start, end), bool(len(end) and end[-1] == len(data))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the number of words before each document (one more than documents).

    A long text is read in pieces; a word that a piece cuts is put together again.
    """
    starts, sizes, hashes, open_word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)], False
    for a in range(0, len(data), CHUNK_BYTES):
        start, size, plain, reaches = _fragments(data[a : a + CHUNK_BYTES], offsets - a if a else offsets)
        if open_word and len(start) and start[0] == 0 and offsets[min(np.searchsorted(offsets, a), len(offsets) - 1)] != a:
            power = pow(_WORDS.base, int(sizes[-1][-1]), 1 << 64)
            hashes[-1][-1] = U64((int(hashes[-1][-1]) + power * int(plain[0])) % (1 << 64))
            sizes[-1][-1] += size[0]
            start, size, plain = start[1:], size[1:], plain[1:]
        if len(start):
            starts.append(start + a)
            sizes.append(size)
            hashes.append(plain)
        open_word = reaches
    start, size, plain = np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes)
    return mix(plain + size.astype(U64) * U64(0x9E3779B97F4A7C15)), np.searchsorted(start, offsets)


_PLACES = _stream(202, 64) | U64(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document in ascending order, and their bounds.

    A document of fewer than ``width`` words has the whole sequence as its one
    shingle; a document without words has none.
    """
    n = len(bounds) - 1
    count = np.diff(bounds)
    if n == 1 and len(hashes) > CHUNK_BYTES:  # one long document: in pieces, each made distinct before they meet
        step = CHUNK_BYTES // 2
        parts = [shingles(p, np.array([0, len(p)]), width)[0] for p in (hashes[i : i + step + width - 1] for i in range(0, len(hashes) - width + 1, step))]
        s = np.unique(np.concatenate(parts))
        return s, np.array([0, len(s)])
    m = len(hashes) - width + 1
    if m > 0:
        s = np.zeros(m, U64)
        for i in range(width):
            s += hashes[i : i + m] * _PLACES[i]
        s = mix(s)
        doc = np.repeat(np.arange(n), count)
        keep = doc[:m] == doc[width - 1 :]
        s, doc = s[keep], doc[:m][keep]
    else:
        s, doc = np.zeros(0, U64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        whole = np.zeros(len(few), U64)
        for i in range(width - 1):
            has = count[few] > i
            whole[has] += hashes[bounds[few[has]] + i] * _PLACES[i]
        whole = mix(whole + count[few].astype(U64) * _PLACES[width])
        s, doc = np.concatenate((s, whole)), np.concatenate((doc, few))
    if len(few):
        order = np.argsort(doc, kind="stable")
        s, doc = s[order], doc[order]
    edges = np.searchsorted(doc, np.arange(n + 1)).tolist()
    for first, last in zip(edges, edges[1:]):  # each in its own place: far less than one sort of all
        s[first:last].sort()
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[fresh], doc[fresh]
    return s, np.searchsorted(doc, np.arange(n + 1))


def pieces(data: np.ndarray, offsets: np.ndarray, overlap: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """What ``chunks`` gives, in pieces: where it begins, bytes, offsets. Only a document that is alone is cut, pieces overlapping by so many bytes."""
    if len(data) <= CHUNK_BYTES or len(offsets) > 2:
        yield 0, data, offsets
        return
    for a in range(0, max(len(data) - overlap, 1), CHUNK_BYTES):
        piece = data[a : a + CHUNK_BYTES + overlap]
        yield a, piece, np.array([0, len(piece)])


def segments_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return first + np.arange(total)
