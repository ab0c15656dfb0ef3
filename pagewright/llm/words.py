"""Words of many documents as ranges of one buffer."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_ranges(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that aren't ``outside``, and the number of runs before each document (one more than documents)."""
    inside = ~outside[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = inside[inner]  # a document's edge parts words as well
    ends[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all documents in lower case with one space after each; start and end of every word there; words before each document."""
    start, end, bounds = word_ranges(data, offsets)
    size = end - start
    after = np.cumsum(size + 1)
    text = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    inside = np.ones(len(text), bool)
    inside[after - 1] = False
    text[inside] = _LOWER[data[~_SPACE[data]]]
    return text.tobytes(), after - size - 1, after - 1, bounds
