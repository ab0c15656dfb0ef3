"""Token ids of whole texts by the tokenizers library, each distinct word of a batch encoded once.

A byte-level BPE never joins what its split pattern parts, and that pattern parts
a text before every single space, and around every single line end, that stands
between two other characters. So a text's ids are those of its words, one after
the other. A batch's words are numbered by Arrow's dictionary encoding, after those that
the worker remembers (``memory.py``), the library's BPE model gives the ids of those that
it hasn't met, and the texts' ids are gathered by number. A text with other white space, or with several blanks in a row,
is parted at its single spaces only.

Very long texts are taken in parts of about ``PART_BYTES``, cut at spaces or between a
letter and a mark or digit, which are parted as well. Only a run of letters without
any end is one unit, whatever its length.

The steps of a batch, on the bytes of all its texts: blanks are set around line ends,
and before marks that follow a letter; ``_BARE`` says that a piece has no space before
it in the text. Then the pieces lie between single spaces.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagewright.llm.kernels import utf8
from pagewright.llm.memory import LONGEST_KEPT, Memory

#: What a worker remembers of words takes about so many bytes.
MEMORY_BYTES = 10 << 20
#: Words of texts with other white space that are remembered one by one: two generations of so many, of which the older one goes.
ODD_WORDS = 10_000
#: Texts are encoded together up to so many bytes; longer ones in parts of about this size.
PART_BYTES = 2 << 20
#: Pieces of more characters are cut where letters end.
LONG_PIECE = 1 << 18
_PARTS = re.compile(r"(?<=\S) (?=\S)")
_WORD = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
_LETTER_THEN_MARK = re.compile("(?<=[A-Za-zぁ-ゖァ-ヺ一-龥])(?=[.,;:!?0-9\n、。，！？])")
#: Kinds of bytes, as bits: white space or what begins it other than spaces and line ends, and the two that mark places below
#: (a text that has one takes the slower way); the same as a second byte after 0xC2; spaces and line ends; letters; and what
#: ends a run of letters whatever follows: digits and ASCII marks, but for the apostrophe.
_OTHER, _SECOND, _BLANK, _LETTER, _CUTS = 1, 2, 4, 8, 16
_HELD = {
    _OTHER: [1, 2, 9, 11, 12, 13, 28, 29, 30, 31, 0xE1, 0xE2, 0xE3],
    _SECOND: [1, 2, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0xE1, 0xE2, 0xE3],
    _BLANK: [10, 32],
    _LETTER: [*range(65, 91), *range(97, 123)],
    _CUTS: [*range(33, 39), *range(40, 65), *range(91, 97), *range(123, 127)],
}
_KINDS = bytes(sum(kind for kind, held in _HELD.items() if b in held) for b in range(256))
#: Before a word without a space before it; in the place of a text's end.
_BARE, _END = "\x01", "\x02"


def plain_texts(column: pa.Array) -> np.ndarray:
    """Which texts are words with single spaces or line ends between them."""
    data, offsets = utf8(column)
    data, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    kinds = _kinds(data)
    odd = kinds & _OTHER
    second = np.flatnonzero(data[:-1] == 0xC2) + 1
    odd[second] |= kinds[second] & _SECOND
    blank = kinds & _BLANK
    odd[1:] |= blank[1:] & blank[:-1]
    some = np.diff(at) > 0
    for edge in (at[:-1][some], at[1:][some] - 1):
        odd[edge] |= blank[edge]
    out = np.ones(len(column), bool)
    out[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = False
    return out


def _kinds(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)


def spaced(column: pa.Array) -> pa.Array:
    """Plain texts with their pieces between single spaces."""
    data, offsets = utf8(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    kinds = _kinds(data)
    line = np.flatnonzero(data == 10)
    cut = np.flatnonzero(kinds[1:] & _CUTS) + 1
    # U+00C0 to U+00FF are letters, but for two signs.
    last = data[cut - 1]
    letter = (kinds[cut - 1] & _LETTER > 0) | (data[np.maximum(cut - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    cut = cut[letter & ~np.isin(cut, offsets)]  # a text's front is none, whatever the one before ends with
    # Two bytes before each cut and each line's front, one before each line end.
    place = np.concatenate((cut, line + 1, line))
    size = np.full(len(place), 2)
    size[len(cut) + len(line) :] = 1
    order = np.argsort(place, kind="stable")
    place, size = place[order], size[order]
    before = np.cumsum(size) - size
    at = place + before
    slot = np.concatenate((at, (at + 1)[size == 2]))
    out = np.empty(len(data) + len(slot), np.uint8)
    kept = np.ones(len(out), bool)
    kept[slot] = False
    out[kept] = data
    out[at], out[(at + 1)[size == 2]] = 32, 1
    ends = (offsets + np.append(before, len(slot))[np.searchsorted(place, offsets)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(column), pa.py_buffer(ends), pa.py_buffer(out))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _visible() -> str:
    """The byte-level alphabet by byte: printable Latin-1 bytes as they are, the others from U+0100 on in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b) if b in kept else chr(next(other)) for b in range(256))


_IDS = {"ids": pa.binary()}


def ids_at(ids: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that ``ids`` has at some places, one after the other, and where each place's begin (one more than places)."""
    _, offsets, data = ids.cast(pa.large_binary()).take(pa.array(at)).buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(at) + 1] >> 2
    return np.frombuffer(data or b"", "<u4", ends[-1]), ends


class _OddWords:
    """Piece -> its ids as little-endian unsigned 32-bit integers.

    A piece that begins with ``_BARE`` stands without a space before it, any other with one.
    """

    def __init__(self):
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def get(self, piece: str) -> bytes | None:
        ids = self.newer.get(piece)
        if ids is None and (ids := self.older.get(piece)) is not None:
            self.put(piece, ids)
        return ids

    def put(self, piece: str, ids: bytes) -> None:
        if len(piece) <= LONGEST_KEPT:
            self.newer[piece] = ids
            if len(self.newer) > ODD_WORDS:
                self.older, self.newer = self.newer, {}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.alphabet = _visible()
        self.lead = self.alphabet[32]
        self.odd = _OddWords()
        self.tail, self.known = b"", Memory(_IDS)
        self.line_end = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str, lead: str) -> bytes:
        """Letters, alone or with a space before them, are one unit of the split pattern."""
        word = lead + (word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", self.alphabet)[0])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _all_letters(self, words: list[str], lead: str) -> list[bytes]:
        """``_letters`` of many words, written in the alphabet together."""
        if not words:
            return []
        end, tokenize = self.alphabet[10], self.model.tokenize
        written = codecs.charmap_decode("\n".join(words).encode(), "strict", self.alphabet)[0].split(end)
        return [array("I", [t.id for t in tokenize(lead + w)]).tobytes() for w in written]

    def _unit(self, word: str, bare: bool) -> bytes:
        """The ids of ``word``, with a space before it unless it is ``bare``. Marks after its letters are parted from them."""
        if word.isalpha():
            return self._letters(word, "" if bare else self.lead)
        if (m := _WORD.fullmatch(word)) and m[1].isalpha():
            return self._known(m[1], bare) + self._known(m[2], True)
        return self._ids(word if bare else " " + word)

    def _known(self, word: str, bare: bool) -> bytes:
        piece = _BARE + word if bare else word
        ids = self.odd.get(piece)
        if ids is None:
            ids = self._unit(word, bare)
            self.odd.put(piece, ids)
        return ids

    def _long(self, word: str, bare: bool) -> bytes:
        """``_unit`` in parts, for any length."""
        start, out = 0, []
        cuts = [m.start() for m in _LETTER_THEN_MARK.finditer(word, 1)] if len(word) > LONG_PIECE else []
        for cut, following in zip(cuts, [*cuts[1:], len(word)]):
            if following - start > LONG_PIECE:
                out.append(self._unit(word[start:cut], bare))
                start, bare = cut, True
        return b"".join([*out, self._unit(word[start:], bare)])

    def _odd(self, text: str) -> np.ndarray:
        """A text with other white space."""
        out, start = [], 0
        for end in [*(m.start() for m in _PARTS.finditer(text)), len(text)]:
            word = text[start:end]
            out.append(self._known(word, False) if start and len(word) <= LONGEST_KEPT and _BARE not in word and word != _END else self._long(word, not start))
            start = end + 1
        return np.frombuffer(b"".join(out), "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text; null counts as empty."""
        flat, _ = self.encode_column(pa.array([text], pa.string()))
        return flat

    def _words(self, pieces: list[str], fixed: dict[str, bytes]) -> list[bytes]:
        """The ids of different pieces."""
        got, spaced, bare = list(map(fixed.get, pieces)), [], []
        for i, piece in enumerate(pieces):
            if got[i] is None:
                if piece.isalpha():
                    spaced.append(i)
                elif piece[:1] != _BARE:
                    got[i] = self._unit(piece, False)
                elif piece[1:].isalpha():
                    bare.append(i)
                else:
                    got[i] = self._unit(piece[1:], True)
        for places, lead, first in ((spaced, self.lead, 0), (bare, "", 1)):
            for i, ids in zip(places, self._all_letters([pieces[i][first:] for i in places], lead)):
                got[i] = ids
        return got

    def _plain(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts whose pieces lie between single spaces."""
        lists = pc.split_pattern(spaced(texts), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        bounds = np.asarray(lists.offsets)
        if end != self.tail:  # what ends a text is remembered as well
            self.tail, self.known = end, Memory(_IDS)
        at, fresh = self.known.coded(lists.flatten())
        self.known.add(fresh, {"ids": pa.array(self._words(fresh.to_pylist(), {_END: end, "\n": self.line_end}), pa.binary())})
        flat, ends = ids_at(self.known.columns["ids"], at)
        self.known.forget(at, MEMORY_BYTES)
        return flat, ends[bounds - bounds[0]]

    def encode_column(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, ``end`` after each, and where each text's begin (one more than texts)."""
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        flat, size = [], []
        for part in parts_of(column):
            plain = plain_texts(part)
            texts = pc.fill_null(part, "")
            easy = texts.filter(pa.array(plain))
            if len(part) == 1 and len(easy) and part.nbytes > 2 * PART_BYTES:
                rows = pa.array(_cut(f"{_BARE}{easy[0].as_py()} {_END}"), pa.string())
            else:
                rows = pc.binary_join_element_wise(_BARE, easy, f" {_END}", "")
            ids, bounds = self._plain(rows, tail) if len(rows) else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
            if len(part) == 1 and len(rows) > 1:
                bounds = bounds[[0, -1]]
            if plain.all():
                flat.append(ids)
                size.append(np.diff(bounds))
                continue
            lengths, k = np.zeros(len(part), np.int64), 0
            for i in range(len(part)):
                if plain[i]:
                    one = ids[bounds[k] : bounds[k + 1]]
                    k += 1
                else:
                    one = np.concatenate((self._odd(texts[i].as_py()), np.frombuffer(tail, "<u4")))
                flat.append(one)
                lengths[i] = len(one)
            size.append(lengths)
        sizes = np.concatenate([np.zeros(1, np.int64), *size])
        return (np.concatenate(flat) if flat else np.zeros(0, "<u4")), np.cumsum(sizes)


def parts_of(column: pa.Array, most: int = PART_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes; a longer text is alone in its slice."""
    _, offsets = utf8(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield column.slice(first, min(last, len(column)) - first)
        first = last


def _cut(text: str) -> list[str]:
    """Parts of a text at single spaces, which fall out."""
    out, start = [], 0
    while len(text) - start > PART_BYTES:
        cut = text.find(" ", start + PART_BYTES)
        if cut < 0:
            break
        out.append(text[start:cut])
        start = cut + 1
    return [*out, text[start:]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(path)
