"""Operator 4: how many pieces a unigram tokenizer makes of a text, without making them.

The best path through a text of a unigram model is a Viterbi path; only its score
and its number of pieces are carried, for as many places as the longest piece spans. An
Aho-Corasick automaton of the vocabulary lists all pieces that end at each place, the
longest first. Ties go as in the tokenizers library's unigram model: the places are
visited from left to right, and a path replaces another only if its score is greater,
so that of equal paths to a place the one with the longest last piece stays. A character that no piece covers alone is the unknown piece, whose score
is the least of all less 10; unknown characters side by side fuse to one piece.

A word mark stands for every space, and one before the text. Where no piece of the
vocabulary has a mark after another character, paths never cross from a word into
the next mark, so each run of marks with its word is counted by itself and a
worker remembers the counts of those it has met, up to a bound.

Defined cases: null and empty texts have no pieces; equal rows get equal results;
null ids stay; extra columns are ignored; an empty table gives an empty result. Very
long texts, and words, take memory for the text alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import plain, table
from pagewright.llm.tokens import vocabulary

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: What a worker keeps of words' counts takes about so many bytes before it starts anew; longer words aren't kept.
MEMORY_BYTES, LONGEST_KEPT = 32 << 20, 64


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a public piece file, its unknown piece first.

    The file ranks its pieces by frequency; the score is the log of a Zipf law
    over these ranks, rounded to a 1024th so that sums are exact and ties occur.
    Control and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return [("<unk>", 0.0)] + [(p, round(-(math.log(r) + total) * 1024) / 1024) for r, p in enumerate(dict.fromkeys(pieces), 1)]


class Counter:
    """Counts pieces; ``unknown`` is the place of the unknown piece in ``vocab``."""

    def __init__(self, vocab: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocab):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.span = max(len(p) for p, _ in vocab) + 1
        self.unknown_score = min(s for _, s in vocab) - UNKNOWN_PENALTY
        # Whether a path or a run of unknown characters may cross into a mark.
        self.inside = any(MARK in p.lstrip(MARK) for p, _ in vocab) or all(p != MARK for p, _ in vocab)
        self.seen: dict[str, int] = {}
        self.size = 0

    def count(self, text: str) -> int:
        """Pieces on the best path through ``text``, taken as it stands."""
        span = self.span
        # At each of the last places: best score, pieces on that path, and whether its last piece is unknown.
        best, pieces, fused = [0.0] * span, [0] * span, [False] * span
        matches = self.automaton.iter(text)
        end, found = next(matches, (-1, None))
        before = 0
        for place in range(len(text)):
            top, n, last, alone = -math.inf, 0, False, False
            while end == place:  # the longest first
                size, score, unknown = found
                at = (place + 1 - size) % span
                total = best[at] + score
                if total > top:
                    top, n, last = total, pieces[at] + (not (unknown and fused[at])), unknown
                alone = alone or size == 1
                end, found = next(matches, (-1, None))
            if not alone:
                total = best[before] + self.unknown_score
                if total > top:
                    top, n, last = total, pieces[before] + (not fused[before]), True
            before = (place + 1) % span
            best[before], pieces[before], fused[before] = top, n, last
        return pieces[before]

    def count_text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if self.inside:
            return self.count(marked)
        total, seen = 0, self.seen
        for word in marked.split(MARK)[1:] if MARK + MARK not in marked and marked[-1] != MARK else re.findall(f"{MARK}+[^{MARK}]*", marked):
            n = seen.get(word)
            if n is None:
                n = self._word(word)
                if len(word) <= LONGEST_KEPT:
                    self.size += 160 + len(word)  # the word, its place in the table, its count
                    if self.size > MEMORY_BYTES:
                        seen.clear()
                        self.size = 160
                    seen[word] = n
            total += n
        return total

    def _word(self, word: str) -> int:
        return self.count(word if word[:1] == MARK else MARK + word)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(unigram_vocabulary(path))


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count = counter(path).count_text
        texts = batch.column("text")
        n = np.fromiter((count(t) for first in range(0, batch.num_rows, 256) for t in texts.slice(first, 256).to_pylist()), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_pieces": pa.array(n)})


def count_pieces(docs: DataFrame, path: str) -> DataFrame:
    return plain(docs, "doc_id", "text").mapInArrow(lambda b: _count(b, path), "doc_id long, n_pieces long")


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"), path or vocabulary("piece_bpe_32k.model"))
