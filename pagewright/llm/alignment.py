"""Operator 11: tokens of two tokenizers aligned by bytes, each distinct text once.

Where a token of A and one of B end at the same byte, a group ends. All A-B pairs of
tokens in a group are links. A pair counts the documents that hold it linked.

1. Texts are shuffled whole, so that each distinct text is left once with its
   multiplicity (copies are added up before the shuffle).
2. A task takes some megabytes of distinct texts as a block. Both tokenizers part texts
   before a single space after another character, so a block's distinct units, each a
   word with the space before it, are encoded and aligned once, and those that a worker
   remembers (``memory.py``) not again. The block is stored as its units' pairs and its texts' units,
   with the number of documents that hold each of its pairs.
3. Pairs are counted over all blocks by multiplicity. Each block gets the counts of its
   own pairs back by a join, one row for each pair of a block at most, and sums them for
   each text.
4. The measures are joined to the documents by the SHA-256 of their text.

Defined cases: texts that are null or empty, or whose tokens don't give back their bytes
(some characters have no piece of their own in B), have no tokens: zeros and an empty
string. Equal rows count each; null ids stay; extra columns are ignored; an empty table
gives an empty result. Ties of counts are all best. A very long text is a block of its
own; a word of any length is one unit.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.automata import grouped
from pagewright.llm.common import plain, saved, table
from pagewright.llm.kernels import segments_of
from pagewright.llm.memory import Memory
from pagewright.llm.tokens import Encoder, parts_of, plain_texts, vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: What a worker remembers of units takes about so many bytes.
MEMORY_BYTES = 32 << 20
#: Units aligned together.
AT_ONCE = 8192
#: A block has about so many bytes of texts.
BLOCK_BYTES = 4 << 20
#: Before a line end and what follows it, where no space is.
_BARE = "\x01"
#: Before a unit that begins with one of these two characters itself.
_PLAIN = "\x02"
#: Space marks of B, as characters.
_MARK = "▁"
_SPACE = re.compile(r"(?<=\S) ")
_WHITE = re.compile(r"\s")
#: Letters that are in one unit of A's pattern each, and marks that never are with them.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?|"


#: Of a unit: its groups in writing with a ";" after each, its numbers of A tokens, B tokens and groups, its pairs (A id in the upper 32 bits) and
#: the links of each; all null where its tokens don't give back its bytes.
UNIT = {"written": pa.binary(), "n_a": pa.int32(), "n_b": pa.int32(), "n_groups": pa.int32(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
#: Groups of more links than this are counted instead of listed.
MANY_LINKS = 1 << 16


def _crossed(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one group and the links of each."""
    times = Counter(b)
    links = {x << 32 | y: k * m for x, k in Counter(a).items() for y, m in times.items()}
    return np.fromiter(links, np.int64, len(links)), np.fromiter(links.values(), np.int64, len(links))


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = Encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        entry = {i: t for t, i in self.a.whole.get_vocab().items()}
        back = {c: bytes([i]) for i, c in enumerate(self.a.alphabet)}
        self.bytes_a = [b"".join(back.get(c, c.encode()) for c in entry[i]) for i in range(max(entry) + 1)]
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or re.search(f"[^{_MARK}]{_MARK}", p) for p in piece):
            raise ValueError("a piece of B crosses a line end or a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(piece)]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        # A letter and a mark are apart in A; those marks that no piece of B joins to a letter part units as well.
        self.marks = "".join(m for m in _MARKS if not any(re.search(f"[{_LETTERS}]{re.escape(m)}", p) for p in piece))
        # How ids are written before another one of their side, and before what ends their side.
        self.written = pa.array([f"{i}{end}" for ends, t in ((",|", self.bytes_a), (",;", self.bytes_b)) for i in range(len(t)) for end in ends], pa.large_binary())
        self.known = Memory(UNIT)

    def _ids_a(self, word: str, bare: bool) -> bytes:
        if word.isascii() and word.isalpha():
            return self.a._letters(word, "" if bare else self.a.lead)
        # The pieces' own encoder for words; anything with white space in it goes to the library as it is.
        return self.a._ids(word if bare else " " + word) if _WHITE.search(word) else self.a._long(word, bare)

    def _ids_b(self, words: list[tuple[str, bool]]) -> list[list[int]]:
        """B sets a space before whatever it encodes; after a line end it adds none."""
        found = self.b.encode(["\n" + word if bare else word for word, bare in words], num_threads=1)
        return [ids[2:] if bare else ids for (_, bare), ids in zip(words, found)]

    def _made(self, units: list[str]) -> dict[str, pa.Array]:
        """Units aligned together: their tokens lie one after the other."""
        words = list(map(_word, units))
        whole = [(word if bare else " " + word).encode() for word, bare in words]
        ids = [[self._ids_a(*w) for w in words], self._ids_b(words)]
        every = np.frombuffer(b"".join(ids[0]), "<u4").tolist()
        size = [len(x) >> 2 for x in ids[0]]
        first = [0, *np.cumsum(size).tolist()]
        ids[0] = [every[x:y] for x, y in zip(first, first[1:])]
        entry_a, entry_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        lossless = [b"".join(map(entry_a, a)) == want == b"".join(map(entry_b, b)) for a, b, want in zip(*ids, whole)]
        at = [i for i, ok in enumerate(lossless) if ok]
        if not at:
            return {c: pa.nulls(len(units), kind) for c, kind in UNIT.items()}
        count = [np.array([len(side[i]) for i in at]) for side in ids]
        a, b = (np.fromiter(chain.from_iterable(side[i] for i in at), np.int64, int(n.sum())) for side, n in zip(ids, count))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        in_a, in_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        n = len(cuts)
        size_a, size_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        unit = np.searchsorted(np.cumsum([len(whole[i]) for i in at]), cuts)  # of each group

        # Links: each A token with the B tokens of its group. Groups of very many are counted by themselves.
        many = size_a * size_b > MANY_LINKS
        each = np.where(many, 0, size_b)[in_a]
        codes = [np.repeat(a, each) << 32 | b[segments_of(first_b[in_a], each)]]
        owner, times = [np.repeat(unit[in_a], each)], [np.ones(int(each.sum()), np.int64)]
        for g in np.flatnonzero(many):
            code, k = _crossed(a[first_a[g] : first_a[g] + size_a[g]].tolist(), b[first_b[g] : first_b[g] + size_b[g]].tolist())
            codes.append(code)
            times.append(k)
            owner.append(np.full(len(code), unit[g]))
        code, owner = np.concatenate(codes), np.concatenate(owner)
        different, back = np.unique(code, return_inverse=True)
        held, links, _ = grouped(owner * len(different) + back, np.concatenate(times))
        pair_at = np.searchsorted(held // len(different), np.arange(len(at) + 1))

        # In writing: the A tokens of a group, then its B tokens.
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.append(np.diff(g) > 0, True) for g in (in_a, in_b))
        order[np.arange(len(a)) + first_b[in_a]] = 2 * a + last_a
        order[np.arange(len(b)) + (first_a + size_a)[in_b]] = 2 * (len(self.bytes_a) + b) + last_b
        _, offsets, line = self.written.take(pa.array(order)).buffers()
        text_at = np.frombuffer(offsets, np.int64)[np.concatenate(([0], np.cumsum(count[0] + count[1])))]
        groups = np.bincount(unit, minlength=len(at))
        of_unit = pa.array(pair_at.astype(np.int32))
        made = {
            "written": pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(text_at.astype(np.int32)), line]),
            **{c: pa.array(n.astype(np.int32)) for c, n in zip(("n_a", "n_b", "n_groups"), (*count, groups))},
            **{c: pa.ListArray.from_arrays(of_unit, pa.array(x)) for c, x in (("pairs", different[held % len(different)]), ("times", links.astype(np.int64)))},
        }
        if len(at) < len(units):
            place = np.full(len(units), -1)
            place[at] = np.arange(len(at))
            made = {c: x.take(pa.array(place, mask=place < 0)) for c, x in made.items()}
        return made

    def units(self, units: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Where each of many units, each a word without the space before it, is in the columns of ``UNIT``."""
        at, fresh = self.known.coded(units)
        made = [self._made(fresh[i : i + AT_ONCE].to_pylist()) for i in range(0, len(fresh), AT_ONCE)]
        self.known.add(fresh, {c: pa.concat_arrays([m[c] for m in made]) for c in UNIT} if made else {})
        found = self.known.columns
        self.known.forget(at, MEMORY_BYTES)
        return at.astype(np.int64), found


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and pair of vocabularies."""
    return Aligner(path_a, path_b)


def _odd_units(text: str) -> list[str]:
    """Parts at spaces that follow another character; a run of blanks stays with what it leads to."""
    return list(map(_marked, _SPACE.split(text)))


def _marked(word: str) -> str:
    return _PLAIN + word if word.startswith((_BARE, _PLAIN)) else word


def _word(unit: str) -> tuple[str, bool]:
    """The text of a unit and whether it is bare."""
    return (unit[1:], unit[0] == _BARE) if unit.startswith((_BARE, _PLAIN)) else (unit, False)


def _parted(texts: pa.Array, marks: str) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, one after the other, and where each text's begin (one more than texts)."""
    simple = plain_texts(texts)
    # Line ends are units by themselves, and the word after one is bare, as is a mark after a letter.
    easy = pc.replace_substring(texts.filter(pa.array(simple)), "\n", f" {_BARE}\n {_BARE}")
    if marks:
        easy = pc.replace_substring_regex(easy, f"([{_LETTERS}])([{re.escape(marks)}])", rf"\1 {_BARE}\2")
    lists = pc.split_pattern(easy, " ")
    size = np.zeros(len(texts), np.int64)
    size[simple] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    odd = {i: _odd_units(texts[i].as_py()) for i in np.flatnonzero(~simple).tolist()}
    for i, units in odd.items():
        size[i] = len(units)
    bounds = np.concatenate(([0], np.cumsum(size)))
    if not odd:
        return lists.flatten(), bounds
    # Simple texts' units keep their order; the others are put between them.
    flat = pa.concat_arrays([lists.flatten(), pa.array([u for units in odd.values() for u in units], pa.string())])
    n_simple = int(size[simple].sum())
    place = np.zeros(len(texts), np.int64)
    place[simple] = np.cumsum(size[simple]) - size[simple]
    place[~simple] = n_simple + np.cumsum(size[~simple]) - size[~simple]
    return flat.take(pa.array(segments_of(place, size))), bounds


def _numbered(at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers below ``most`` in order, and each one's place among them."""
    met = np.zeros(most, bool)
    met[at] = True
    return np.flatnonzero(met), (np.cumsum(met) - 1)[at]


def _shrunk(*arrays: np.ndarray) -> tuple[list[int], bytes]:
    """Arrays of small numbers as one value: their lengths and bytes."""
    return [len(x) for x in arrays], zlib.compress(b"".join(x.astype("<u4").tobytes() for x in arrays), 1)


def _expanded(sizes: list[int], packed: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64), np.cumsum(sizes)[:-1])


MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
BLOCK = f"block long, keys array<binary>, {', '.join(f'{c} array<long>' for c in MEASURES)}, groups array<string>, pairs array<long>, held array<long>, sizes array<int>, packed binary"


def _block(texts: pa.Array, copies: np.ndarray, tool: Aligner, whole: bool) -> dict:
    """A row of some distinct texts. ``whole``: the groups as they are written, not their SHA-256."""
    units, bounds = _parted(texts, tool.marks)
    at, found = tool.units(units)
    lossy = found["n_a"].is_null().to_numpy(zero_copy_only=False)
    if lossy[at].any():  # parts may make up for each other, so such a text is judged as a whole
        size, given, judged = np.diff(bounds), [at[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())], [found]
        for i in np.flatnonzero([lossy[x].any() for x in given]):
            one = tool._made([_marked(texts[int(i)].as_py())])
            given[i] = np.array([len(lossy) + len(judged) - 1] if one["n_a"].null_count == 0 else [], np.int64)
            size[i] = len(given[i])
            judged.append(one)
        found = {c: pa.concat_arrays([x[c] for x in judged]) for c in UNIT}
        at, bounds = np.concatenate(given), np.concatenate(([0], np.cumsum(size)))
    used, at = _numbered(at, len(found["n_a"]))
    found = {c: x.take(pa.array(used)) for c, x in found.items()}
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    n_pairs = np.diff(found["pairs"].offsets.to_numpy()).astype(np.int64)
    pairs, times = (found[c].flatten().to_numpy() for c in ("pairs", "times"))
    counts = {c: found[c].to_numpy() for c in ("n_a", "n_b", "n_groups")} | {"n_links": np.bincount(np.repeat(np.arange(len(n_pairs)), n_pairs), times, len(n_pairs))}
    summed = {c: np.bincount(text_of, np.asarray(v, np.int64)[at] if len(at) else None, len(texts)).astype(np.int64) for c, v in counts.items()}
    _, line_at, line = found["written"].cast(pa.large_binary()).take(pa.array(at)).buffers()
    line_at, line = np.frombuffer(line_at, np.int64)[bounds].tolist(), memoryview(line or b"")
    lines = [line[i : max(i, j - 1)] for i, j in zip(line_at, line_at[1:])]
    lines = [str(x, "ascii") if whole else hashlib.sha256(x).hexdigest() if x else "" for x in lines]
    pair, _, pair_at = grouped(pairs)
    # Each text's different units, then its different pairs.
    n = max(len(used), 1)
    of_text, often, _ = grouped(text_of * n + at)
    doc, unit = of_text // n, of_text % n
    start = np.cumsum(n_pairs) - n_pairs
    m = max(len(pair), 1)
    holds, _, _ = grouped(np.repeat(doc, n_pairs[unit]) * m + pair_at[segments_of(start[unit], n_pairs[unit])]) if len(pair) else (np.zeros(0, np.int64),) * 3
    held = np.zeros(len(pair), np.int64)
    np.add.at(held, holds % m, copies[holds // m])
    sizes, packed = _shrunk(pair_at, times, n_pairs, unit, often, np.bincount(doc, minlength=len(texts)))
    keys = [hashlib.sha256(t.as_py().encode()).digest() for t in texts]
    return {"keys": keys, **{c: v.tolist() for c, v in summed.items()}, "groups": lines, "pairs": pair.tolist(), "held": held.tolist(), "sizes": sizes, "packed": packed}


def _blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, whole: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    numbers = pa.list_(pa.int64())
    lists = {"keys": pa.list_(pa.binary()), **dict.fromkeys(MEASURES, numbers), "groups": pa.list_(pa.string()), "pairs": numbers, "held": numbers, "sizes": pa.list_(pa.int32()), "packed": pa.binary()}
    for batch in batches:
        first, copies = 0, batch.column("copies").to_numpy()
        for texts in parts_of(batch.column("text"), BLOCK_BYTES):
            row = _block(texts, copies[first : first + len(texts)], aligner(path_a, path_b), whole)
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), **{c: pa.array([row[c]], kind) for c, kind in lists.items()}})
            number, first = number + 1, first + len(texts)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            of = lambda c: batch.column(c)[i]  # noqa: E731, B023
            pair_at, times, n_pairs, unit, often, n_units = _expanded(of("sizes").as_py(), of("packed").as_py())
            count = of("counts").values.to_numpy(zero_copy_only=False) if of("counts").is_valid else np.zeros(0, np.int64)
            best = of("bests").values.to_numpy(zero_copy_only=False) if of("bests").is_valid else np.zeros(0, bool)
            unit_of = np.repeat(np.arange(len(n_pairs)), n_pairs)
            text_of = np.repeat(np.arange(len(n_units)), n_units)
            out = {}
            for name, value in (("n_best", times * best[pair_at]), ("count_sum", times * count[pair_at])):
                by_unit, by_text = np.zeros(len(n_pairs), np.int64), np.zeros(len(n_units), np.int64)
                np.add.at(by_unit, unit_of, value)
                np.add.at(by_text, text_of, often * by_unit[unit])
                out[name] = by_text
            yield pa.RecordBatch.from_pydict({"key": of("keys").values, **{c: of(c).values for c in [*MEASURES, "groups"]}, **out})


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, whole: bool = False) -> DataFrame:
    """Blocks of the distinct texts of ``docs``."""
    texts = plain(docs, "text").filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return saved(texts.mapInArrow(lambda b: _blocks(b, path_a, path_b, whole), BLOCK), "blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, count (documents that hold the pair linked) and best (no pair of its A id counts more)."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("count"))
    counts = saved(counts.select("pair", F.shiftrightunsigned("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "count"), "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, whole: bool = False) -> DataFrame:
    """doc_id, measures and groups (their SHA-256, or ``whole`` in writing) of every row."""
    blocks = aligned_blocks(docs, path_a, path_b, whole)
    counts = pair_counts(blocks).select("pair", "count", "best")
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    answer = asked.join(counts, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("x"))
    answer = answer.select("block", F.col("x.count").alias("counts"), F.col("x.best").alias("bests"))
    known = blocks.select("block", "keys", *MEASURES, "groups", "sizes", "packed").join(answer, "block", "left")
    measures = [*MEASURES, "n_best", "count_sum"]
    schema = "key binary, " + ", ".join(f"{c} long" for c in MEASURES) + ", groups string, n_best long, count_sum long"
    of_text = saved(known.mapInArrow(_measured, schema), "measures")
    named = plain(docs, "doc_id", "text").select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    return named.join(of_text, "key", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in measures], F.coalesce("groups", F.lit("")).alias("groups"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"), vocabulary(A), vocabulary(B))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
