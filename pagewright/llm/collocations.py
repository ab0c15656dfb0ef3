"""Operator 13: collocations from count transducers of n-grams.

Per language, phrases of 2 to ``WORDS`` words that occur at least ``LEAST`` times are
scored by their worst cut into two parts: occurrences times all words, over the product
of the parts' occurrences.

1. Words, then pairs of frequent words, are counted by hash; the keys with at least
   ``LEAST`` occurrences make bit filters of bounded size: of words, of pairs, and of words
   that have a frequent pair. A phrase that is frequent passes with all its words and
   pairs, so the filters only ever let too much pass.
2. Each task builds a count transducer from its n-grams in sorted order, block by block,
   unites them as it goes, and writes it in slices: a row for each first word with all
   that follows it, or, if the corpus has many frequent pairs with that word (``WIDE``),
   a row for each of its pairs. A task's transducer is written out when it grows beyond
   ``ARCS`` arcs.
3. The slices are dealt out by ranges of their prefix (language, first word, second word)
   and united; weights are summed, and arcs under ``LEAST`` are dropped. A prefix has a
   row at most for each time that a task wrote, whatever its number of occurrences.
4. The parts of all cuts are acceptors, one for each slice; composed with the slice's
   transducer they give the parts' counts.

Scores are exact: products are decimals of 38 digits.

Defined cases: null language counts as ``und``; null, empty and wordless texts add
nothing; equal rows count each; ids don't matter; extra columns are ignored; an empty
table gives an empty result. A phrase's ties of score and cut go to the shortest first
part. A very long text is taken in blocks cut where its pieces end; a stretch without any
end of a piece is one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.automata import Transducer, grouped, numbered, union
from pagewright.llm.common import plain, saved, table
from pagewright.llm.kernels import U64, chunks, mix, utf8
from pagewright.llm.words import lowered, word_ranges

LEAST, WORDS, TOP = 100, 5, 2000
#: A candidate falls to a longer one with so many hundredths of its occurrences.
PERCENT = 100
NO_LANGUAGE = "und"
#: Bytes of text taken together.
BLOCK = 1 << 20
#: Arcs of a task's transducer.
ARCS = 1 << 20
#: Frequent pairs of one first word from which on its slices are by pair.
WIDE = 1 << 14
#: Arcs of the rows that are passed on together.
ROW_ARCS = 1 << 17
#: Bits for each key of a filter; least and most bits of one (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 27

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_OUTSIDE = _ENDS.copy()
_OUTSIDE[[9, 32]] = True


@dataclass
class Block:
    word: np.ndarray  # number of each word in the vocabulary
    vocabulary: pa.Array
    follows: np.ndarray  # whether the next word follows in the same piece
    lang: np.ndarray  # of each word
    langs: pa.Array

    def keys(self) -> np.ndarray:
        """A 64-bit key of each word in its language."""
        return keys_of(self.langs, self.lang, self.vocabulary, self.word)


def keys_of(langs: pa.Array, lang: np.ndarray, words: pa.Array, word: np.ndarray) -> np.ndarray:
    name = lambda strings: np.fromiter((xxhash.xxh64_intdigest(s) for s in strings.to_pylist()), U64, len(strings))
    return mix(name(words)[word] + mix(name(langs))[lang])


def _cuts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of about ``BLOCK`` bytes of one text, cut where pieces end."""
    while len(data) > BLOCK:
        ends = np.flatnonzero(_ENDS[data[:BLOCK]])
        if len(ends):
            cut = int(ends[-1]) + 1
        else:
            cut = next((a + int(x[0]) + 1 for a in range(BLOCK, len(data), BLOCK) if len(x := np.flatnonzero(_ENDS[data[a : a + BLOCK]]))), len(data))
        yield data[:cut]
        data = data[cut:]
    yield data


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        langs = batch.column("lang").cast(pa.binary()).dictionary_encode()
        of_doc = langs.indices.to_numpy()
        data, offsets = utf8(batch.column("text"))
        first = 0
        for _, part, at in chunks(data, offsets, BLOCK):
            n = len(at) - 1
            for text in _cuts(part) if n == 1 else [part]:
                where = np.array([0, len(text)]) if n == 1 else at
                start, end, bounds = word_ranges(text, where, _OUTSIDE)
                if not len(start):
                    continue
                size = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
                letters = lowered(text[~_OUTSIDE[text]])
                words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(size), pa.py_buffer(letters)]).dictionary_encode()
                doc = np.repeat(np.arange(n), np.diff(bounds))
                ended = np.cumsum(_ENDS[text], dtype=np.int32)
                follows = np.append((doc[1:] == doc[:-1]) & (ended[start[1:]] == ended[end[:-1] - 1]), False)
                yield Block(words.indices.to_numpy().astype(np.int64), words.dictionary, follows, of_doc[first + doc].astype(np.int64), langs.dictionary)
            first += n


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, n, _ = grouped(key.view(np.int64))
    return key, n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the words, and (lang, n) of all words of a language."""
    for block in _blocks(batches):
        lang, n, _ = grouped(block.lang)
        yield pa.RecordBatch.from_pydict({"lang": block.langs.take(pa.array(lang)).cast(pa.string()), "key": pa.nulls(len(n), pa.int64()), "n": n})
        key, n = _counted(block.keys())
        yield pa.RecordBatch.from_pydict({"lang": pa.nulls(len(n), pa.string()), "key": key, "n": n})


def _passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = (key ^ (key >> U64(37))) & U64(8 * len(bits) - 1)
    return (bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0


def _short(key: np.ndarray) -> np.ndarray:
    """A word's half of a pair's key."""
    return key >> U64(32)


def _pairs(block: Block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' keys; whether each word and the next one of its piece pass; the pairs' keys, made of a half of each."""
    key = block.keys()
    passes = _passes(words, key)
    return key, block.follows[:-1] & passes[:-1] & passes[1:], (_short(key[:-1]) << U64(32)) | _short(key[1:])


def _pair_counts(batches: Iterator[pa.RecordBatch], words) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        _, both, key = _pairs(block, words.value)
        key, n = _counted(key[both])
        yield pa.RecordBatch.from_pydict({"key": key, "n": n})


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bits that hold every key (column ``key``), ``BITS_EACH`` for each, ``MOST_BITS`` at most."""
    n = keys.agg(F.count(F.lit(1))).first()[0]
    size = min(max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()), MOST_BITS)
    spot = keys.select(F.col("key").bitwiseXOR(F.shiftrightunsigned("key", 37)).bitwiseAND(size - 1).alias("x"))
    rows = spot.groupBy(F.expr("x div 32768").alias("k")).agg(F.expr("bitmap_construct_agg(x % 32768)").alias("bits")).collect()  # MOST_BITS / 32768 rows at most
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[4096 * r["k"] : 4096 * (r["k"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    return out


def ngrams_of(block: Block, words: np.ndarray, pairs: np.ndarray, paired: np.ndarray) -> Transducer:
    """The block's words that have frequent pairs and its n-grams of pairs that pass: language, then words."""
    key, both, pair = _pairs(block, words)
    both &= _passes(pairs, pair)
    at = np.flatnonzero(_passes(paired, _short(key)))
    vocabulary, number = numbered(pa.concat_arrays([block.langs, block.vocabulary]))
    lang, word = number[: len(block.langs)][block.lang], number[len(block.langs) :][block.word]
    out = Transducer(vocabulary)
    state = out.grow(np.zeros(len(at), np.int64), lang[at], np.zeros(len(at), np.int64))
    state = out.grow(state, word[at])
    for d in range(1, WORDS):
        on = at + d - 1 < len(both)
        on[on] = both[at[on] + d - 1]
        at, state = at[on], state[on]
        state = out.grow(state, word[at + d])
    return out


SLICE = "lang string, first string, second string, n long, depth array<int>, label array<string>, weight array<long>"


def slices(t: Transducer, wide: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each first word (``second`` empty), and one for each pair of the words in the filter ``wide``.

    n is the row's own count; depth, label and weight list what follows, each arc before
    those under it. The row of a wide word lists nothing.
    """
    n = len(t.label[1])
    if not n:
        return
    is_wide = _passes(wide, _short(keys_of(t.vocabulary, t.label[0][t.parent[1]], t.vocabulary, t.label[1]))) if len(t.label) > 2 else np.zeros(n, bool)
    pairs = np.flatnonzero(is_wide[t.parent[2]]) if len(t.label) > 2 else np.zeros(0, np.int64)
    deep = range(2, len(t.label))
    sizes = [len(t.label[d]) for d in deep]
    # States are numbered in the order of their paths, so those on the way to an arc, none beyond it, sort the arcs.
    on_way = [np.concatenate([t.ancestors(d, level) if d >= level else np.full(k, -1) for d, k in zip(deep, sizes)]) for level in deep]
    depth = np.repeat(np.array(deep, np.int32), sizes)
    label, weight = (np.concatenate([np.zeros(0, np.int64), *(x[d] for d in deep)]) for x in (t.label, t.weight))
    if len(depth):
        first = t.parent[2][on_way[0]]
        row = np.where(is_wide[first], n + np.searchsorted(pairs, on_way[0]), first)
        kept = np.flatnonzero(~(is_wide[first] & (depth == 2)))  # these are rows themselves
        order = kept[np.lexsort([x[kept] for x in (*on_way[::-1], row)])]
        row, depth, label, weight = row[order], depth[order], label[order], weight[order]
    else:
        row = np.zeros(0, np.int64)
    state = np.concatenate((np.arange(n), t.parent[2][pairs] if len(pairs) else pairs))
    own = np.concatenate((t.weight[1], t.weight[2][pairs] if len(pairs) else pairs))
    text = lambda at: t.vocabulary.take(pa.array(at)).cast(pa.string())
    second = pa.concat_arrays([pa.array([""] * n, pa.string()), text(t.label[2][pairs] if len(pairs) else pairs)])
    bounds = np.searchsorted(row, np.arange(len(state) + 1))
    a = 0
    while a < len(state):
        b = min(max(a + 1, int(np.searchsorted(bounds, bounds[a] + ROW_ARCS, "right")) - 1), a + 8192, len(state))
        i, j = bounds[a], bounds[b]
        at = pa.array((bounds[a : b + 1] - i).astype(np.int32))
        lists = {"depth": pa.array(depth[i:j]), "label": text(label[i:j]), "weight": pa.array(weight[i:j])}
        of = state[a:b]
        yield pa.RecordBatch.from_pydict({"lang": text(t.label[0][t.parent[1][of]]), "first": text(t.label[1][of]), "second": second.slice(a, b - a), "n": own[a:b], **{c: pa.ListArray.from_arrays(at, x) for c, x in lists.items()}})
        a = b


def transducer_of(rows: pa.RecordBatch) -> Transducer:
    """The transducer of some slices, weights of equal paths summed."""
    columns = [rows.column(c) for c in ("lang", "first", "second")]
    lists = rows.column("depth")
    flat = rows.column("label").flatten()
    m = rows.num_rows
    vocabulary, number = numbered(pa.concat_arrays([c.cast(pa.string()) for c in [*columns, flat]]))
    lang, first, second, label = number[:m], number[m : 2 * m], number[2 * m : 3 * m], number[3 * m :]
    n = rows.column("n").to_numpy()
    pair = pc.not_equal(columns[2], "").to_numpy(zero_copy_only=False)
    out = Transducer(vocabulary)
    state = out.grow(np.zeros(m, np.int64), lang, np.zeros(m, np.int64))
    state = out.grow(state, first, np.where(pair, 0, n))
    depth, weight = lists.flatten().to_numpy(), rows.column("weight").flatten().to_numpy()
    of_row = np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy()))
    place = np.arange(len(depth))
    # Second words are rows of their own, or listed under their first word.
    here = depth == 2
    states = out.grow(np.concatenate((state[pair], state[of_row[here]])), np.concatenate((second[pair], label[here])), np.concatenate((n[pair], weight[here])))
    of_pair = np.full(m, -1)
    of_pair[pair] = states[: int(pair.sum())]
    reached = np.full(len(depth), -1)
    reached[here] = states[int(pair.sum()) :]
    for d in range(3, WORDS + 1):
        here = depth == d
        last = np.maximum.accumulate(np.where(depth == d - 1, place, -1)) if len(depth) else place  # the arc that those of depth d lie under
        parent = np.where(pair[of_row], of_pair[of_row], reached[last]) if d == 3 else reached[last]
        reached = np.full(len(depth), -1)
        reached[here] = out.grow(parent[here], label[here], weight[here])
    return out


def _shards(batches: Iterator[pa.RecordBatch], words, pairs, paired, wide) -> Iterator[pa.RecordBatch]:
    """A task's transducer, in slices."""
    parts: list[Transducer] = []
    for block in _blocks(batches):
        parts.append(ngrams_of(block, words.value, pairs.value, paired.value))
        if sum(map(len, parts)) > ARCS:
            parts = [union(parts)]
            if len(parts[0]) > ARCS // 2:
                yield from slices(parts.pop(), wide.value)
    if parts:
        yield from slices(union(parts), wide.value)


def _united(batches: Iterator[pa.RecordBatch], least: int, wide) -> Iterator[pa.RecordBatch]:
    """Slices sorted by prefix, united and cut at ``least``. The last prefix waits for the rows that may follow."""
    kept: pa.RecordBatch | None = None
    for batch in batches:
        rows = pa.Table.from_batches([kept, batch] if kept is not None else [batch]).combine_chunks().to_batches()[0]
        last = np.ones(rows.num_rows, bool)
        for c in ("lang", "first", "second"):
            last &= pc.equal(rows.column(c), rows.column(c)[rows.num_rows - 1]).to_numpy(zero_copy_only=False)
        cut = rows.num_rows - int(last.sum())
        if cut:
            yield from slices(transducer_of(rows.slice(0, cut)).at_least(least), wide.value)
        kept = _one_row(rows.slice(cut), wide.value)
    if kept is not None:
        yield from slices(transducer_of(kept).at_least(least), wide.value)


def _one_row(rows: pa.RecordBatch, wide: np.ndarray) -> pa.RecordBatch:
    """Rows of one prefix as one."""
    if rows.num_rows == 1:
        return rows
    second = rows.column("second")[0].as_py()
    for batch in slices(transducer_of(rows), wide):
        at = pc.index(batch.column("second"), second).as_py()
        if at >= 0:
            return batch.slice(at, 1)
    raise AssertionError("a prefix has a row")


def counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The slices of all n-grams that occur ``least`` times in their language, and (lang, n) with the number of all words."""
    spark = docs.sparkSession
    docs = plain(docs, "lang", "text").select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    found = saved(docs.mapInArrow(_word_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "words")
    totals = found.filter("key is null").select("lang", "n")
    words = spark.sparkContext.broadcast(bit_filter(found.filter((F.col("n") >= least) & F.col("lang").isNull())))
    met = docs.mapInArrow(lambda b: _pair_counts(b, words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    frequent = saved(met.filter(F.col("n") >= least).select("key"), "pairs")
    pairs = spark.sparkContext.broadcast(bit_filter(frequent))
    first, second = F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND((1 << 32) - 1)
    paired = spark.sparkContext.broadcast(bit_filter(saved(frequent.select(F.explode(F.array(first, second)).alias("key")).distinct(), "paired")))
    firsts = frequent.groupBy(first.alias("key")).agg(F.count(F.lit(1)).alias("k"))
    wide = spark.sparkContext.broadcast(bit_filter(firsts.filter(F.col("k") >= WIDE)))
    shards = saved(docs.mapInArrow(lambda b: _shards(b, words, pairs, paired, wide), SLICE), "shards")
    ranges = shards.repartitionByRange("lang", "first", "second").sortWithinPartitions("lang", "first", "second")
    return saved(ranges.mapInArrow(lambda b: _united(b, least, wide), SLICE).filter(F.col("n") >= least), "counts"), totals


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, a of the paths of two and more words."""
    for batch in batches:
        t = transducer_of(batch)
        for d in range(2, len(t.label)):
            if len(t.label[d]):
                lang = t.vocabulary.take(pa.array(t.label[0][t.ancestors(d, 0)]))
                yield pa.RecordBatch.from_pydict({"lang": lang.cast(pa.string()), "phrase": t.paths(d, 1).cast(pa.string()), "a": t.weight[d]})


def _acceptor(lang: pa.Array, paths: pa.Array) -> tuple[Transducer, list[np.ndarray]]:
    """An acceptor of some paths (lists of words), and for each depth the path that ends in each of its states, or -1."""
    m = len(lang)
    at, flat = paths.offsets.to_numpy(), paths.flatten()
    vocabulary, number = numbered(pa.concat_arrays([lang.cast(pa.string()), flat.cast(pa.string())]))
    at, size, word = at - at[0], np.diff(at), number[m:]
    out, ends, rows = Transducer(vocabulary), [], np.arange(m)
    state = out.grow(np.zeros(m, np.int64), number[:m])
    for d in range(int(size.max()) if m else 0):
        on = size[rows] > d
        rows, state = rows[on], state[on]
        state = out.grow(state, word[at[rows] + d])
        end = np.full(len(out.label[-1]), -1)
        done = size[rows] == d + 1
        end[state[done]] = rows[done]
        ends.append(end)
    return out, ends


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, part and n of the parts that are wanted of each slice."""
    for batch in batches:
        wanted = batch.column("parts")
        row = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
        parts, lang = wanted.flatten(), batch.column("lang").take(pa.array(row))
        acceptor, ends = _acceptor(lang, pc.split_pattern(parts, " "))
        weights = transducer_of(batch.select([c.split()[0] for c in SLICE.split(", ")])).weights_of(acceptor)
        for weight, end in zip(weights[1:], ends):
            done = end >= 0
            at = pa.array(end[done])
            yield pa.RecordBatch.from_pydict({"lang": lang.take(at), "part": parts.take(at), "n": weight[done]})


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    table_, totals = counts(docs, least)
    phrases = saved(table_.mapInArrow(_phrases, "lang string, phrase string, a long"), "phrases")

    words, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"))
    # The parts of a slice are paths of its transducer, so they are no more than it holds.
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    prefix = F.split("part", " ")
    by_pair = table_.filter("second <> ''").select("lang", "first", F.lit(True).alias("by_pair")).distinct()
    parts = parts.withColumns({"first": prefix[0], "second": F.coalesce(F.try_element_at(prefix, F.lit(2)), F.lit(""))}).join(by_pair, ["lang", "first"], "left")
    parts = parts.groupBy("lang", "first", F.when(F.col("by_pair"), F.col("second")).otherwise("").alias("second")).agg(F.collect_list("part").alias("parts"))
    known = saved(table_.join(parts, ["lang", "first", "second"]).mapInArrow(_composed, "lang string, part string, n long"), "parts")

    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("part").alias(side), F.col("n").alias(name)), ["lang", side])
    scored = cuts.join(totals, "lang").withColumn("score", F.expr("(1000 * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")

    inside = phrases.filter(size > 2).select("lang", "a", words.alias("w"), F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inside = inside.select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, size(w) - m + 1)")).alias("i"))
    longer = inside.groupBy("lang", F.array_join(F.expr("slice(w, i, m)"), " ").alias("phrase")).agg(F.max("a").alias("longest"))
    left = worst.join(longer, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < PERCENT * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # each task keeps its first ones before they meet
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same by counting every n-gram."""
    leads = ", ".join(f"lead(word, {k}) OVER o AS w{k + 1}" for k in range(1, WORDS))
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, concat_ws(' ', {', '.join(f'w{i}' for i in range(1, k + 1))}) AS phrase FROM followed WHERE w{k} IS NOT NULL" for k in range(1, WORDS + 1))
    return rf"""
WITH pieces AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, row_number() OVER () AS piece_no, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda v: v <> '') AS w FROM pieces),
words AS (SELECT lang, piece_no, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM cut),
followed AS (SELECT lang, word AS w1, {leads} FROM words WINDOW o AS (PARTITION BY piece_no ORDER BY place)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
grams AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
candidates AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS w, k AS size, f AS a FROM grams WHERE k > 1),
parted AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM candidates, range(1, size) q(j)),
scored AS (SELECT p.lang, p.phrase, a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM parted p JOIN totals t ON t.lang = p.lang JOIN grams x ON x.lang = p.lang AND x.phrase = p.head JOIN grams y ON y.lang = p.lang AND y.phrase = p.tail),
worst AS (SELECT lang, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM scored) WHERE nth = 1),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest FROM candidates, range(2, size) q(m), range(1, size - m + 2) s(i) GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < {PERCENT} * a)
SELECT * FROM ranked WHERE rank <= {TOP}"""
