"""Operator 6: benchmark decontamination by SimHash windows, all in DataFrame functions.

An item of m words is looked for in windows of m words (a shorter document is one
window). Words are runs of letters and digits in lower case; a window's content is
the bag of its five-word shingles. A window and an item match if the weighted
Jaccard similarity of their bags, shingles weighted by their counts, is at least
0.8.

1. Windows. A window that matches shares a shingle with the item. Sliding a window
   to the right up to the next shared shingle, or to the document's end, never
   loses one, so the windows that start at a shared shingle or end the document
   include a best one.
2. Fingerprints. Every such window and every item has a SimHash of its bag, whose
   elements are the shingles with the number of their occurrence, so that a repeated
   shingle weighs no more than different ones: ``BLOCKS`` blocks of ``WIDE`` bits.
3. Candidates. Two fingerprints within ``RADIUS`` bits have a block in which they
   differ in at most ``PROBE`` bits. An index on (size, block, value) holds every value
   within ``PROBE`` bits of each item's blocks, so a window finds all items within the
   radius by its own values. Of 252 bits, 38 are expected to differ at similarity 0.8,
   with a deviation of 5.7; the radius lies three deviations above. Unrelated windows meet
   in a block with a chance of about one in sixteen.
4. Verification by the exact weighted similarity.

Defined cases: null, empty and wordless texts and items match nothing; an item of
fewer than five words is one shingle of its own width; equal rows of documents each
match; repeated rows of the benchmark count once, different texts under one item id each
stand for it; null ids of documents and of items stay and match like others; extra columns
are ignored, or stay as they are; empty tables give an empty result. Ties between windows:
the first one is reported. Very long texts are read whole, in arrays of their words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import plain, saved, table, unused

WIDTH = 5
BLOCKS, WIDE, PROBE = 14, 18, 3
RADIUS = BLOCKS * (PROBE + 1) - 1
SIMILARITY = 0.8
#: Item shingles up to this number go to every task (16 bytes each); more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def word_hashes(text: str | Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.coalesce(F.transform(found, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def shingle_array(hashes: str, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order; none if there are fewer words."""
    n = F.size(hashes) - (width - 1)
    parts = [F.slice(hashes, i + 1, F.greatest(n, F.lit(0))) for i in range(width)]
    names = [f"w{i}" for i in range(width)]
    zipped = F.arrays_zip(*[p.alias(x) for p, x in zip(parts, names)])
    return F.transform(zipped, lambda z: F.xxhash64(*[z[x] for x in names]))


#: Two counters in one sum.
_BOTH = (1 << 32) + 1


def simhash(bags: DataFrame, *key: str) -> DataFrame:
    """``print``, the blocks of a fingerprint, and ``size`` for each key of a table of (key, shingle, c): shingles with their counts."""
    numbered = bags.select(*key, "shingle", F.explode(F.sequence(F.lit(1), "c")).alias("k"))
    hashed = numbered.select(*key, *[F.xxhash64("shingle", "k", F.lit(w)).alias(f"h{w}") for w in range(4)])
    # Bits j and j + 32 of a hash are counted by one sum.
    sums = [F.sum(F.shiftright(f"h{w}", j).bitwiseAND(F.lit(_BOTH))).alias(f"s{w}_{j}") for w in range(4) for j in range(32)]
    summed = hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), *sums)

    def bit(j: int) -> Column:
        both = F.col(f"s{j // 64}_{j % 32}")
        ones = F.shiftrightunsigned(both, 32) if j % 64 >= 32 else both.bitwiseAND(F.lit((1 << 32) - 1))
        return ones * 2 > F.col("size")

    def block(b: int) -> Column:
        return reduce(lambda x, y: x + y, [F.when(bit(b * WIDE + i), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(WIDE)])

    return summed.select(*key, "size", F.array(*[block(b) for b in range(BLOCKS)]).alias("print"))


def indexed(prints: DataFrame, print_: str) -> DataFrame:
    """A row for each block of each fingerprint."""
    return prints.select("*", F.posexplode(print_).alias("block", "value"))


#: All values of a block within ``PROBE`` bits of zero: 988 of them.
MASKS = [x for x in range(1 << WIDE) if x.bit_count() <= PROBE]


def probed(prints: DataFrame, print_: str) -> DataFrame:
    """``indexed``, with every value within ``PROBE`` bits of each block's: 988 rows a block, for the few items only."""
    return indexed(prints, print_).withColumn("mask", F.explode(F.lit(MASKS))).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")


def _differing(a: str, b: str) -> list[Column]:
    """How many bits of each block differ."""
    return [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(BLOCKS)]


def within_radius(a: str, b: str) -> Column:
    """Whether two fingerprints are near, and ``block`` is the first one that brings them together: a pair that meets in several is kept once."""
    bits = _differing(a, b)
    first = F.lit(None).cast("int")
    for i in reversed(range(BLOCKS)):
        first = F.when(bits[i] <= PROBE, F.lit(i)).otherwise(first)
    return (reduce(lambda x, y: x + y, bits) <= RADIUS) & (first == F.col("block"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item_key, m words, shingle width, shingles in order, for each different (id, text)."""
    rows = plain(benchmark, "item_id", "text").distinct().withColumn("item_key", F.xxhash64("item_id", "text"))
    hashed = rows.select("item_id", "item_key", word_hashes("text").alias("hashes")).filter(F.size("hashes") > 0)
    hashed = hashed.withColumn("m", F.size("hashes")).withColumn("width", F.least("m", F.lit(WIDTH)))
    bag = shingle_array("hashes", 1)
    for width in range(2, WIDTH + 1):
        bag = F.when(F.col("width") == width, shingle_array("hashes", width)).otherwise(bag)
    return hashed.select("item_id", "item_key", "m", "width", bag.alias("bag"))


def _start() -> Column:
    """Where a window begins whose first shared shingle is ``at``: there, but no later than the last whole window."""
    return F.least("at", F.greatest(F.col("n") - F.col("m"), F.lit(0)))


def _bag(width: int) -> Column:
    return F.slice("all", F.col("start") + 1, F.greatest(F.col("m") - (width - 1), F.lit(1)))


def windows_of(docs: DataFrame, entries: DataFrame, width: int, small: bool) -> DataFrame:
    """doc_id, row_key, m, start and bag of the windows that share a shingle with an item of their size.

    The shingles alone meet the items, in place if those are few. Then each document
    that has windows meets their list, by a merge join at every size of input, and only
    such documents are cut again.
    """
    rows = docs.select("doc_id", "row_key", word_hashes("text").alias("hashes"))
    shingled = rows.select("doc_id", "row_key", F.size("hashes").alias("n"), F.posexplode(shingle_array("hashes", width)).alias("at", "shingle"))
    hits = shingled.join(F.broadcast(entries) if small else entries, "shingle").select("doc_id", "row_key", "m", _start().alias("start"))
    lists = saved(hits.distinct().groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("m", "start")).alias("windows")), "windows")
    same = (docs["row_key"] == lists["row_key"]) & docs["doc_id"].eqNullSafe(lists["doc_id"])
    held = docs.join(lists.hint("merge"), same).select(docs["doc_id"], docs["row_key"], word_hashes("text").alias("hashes"), "windows")
    cut = held.select("doc_id", "row_key", shingle_array("hashes", width).alias("all"), F.explode("windows").alias("w"))
    return cut.select("doc_id", "row_key", "w.m", "w.start", "all").select("doc_id", "row_key", "m", "start", _bag(width).alias("bag"))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row_key, item_id, start_word (from 0) and similarity of the best window for each document and item that match."""
    items = saved(items_of(benchmark), "items")
    entries = saved(items.select("width", "m", F.explode("bag").alias("shingle")).distinct(), "shingles")
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # at most WIDTH
    small = entries.count() <= BROADCAST_SHINGLES
    docs = plain(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))

    window = ["doc_id", "row_key", "m", "start"]
    bags = None
    for width in sorted(widths):
        of_width = entries.filter(F.col("width") == width).select("shingle", "m")
        rows = windows_of(docs, of_width, width, small)
        # Equal rows have equal windows: one of each is enough.
        rows = rows.groupBy(*window).agg(F.first("bag").alias("bag")).select(*window, F.explode("bag").alias("shingle"))
        bags = rows if bags is None else bags.unionByName(rows)
    if bags is None:
        return docs.limit(0).select("doc_id", "row_key", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start_word"), F.lit(0.0).alias("similarity"))
    bags = saved(bags.groupBy(*window, "shingle").agg(F.count(F.lit(1)).cast("int").alias("c")), "bags")
    item_bags = items.select("item_id", "item_key", "m", F.explode("bag").alias("shingle")).groupBy("item_id", "item_key", "m", "shingle").agg(F.count(F.lit(1)).cast("int").alias("c"))
    item_bags = saved(item_bags, "counts")

    near = candidates(bags, item_bags, window)
    counts = item_bags.select("item_key", "shingle", F.col("c").alias("c_i"))
    one = near.join(bags.drop("doc_id"), window[1:]).join(counts, ["item_key", "shingle"])
    shared = one.groupBy(*window, "item_id", "item_key", "size_w", "size_i").agg(F.sum(F.least("c", "c_i")).alias("shared"))
    scored = shared.withColumn("similarity", F.col("shared") / (F.col("size_w") + F.col("size_i") - F.col("shared"))).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "row_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "row_key", "item_id", (-F.col("best.back")).alias("start_word"), F.round("best.similarity", 6).alias("similarity"))


def candidates(bags: DataFrame, item_bags: DataFrame, window: list[str]) -> DataFrame:
    """Windows and items of one size whose fingerprints lie within ``RADIUS``."""
    prints = simhash(bags, *window).withColumnRenamed("size", "size_w")
    item_prints = simhash(item_bags, "item_id", "item_key", "m").withColumnRenamed("size", "size_i").withColumnRenamed("print", "print_i")
    item_index = saved(probed(item_prints, "print_i"), "index")
    near = indexed(prints, "print").join(item_index, ["m", "block", "value"]).filter(within_radius("print", "print_i"))
    return saved(near.select(*window, "size_w", "item_id", "item_key", "size_i"), "near")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item, with the columns they came with, whatever their names."""
    key = unused(docs, "row_key")
    leaks = saved(matches(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("row_key").alias("leak_key")).distinct(), "leaks")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    kept = keyed.join(leaks, (keyed[key] == leaks["leak_key"]) & keyed["doc_id"].eqNullSafe(leaks["leak_id"]), "left_anti")
    return kept.select(*[keyed[c] for c in docs.columns])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "similarity")
