"""Operator 7: an exact Jaccard join of shingle sets that skips by set relations.

A document is the set of its distinct five-word shingles. Two link if the sets'
Jaccard similarity is at least 0.8. Equal sets are one set from the first step
on, whatever number of documents have it.

Prefix lists: a set of n is listed under its first n - ceil(0.8 n) + 1 shingles in
a common order, so that linked sets meet in a list. The order is the shingle's
hash, except that frequent shingles (found by merged counts of each batch, at most
``MOST_FREQUENT``) come last by rising count. A list that grows beyond ``HEAVY`` all the
same makes its shingle a frequent one, and the lists are made anew.

Skipping between sets (answers): each list has a leader, the set in which the
shingle comes first: the one with the fewest shingles of its own, in a group of
copies the original. First all sets are compared with their lists' leaders only, a
number of pairs in proportion to the lists. A set that links to its leader takes over the leader's component, so
within a component no pair is compared again. For the pairs that remain, of
different components, the overlap with the common leader bounds their own: from
x to y it can exceed that of the leader with y only by the shingles x has and the
leader has not.

Skipping in lists (index): the lists are cut in blocks by set size, and blocks
whose sizes can't link never meet; in the blocks that do, the place of the shingle
in each set bounds what can still be shared.

A shingle is a 64-bit hash; a set's name is a 64-bit hash of its shingles.

Defined cases: null, empty and wordless texts have no shingles and link with
nothing; fewer than five words are one shingle of them all; equal rows link with
each other; a null id never names a component that has another id; extra columns
are ignored, or stay as they are; an empty table gives an empty result. Ties of place
and count go to the lesser name. A very long text is read in pieces; its set takes eight
bytes for each different shingle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import arrow_rows, plain, saved, table, unused
from pagewright.llm.components import components
from pagewright.llm.kernels import U64, chunks, mix, shingles, utf8, words

PERCENT = 80
WIDTH = 5
#: Shingles held to be frequent: from so many different sets on in the counts, and at most so many.
FREQUENT, MOST_FREQUENT = 6, 200_000
#: Sets under one shingle from which on the shingle counts as frequent, and how often the lists are made anew for that.
HEAVY, ROUNDS = 4096, 4
#: Least and most bits of the filter that keeps texts that stand in no list from being moved (at most 16 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Among so many leaders the lists that two sets share may be parted.
LEADERS = 6
#: Pairs of texts that a Python worker gets at a time.
PAIR_ROWS = 128


def _sets(data: np.ndarray, offsets: np.ndarray):
    """Shingles of each document, their bounds, sizes and the sets' names."""
    s, bounds = shingles(*words(data, offsets), WIDTH)
    size = np.diff(bounds)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64)))
    name = mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    return s, bounds, size, name.view(np.int64)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for first, part, at in chunks(data, offsets):
            _, _, size, name = _sets(part, at)
            n = len(size)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, n), "row_key": batch.column("row_key").slice(first, n), "name": pa.array(name), "n": pa.array(size.astype(np.int64))})


def _fresh(names: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One document for each set that has shingles."""
    keep = np.zeros(len(names), bool)
    keep[np.unique(names, return_index=True)[1]] = True
    return keep & (size > 0)


def _pick(s: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and owners of the kept documents."""
    owner = np.repeat(np.arange(len(keep)), np.diff(bounds))
    inside = keep[owner]
    return s[inside], owner[inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several different sets of a batch have, and how many."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        found = [np.zeros(0, U64)]
        for _, part, at in chunks(data, offsets):
            s, bounds, size, name = _sets(part, at)
            found.append(_pick(s, bounds, _fresh(name, size))[0])
        s = np.sort(np.concatenate(found))
        edges = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.append(edges, len(s)))
        many = count >= 2
        if many.any():
            yield pa.RecordBatch.from_pydict({"shingle": s[edges[many]].view(np.int64), "count": count[many].astype(np.int64)})


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in ascending order and their ranks by count: at most ``MOST_FREQUENT``."""
    counted = docs.mapInArrow(_counts, "shingle long, count long").groupBy("shingle").agg(F.sum("count").alias("count"))
    rows = counted.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).toArrow()
    s, count = (rows.column(c).to_numpy() for c in ("shingle", "count"))
    s = s.view(U64) if len(s) else np.zeros(0, U64)
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((s, count))] = np.arange(1, len(s) + 1)
    order = np.argsort(s)
    return s[order], rank[order]


def prefixes(data: np.ndarray, offsets: np.ndarray, frequent_ones: tuple[np.ndarray, np.ndarray]):
    """Shingle, set, size, place and whether frequent, of every entry of the prefix lists."""
    s, bounds, size, name = _sets(data, offsets)
    s, owner = _pick(s, bounds, _fresh(name, size))
    known, ranks = frequent_ones
    rank = np.zeros(len(s), np.int64)
    if len(known) and len(s):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        found = known[at] == s
        rank[found] = ranks[at[found]]
        order = np.argsort(owner * (len(known) + 1) + rank, kind="stable")
        s, rank = s[order], rank[order]
    place = np.arange(len(s)) - np.searchsorted(owner, owner)
    n = size[owner]
    keep = place < n - (PERCENT * n + 99) // 100 + 1
    return s[keep].view(np.int64), name[owner[keep]], n[keep], place[keep], rank[keep] > 0


_ENTRY = "shingle long, name long, n int, place int, hot boolean"


def _entries(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    tables = hot.value
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for _, part, at in chunks(data, offsets):
            s, name, n, place, is_hot = prefixes(part, at, tables)
            if len(s):
                yield pa.RecordBatch.from_pydict({"shingle": s, "name": name, "n": n.astype(np.int32), "place": place.astype(np.int32), "hot": is_hot})


_LISTED = "shingle long, name long, n int, place int, hot boolean, leader long, leader_n int, nth int"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come sorted by shingle, place and set. Those alone in their list go; the others get the list's first as leader.

    Entries under frequent shingles are dealt out over all tasks; they pass and get
    their leader later. Of a list only its first entry is remembered.
    """
    waiting: pa.RecordBatch | None = None  # the entry of a list that has one set so far
    shingle, leader, leader_n, held = None, None, None, 0  # of a list that is known to have several
    for batch in batches:
        hot = batch.column("hot").to_numpy(zero_copy_only=False)
        if hot.any():
            rows = batch.filter(pa.array(hot))
            yield _with_leader(rows, rows.column("name").to_numpy(), rows.column("n").to_numpy(), np.zeros(rows.num_rows, np.int64))
            batch = batch.filter(pa.array(~hot))
        if waiting is not None and batch.num_rows:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            waiting = None
        if not batch.num_rows:
            continue
        s, name, n = batch.column("shingle").to_numpy(), batch.column("name").to_numpy(), batch.column("n").to_numpy()
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))
        lead, lead_n = name[starts].copy(), n[starts].copy()
        nth = np.arange(1, len(s) + 1) - starts[group]
        several = np.logical_or.reduceat(name != lead[group], starts)
        if shingle is not None and s[0] == shingle:
            lead[0], lead_n[0], several[0] = leader, leader_n, True
            nth[group == 0] += held
        keep = several[group] & np.append(True, (s[1:] != s[:-1]) | (name[1:] != name[:-1]))
        rows = np.flatnonzero(keep)
        if len(rows):
            yield _with_leader(batch.take(pa.array(rows)), lead[group[rows]], lead_n[group[rows]], nth[rows])
        if several[-1]:
            shingle, leader, leader_n, held = s[-1], lead[-1], lead_n[-1], int(nth[-1])
        else:
            waiting = batch.slice(int(starts[-1]), 1)


def _with_leader(batch: pa.RecordBatch, leader: np.ndarray, leader_n: np.ndarray, nth: np.ndarray) -> pa.RecordBatch:
    columns = {c: batch.column(c) for c in ("shingle", "name", "n", "place", "hot")}
    return pa.RecordBatch.from_pydict({**columns, "leader": pa.array(leader), "leader_n": pa.array(leader_n), "nth": pa.array(nth.astype(np.int32))})


def _texts(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    bits = wanted.value
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for _, part, at in chunks(data, offsets):
            _, _, size, name = _sets(part, at)
            place = name % (8 * len(bits))
            keep = np.flatnonzero(_fresh(name, size) & ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0))
            if len(keep):
                packed = [zlib.compress(part[at[i] : at[i + 1]].tobytes(), 1) for i in keep]
                yield pa.RecordBatch.from_pydict({"name": pa.array(name[keep]), "packed": pa.array(packed, pa.binary())})


def _wanted(names: DataFrame) -> np.ndarray:
    """A filter that has at least every name: some eight bits each, ``MOST_BITS`` at most."""
    n = names.agg(F.approx_count_distinct("name")).first()[0]
    size = min(max(LEAST_BITS, 1 << (8 * n).bit_length()), MOST_BITS)
    spot = F.pmod("name", F.lit(size)) + 1
    rows = names.select(spot.alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:  # at most MOST_BITS / 32768 rows
        at = (int(r["k"]) - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the sets' intersection for each pair of packed texts. Each text of a slice is unpacked once."""
    for batch in batches:
        for first in range(0, batch.num_rows, 128):
            part = batch.slice(first, 128)
            m = part.num_rows
            names = np.concatenate([part.column(c).to_numpy() for c in ("a", "b")])
            each, at, back = np.unique(names, return_index=True, return_inverse=True)
            texts = [zlib.decompress(part.column("text_a" if i < m else "text_b")[int(i % m)].as_py()) for i in at]
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            data = np.frombuffer(b"".join(texts), np.uint8)
            sets: list[np.ndarray] = []
            for _, some, bounds_of in chunks(data, offsets):
                s, bounds, _, _ = _sets(some, bounds_of)
                sets += [s[i:j] for i, j in zip(bounds, bounds[1:])]
            shared = np.zeros(m, np.int64)
            for i in range(m):
                x, y = sets[back[i]], sets[back[m + i]]
                spot = np.searchsorted(y, x)
                spot[spot == len(y)] = len(y) - 1
                shared[i] = np.count_nonzero(y[spot] == x)
            size = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "n_a": pa.array(size[back[:m]]), "n_b": pa.array(size[back[m:]]), "shared": pa.array(shared)})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, shared for pairs of set names. Rows end up by b, which should be the side that repeats."""
    a = texts.select(F.col("name").alias("a"), F.col("packed").alias("text_a"))
    b = texts.select(F.col("name").alias("b"), F.col("packed").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_overlaps, "a long, b long, n_a long, n_b long, shared long")


def _enough_lists(c: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets whose prefixes share ``c`` shingles can link: the overlap is at most c and the larger of the rests.

    Of the two, take x whose prefix ends first in the common order. What x shares
    beyond its prefix is at most the rest of x; what it shares within is in the other's
    prefix as well.
    """
    rest = F.greatest(F.ceil(PERCENT * n_a / 100), F.ceil(PERCENT * n_b / 100)) - 1
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & ((100 + PERCENT) * F.least(c + rest, n_a, n_b) >= PERCENT * (n_a + n_b))


def _listed(docs: DataFrame) -> DataFrame:
    """The prefix lists with their leaders."""
    table_ = frequent(docs)
    for round_ in range(ROUNDS):
        hot = docs.sparkSession.sparkContext.broadcast(table_)
        entries = docs.mapInArrow(lambda b, hot=hot: _entries(b, hot), _ENTRY)
        dealt = entries.repartition(F.when(F.col("hot"), F.xxhash64("shingle", "name")).otherwise(F.col("shingle"))).sortWithinPartitions("hot", "shingle", "place", "name")
        listed = saved(dealt.mapInArrow(_lists, _LISTED), "listed")
        room = MOST_FREQUENT - len(table_[0])
        heavy = listed.filter(F.col("nth") == HEAVY).select("shingle").distinct().limit(max(room, 0)).toArrow().column("shingle").to_numpy() if round_ < ROUNDS - 1 and room > 0 else []
        if not len(heavy):
            break
        # Rarer than all that were found by counts.
        s = np.concatenate((heavy.view(U64), table_[0]))
        rank = np.concatenate((np.arange(1, len(heavy) + 1), table_[1] + len(heavy)))
        order = np.argsort(s)
        table_ = s[order], rank[order]
    return listed


def linked(docs: DataFrame) -> DataFrame:
    """(name, label): the sets that link with another set, and the least name of their component."""
    spark = docs.sparkSession
    docs = plain(docs, "text")
    listed = _listed(docs)
    # Lists under frequent shingles: at most MOST_FREQUENT leaders, found with partial aggregates.
    leaders = listed.filter("hot").groupBy("shingle").agg(F.min(F.struct("place", "name", "n")).alias("l"), F.min("name").alias("x"), F.max("name").alias("y")).filter("x <> y")
    leaders = saved(leaders.select("shingle", F.col("l.name").alias("leader"), F.col("l.n").alias("leader_n")), "leaders")
    columns = ["shingle", "name", "n", "place", "leader", "leader_n"]
    lists = listed.filter("not hot").select(*columns).unionByName(listed.filter("hot").drop("leader", "leader_n", "nth").dropDuplicates(["shingle", "name"]).join(leaders, "shingle").select(*columns))
    lists = saved(lists, "lists")

    wanted = spark.sparkContext.broadcast(_wanted(lists.select("name")))
    texts = saved(docs.mapInArrow(lambda b: _texts(b, wanted), "name long, packed binary").groupBy("name").agg(F.first("packed").alias("packed")), "texts")

    # First every set with the leaders it shares enough lists with; the others wait for the full count below.
    met = lists.filter("name <> leader").groupBy("name", "leader").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("leader_n").alias("leader_n"))
    # A group's lists may have a few leaders between them, so a part of the lists is enough here.
    pairs = met.filter(_enough_lists(LEADERS * F.col("c"), F.col("n"), F.col("leader_n"))).select(F.col("name").alias("a"), F.col("leader").alias("b"))
    with arrow_rows(spark, PAIR_ROWS):
        led = saved(verified(pairs, texts), "led")
    is_link = F.expr(f"100 * shared >= {PERCENT} * (n_a + n_b - shared)")
    first = saved(components(led.filter(is_link)), "components")

    # What the lists still have to say: pairs of different components.
    overlap = led.select(F.col("a").alias("name"), F.col("b").alias("leader"), "shared")
    known = lists.drop("leader_n").join(overlap, ["name", "leader"], "left")
    known = known.withColumn("shared", F.when(F.col("name") == F.col("leader"), F.col("n")).otherwise(F.col("shared")))
    known = known.join(first.withColumnRenamed("node", "name"), "name", "left").withColumn("label", F.coalesce("label", "name"))
    known = saved(known, "known")
    open_lists = known.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("shingle")
    # Blocks by size: a block spans a factor of 1.25, so what can link stands in the same block or the next.
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    rows = saved(known.join(open_lists, "shingle", "left_semi").withColumn("block", block), "open")
    left = rows.select("shingle", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), *[F.col(c).alias(c + "_a") for c in ("name", "n", "place", "shared", "label")])
    right = rows.select("shingle", "block", *[F.col(c).alias(c + "_b") for c in ("name", "n", "place", "shared", "label")])
    # In the first list in which two sets meet, they share nothing before their places. A
    # later list may let a pair go; the first one doesn't let go of sets that link.
    by_place = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    by_leader = F.coalesce(F.least(F.col("shared_b") + F.col("n_a") - F.col("shared_a"), F.col("shared_a") + F.col("n_b") - F.col("shared_b")), by_place)
    enough = (100 + PERCENT) * F.least(by_place, by_leader) >= PERCENT * (F.col("n_a") + F.col("n_b"))
    across = left.join(right, ["shingle", "block"]).filter((F.col("name_a") < F.col("name_b")) & (F.col("label_a") != F.col("label_b")) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & enough)
    across = across.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()
    tried = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = across.join(tried, ["a", "b"], "left_anti")
    across = saved(across, "across")
    if across.isEmpty():
        return first
    with arrow_rows(spark, PAIR_ROWS):
        more = saved(verified(across, texts).filter(is_link).select("a", "b"), "more")
    return components(more.unionByName(first.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and label of every row. Labels tell all components apart; ids don't where they are null or repeated."""
    docs = plain(docs, "doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    named = docs.mapInArrow(_names, "doc_id long, row_key long, name long, n long")
    # A document without shingles is a set of its own.
    named = saved(named.withColumn("name", F.when(F.col("n") > 0, F.col("name")).otherwise(F.xxhash64(F.lit("none"), "doc_id", "row_key"))), "names")
    labels = linked(docs)
    of_set = named.groupBy("name").agg(F.min("doc_id").alias("least")).join(labels.withColumnRenamed("node", "name"), "name", "left")
    of_set = saved(of_set.withColumn("label", F.coalesce("label", "name")), "sets")
    least = of_set.groupBy("label").agg(F.min("least").alias("component_id"))
    component = saved(of_set.select("name", "label").join(least, "label").select("name", "component_id", "label"), "least")
    return named.join(component, "name").select("doc_id", "row_key", F.col("n").alias("n_shingles"), "component_id", "label")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents of a group that aren't its first (by id, nulls last, then by text's hash); of equal rows one stays, whatever the ids and names of other columns are."""
    key = unused(docs, "row_key")
    member = saved(groups(docs).groupBy("label", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("copies")), "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    first = member.groupBy("label").agg(F.min(order).alias("f"))
    judged = saved(member.join(first, "label").select(F.col("doc_id").alias("m_id"), F.col("row_key").alias("m_key"), "copies", (F.col("row_key") == F.col("f.key")).alias("stays")), "judged")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))

    def among(rows: DataFrame, how: str, df: DataFrame) -> DataFrame:
        return df.join(rows, (df[key] == rows["m_key"]) & df["doc_id"].eqNullSafe(rows["m_id"]), how)

    kept = among(judged.filter("not stays"), "left_anti", keyed)
    copied = judged.filter("stays and copies > 1")
    if not copied.isEmpty():
        kept = among(copied, "left_anti", kept).unionByName(among(copied, "left_semi", kept).dropDuplicates(["doc_id", key]))
    return kept.select(*docs.columns)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
