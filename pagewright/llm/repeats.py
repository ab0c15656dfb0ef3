"""Operator 1: removal of byte passages that occur more than once, by a depth-limited radix sort of suffixes.

A suffix is ordered only through its first ``window`` bytes (200 by default), so
that the groups of equal suffixes that the last pass leaves are exactly the
repeated windows. The passes go from the most significant digit on, and every
pass drops the suffixes that have become unique:

1. The first digit of a suffix is a block of ``DIGIT`` bytes picked from its
   first ``window`` bytes by content alone (the block of least hash, the last of
   equals). Equal windows pick the same block at the same distance, and
   neighbouring suffixes mostly pick the same block, so one row stands for a
   whole run of suffixes. Runs whose digit is unique drop out here.
2. The next digit is the run's whole surroundings. If all runs of a group agree
   in it, all their windows repeat and no more order is needed.
3. What is left, one run for each distinct surrounding, is ordered suffix by
   suffix through the digits 0-63, 64-127, 128-191, 192-199 of the window.

Groups are counted with map-side partial aggregates, so a passage that a third of
all documents shares reaches its reducer as one row a task. Groups of more than
``WIDE`` distinct surroundings are ordered by Spark's own shuffle on the digits.

Defined cases: null text counts as empty and has nothing removed; texts shorter
than the window have nothing removed; equal rows each count, so two equal rows
with texts of at least the window are removed whole; null ids are kept as they
are; extra columns are ignored; an empty table gives an empty result. Ties of block
hashes go to the last block. Very long texts are read in pieces that overlap by a window;
a run that a piece ends is two runs of one group, which step 3 puts in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import plain, saved, table
from pagewright.llm.kernels import U64, Rolling, chunks, mix, pieces, segments_of, utf8

WINDOW = 200
DIGIT = 64
#: Distinct surroundings of one first digit that a task orders by itself; larger groups go through a shuffle.
WIDE = 4096
_A, _B, _C = Rolling(1), Rolling(2), Rolling(3)
_ODD, _ODD2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def runs(data: np.ndarray, offsets: np.ndarray, window: int, digit: int):
    """Runs of suffixes that pick the same block: document, first and last suffix, digit, surroundings."""
    if len(data) < window:
        return None
    sums = _A.sums(data)
    picked = _A.fixed(sums, digit)
    m = len(picked)
    low = U64((1 << 32) - 1)
    best = (picked & ~low) | (U64(m - 1) - np.arange(m, dtype=U64))  # least hash, then the last place
    span, have = window - digit + 1, 1
    while have < span:
        step = min(have, span - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    block = m - 1 - (best & low).astype(np.int64)
    n = len(block)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + window <= offsets[doc + 1]
    change = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = change | ~inside[:-1]
    last[:-1] = change | ~inside[1:]
    lo, hi = np.flatnonzero(first & inside), np.flatnonzero(last & inside)
    at = block[lo]
    around = _B.ranges(_B.sums(data), lo, hi + window)
    around = mix(around + (at - lo).astype(U64) * _ODD + (hi - lo).astype(U64) * _ODD2)
    return doc[lo], lo - offsets[doc[lo]], hi - offsets[doc[lo]], mix(picked[at]), around


def _runs_of(batches: Iterator[pa.RecordBatch], window: int, digit: int, located: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids, keys = batch.column("doc_id"), batch.column("row_key")
        cut = ((start, a, *piece) for start, part, at in chunks(data, offsets) for a, *piece in pieces(part, at, window - 1))
        for start, a, part, at in cut:
            got = runs(part, at, window, digit)
            if got is None or not len(got[0]):
                continue
            doc, lo, hi, first, around = got
            lo, hi = lo + a, hi + a
            columns = {"digit": first.view(np.int64), "around": around.view(np.int64)}
            if located:
                rows = pa.array(start + doc)
                columns |= {"doc_id": ids.take(rows), "row_key": keys.take(rows), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)}
            yield pa.RecordBatch.from_pydict(columns)


def ordered(digits_of: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int, digit: int):
    """Radix passes over the suffixes of byte strings: which of them have an equal in the same group.

    ``digits_of`` gives each string's group. Returns string and place of every
    suffix that some other suffix of its group equals through ``window`` bytes.
    """
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    owner, place = np.repeat(np.arange(len(count)), count), segments_of(offsets[:-1], count)
    group = digits_of[owner].astype(np.int64)
    sums = _C.sums(data)
    done = 0
    while done < window and len(place):
        width = min(digit, window - done)
        value = mix(_C.ranges(sums, place + done, place + done + width))
        order = np.lexsort((value, group))
        value, group, owner, place = value[order], group[order], owner[order], place[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        name = np.cumsum(fresh) - 1
        alive = np.bincount(name)[name] > 1
        group, owner, place = name[alive], owner[alive], place[alive]
        done += width
    return owner, place - offsets[owner]


def _joined(owner: np.ndarray, place: np.ndarray):
    """Neighbouring places of an owner as ranges."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(order))[: len(first)] - 1
    return owner[first], place[first], place[last]


def _ordered_groups(batches: Iterator[pa.RecordBatch], window: int, digit: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by digit and surroundings; a group that a batch cuts waits for the next batch."""
    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        d, a = t["digit"].to_numpy(), t["around"].to_numpy()
        fresh = np.ones(len(d), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1])  # copies of one row are no second occurrence
        t = t.filter(pa.array(fresh))
        d, a = d[fresh], a[fresh]
        data, offsets = utf8(t["bytes"])
        group = np.cumsum(np.append(True, d[1:] != d[:-1]))
        for start, part, at in chunks(data, offsets, 1 << 22) if len(d) <= 1 else _whole_groups(data, offsets, group):
            owner, lo, hi = _joined(*ordered(group[start : start + len(at) - 1], part, at, window, digit))
            if len(owner):
                yield pa.RecordBatch.from_pydict({"digit": d[start + owner], "around": a[start + owner], "lo_in": lo.astype(np.int32), "hi_in": hi.astype(np.int32)})

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        d = batch.column("digit").to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(d != d[-1])[-1]) + 1 if d[0] != d[-1] else 0
        if waiting and waiting[-1].column("digit")[-1].as_py() != d[0]:
            yield from settle(pa.Table.from_batches(waiting))
            waiting = []
        if cut:
            yield from settle(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield from settle(pa.Table.from_batches(waiting))


def _whole_groups(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, most: int = 1 << 20):
    """Pieces of about ``most`` bytes that don't part a group."""
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(offsets[edges], offsets[edges[first]] + most, "right")) - 1)
        i, j = edges[first], edges[last]
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        first = last


def _suffix_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    half = window // 2
    for batch in batches:
        data, offsets = utf8(batch.column("bytes"))
        d, a = batch.column("digit"), batch.column("around")
        for start, part, at in chunks(data, offsets):
            count = np.maximum(np.diff(at) - window + 1, 0)
            owner, place = np.repeat(np.arange(len(count)), count), segments_of(at[:-1], count)
            sums = _C.sums(part)
            rows = pa.array(start + owner)
            yield pa.RecordBatch.from_pydict({"digit": d.take(rows), "around": a.take(rows), "place": (place - at[owner]).astype(np.int32), "head": mix(_C.ranges(sums, place, place + half)).view(np.int64), "tail": mix(_C.ranges(sums, place + half, place + window)).view(np.int64)})


def _runs_of_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("places")
        flat, size = lists.flatten().to_numpy(), np.diff(np.asarray(lists.offsets))
        owner, lo, hi = _joined(np.repeat(np.arange(len(size)), size), flat)
        rows = pa.array(owner)
        yield pa.RecordBatch.from_pydict({"digit": batch.column("digit").take(rows), "around": batch.column("around").take(rows), "lo_in": lo.astype(np.int32), "hi_in": hi.astype(np.int32)})


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and a key of both, by which spans find their row again."""
    docs = plain(docs, "doc_id", "text")
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, digit: int = DIGIT) -> DataFrame:
    """(doc_id, row_key, spans): for rows with repeats, ranges of bytes that windows with an equal elsewhere cover.

    ``docs`` is what ``keyed`` returns. The ranges are not yet merged.
    """
    first = docs.mapInArrow(lambda b: _runs_of(b, window, digit, False), "digit long, around long")
    groups = first.groupBy("digit").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("least"), F.max("around").alias("most"))
    groups = saved(groups.filter("n > 1").select("digit", (F.col("least") != F.col("most")).alias("mixed")), "digits")
    located = docs.mapInArrow(lambda b: _runs_of(b, window, digit, True), "digit long, around long, doc_id long, row_key long, lo int, hi int")
    repeated = saved(located.join(groups, "digit"), "runs")

    mixed = repeated.filter("mixed")
    kinds = mixed.groupBy("digit", "around").agg(F.min(F.struct("doc_id", "row_key", "lo", "hi")).alias("r"), F.count(F.lit(1)).alias("n")).select("digit", "around", "n", "r.*")
    kinds = saved(kinds, "kinds")
    wide = kinds.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WIDE).select("digit")
    # The bytes around each kind of run come from one document that has it.
    same = (docs["row_key"] == kinds["row_key"]) & docs["doc_id"].eqNullSafe(kinds["doc_id"])
    content = docs.join(kinds, same).select("digit", "around", F.substring(F.col("text").cast("binary"), F.col("lo") + 1, F.col("hi") - F.col("lo") + window).alias("bytes"))
    content = saved(content, "content")
    narrow = content.join(wide, "digit", "left_anti").repartition("digit").sortWithinPartitions("digit", "around")
    out = "digit long, around long, lo_in int, hi_in int"
    found = narrow.mapInArrow(lambda b: _ordered_groups(b, window, digit), out)
    suffixes = saved(content.join(wide, "digit", "left_semi").dropDuplicates(["digit", "around"]).mapInArrow(lambda b: _suffix_rows(b, window), "digit long, around long, place int, head long, tail long"), "suffixes")
    equal = saved(suffixes.groupBy("digit", "head", "tail").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "equal")
    places = suffixes.join(equal, ["digit", "head", "tail"]).groupBy("digit", "around").agg(F.collect_list("place").alias("places"))
    # A kind of run that occurs twice repeats as a whole, whatever the others of its group are.
    twice = kinds.filter("n > 1").select("digit", "around", F.lit(0).alias("lo_in"), (F.col("hi") - F.col("lo")).alias("hi_in"))
    found = saved(found.unionByName(places.mapInArrow(_runs_of_places, out)).unionByName(twice), "found")

    whole = repeated.filter("not mixed").select("doc_id", "row_key", "lo", (F.col("hi") + window).alias("end"))
    part = mixed.join(found, ["digit", "around"]).select("doc_id", "row_key", (F.col("lo") + F.col("lo_in")).alias("lo"), (F.col("lo") + F.col("hi_in") + window).alias("end"))
    return whole.unionByName(part).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("lo", "end")).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Ranges (n x 2) in order, those that touch or overlap made one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(fresh)
    return np.stack((spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]), 1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        lists = batch.column("spans")
        pairs, bounds = lists.flatten(), np.asarray(lists.offsets)
        lo, end = pairs.field("lo").to_numpy(zero_copy_only=False), pairs.field("end").to_numpy(zero_copy_only=False)
        bounds = bounds - bounds[0]
        kept, n_removed, n_spans = [], [], []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            if bounds[i] == bounds[i + 1]:
                kept.append(text.tobytes())
                n_removed.append(0)
                n_spans.append(0)
                continue
            cuts = merged(np.stack((lo[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]]), 1).astype(np.int64))
            edges = [0, *cuts.ravel().tolist(), len(text)]
            kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
            n_removed.append(int((cuts[:, 1] - cuts[:, 0]).sum()))
            n_spans.append(len(cuts))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": np.diff(offsets).astype(np.int64), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, digit: int = DIGIT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the bytes kept."""
    docs = keyed(docs)
    spans = repeated_spans(docs, window, digit)
    same = (docs["row_key"] == spans["row_key"]) & docs["doc_id"].eqNullSafe(spans["doc_id"])
    none = F.array().cast("array<struct<lo:int,end:int>>")
    joined = docs.join(spans, same, "left").select(docs["doc_id"], "text", F.coalesce("spans", none).alias("spans"))
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
