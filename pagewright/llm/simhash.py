"""Operator 12: near copies by SimHash fingerprints, found by multi-index hashing.

A text's fingerprint has a bit set where over half of its 3-word shingles, repeats
included, have it set in their XXH64 (seed 42). Fingerprints link at ``RADIUS`` or
fewer differing bits.

Multi-index hashing: a fingerprint is two segments of 32 bits. Of two fingerprints
within three bits, one segment differs in one bit at most, so each fingerprint looks
in the tables of both segments for the ball of one bit around its own value; full
distances are verified. Of two values that differ in one bit one has it unset, so only
unset bits are flipped: some 17 probes a segment instead of 33.

A bucket (a segment's value) may hold many fingerprints of one group of near copies.
So no bucket is paired with itself: first each probe meets the least fingerprint of its
bucket alone. What that links is put together to components, and only what a bucket
still has of different components is compared: its fingerprints outside the bucket's
main component with all that probe it, those inside with the probes of other components.
Components stay exact, as every pair within the radius is either compared or inside one
component already.

All joins are sort-merge joins: every table here grows with the corpus, and one whose file
is just below the size that Spark broadcasts takes many times that in the driver.

Equal texts, and different ones with equal fingerprints, are one fingerprint from the
first step on.

Defined cases: null, empty and wordless texts have the fingerprint zero and link like any
other; fewer than three words are one shingle of them all; equal rows link with each
other; a null id never names a component that has another id; extra columns are
ignored; an empty table gives an empty result. A text of any length is read whole: its
shingles are hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import plain, saved, table
from pagewright.llm.components import components
from pagewright.llm.kernels import U64, chunks, utf8
from pagewright.llm.words import joined_words

RADIUS = 3
WIDTH = 3
SEED = 42
#: Bits of a segment.
HALF = 32
#: Shingles hashed together.
SLICE = 1 << 16


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each document; their bytes lie one after the other."""
    text, start, end, bounds = joined_words(data, offsets)
    n = len(bounds) - 1
    count = np.diff(bounds)
    doc = np.repeat(np.arange(n), count)
    first = np.flatnonzero(doc[: len(doc) - WIDTH + 1] == doc[WIDTH - 1 :])  # shingles, by their first word
    last = first + WIDTH - 1
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(few):
        first, last = np.concatenate((first, bounds[few])), np.concatenate((last, bounds[few + 1] - 1))
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
    votes, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(first), SLICE):
        a, b = first[k : k + SLICE], last[k : k + SLICE]
        h = np.fromiter((digest(text[i:j], SEED) for i, j in zip(start[a].tolist(), end[b].tolist())), U64, len(a))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        of = doc[a]
        edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        votes[of[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
        total[of[edges]] += np.diff(np.append(edges, len(a)))
    return np.packbits(2 * votes > total[:, None], axis=1).view(">u8").astype(U64).ravel()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        first = 0
        for _, part, at in chunks(data, offsets):
            found = fingerprints(part, at)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(found)), "fp": pa.array(found.view(np.int64))})
            first += len(found)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the 64 bits as a long."""
    return plain(docs, "doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _entries(nodes: DataFrame, *more: str) -> DataFrame:
    """The tables of both segments: segment, half (its value), fp."""
    halves = F.array(*[F.struct(F.lit(k).alias("segment"), v.alias("half")) for k, v in enumerate((F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND((1 << HALF) - 1)))])
    return nodes.select("fp", *more, F.inline(halves))


def _probes(nodes: DataFrame) -> DataFrame:
    """Where each fingerprint looks: its own value of a segment, and that with one more bit set."""
    balls = _entries(nodes).withColumn("flip", F.explode(F.lit([0, *(1 << i for i in range(HALF))]).cast("array<bigint>")))
    return balls.filter(F.col("half").bitwiseAND(F.col("flip")) == 0).select("fp", "segment", F.col("half").bitwiseOR(F.col("flip")).alias("half"))


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def labelled(nodes: DataFrame) -> DataFrame:
    """(fp, label): every different fingerprint (column ``fp``) with the least one of its component, in the order of signed numbers."""
    nodes = nodes.select("fp")
    leaders = _entries(nodes).groupBy("segment", "half").agg(F.min("fp").alias("leader"), F.count(F.lit(1)).alias("n"))
    # What finds a bucket; a fingerprint alone in its bucket finds nothing new there.
    met = saved(_probes(nodes).join(leaders.hint("merge"), ["segment", "half"]).filter((F.col("n") > 1) | (F.col("fp") != F.col("leader"))), "met")
    first = saved(components(met.filter((F.col("fp") != F.col("leader")) & _near("fp", "leader")).select(F.col("fp").alias("a"), F.col("leader").alias("b"))), "components")
    label = saved(nodes.join(first.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "labels")

    # Buckets of several, by component: the main one holds most of the bucket, of equal ones the least.
    several = met.filter("n > 1")
    held = _entries(label, "label").join(several.select("segment", "half").distinct().hint("merge"), ["segment", "half"], "left_semi")
    held = saved(held, "held")
    sizes = held.groupBy("segment", "half", "label").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("segment", "half").agg(F.max(F.struct("k", (-F.col("label")).alias("less"), "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"))
    main = saved(main, "main")
    probes = several.select("fp", "segment", "half").join(main.hint("merge"), ["segment", "half"]).join(label.hint("merge"), "fp").filter((F.col("labels") > 1) | (F.col("label") != F.col("main")))
    probes = saved(probes.select("segment", "half", F.col("fp").alias("a"), F.col("label").alias("label_a"), "main"), "open")
    mixed = held.join(main.hint("merge"), ["segment", "half"]).select("segment", "half", F.col("fp").alias("b"), F.col("label").alias("label_b"), (F.col("label") == F.col("main")).alias("inner"))
    apart = (F.col("label_a") != F.col("label_b")) & _near("a", "b")
    outer = probes.join(mixed.filter("not inner").hint("merge"), ["segment", "half"]).filter(apart)
    inner = probes.filter("label_a <> main").join(mixed.filter("inner").hint("merge"), ["segment", "half"]).filter(apart)
    late = saved(outer.unionByName(inner).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "late")
    if late.isEmpty():
        return label
    joined = components(late).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    return label.join(joined.hint("merge"), "label", "left").select("fp", F.coalesce("whole", "label").alias("label"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id of the component, of every row."""
    rows = saved(fingerprinted(docs), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    of_node = saved(labelled(nodes).join(nodes.hint("merge"), "fp"), "members")
    least = of_node.groupBy("label").agg(F.min("least").alias("component_id"))
    named = saved(of_node.select("fp", "label").join(least.hint("merge"), "label").select("fp", "component_id"), "named")
    return rows.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
