"""Operator 3: personal data, secrets, and terms that would give them away.

Base spans follow four fixed patterns (``base_spans``). The method adds, by information
content:

* secrets: words of letters and digits that hold at least ``SECRET_BITS`` of
  information, ``BITS_A_CHARACTER`` for each character, under the pair counts of bytes
  of all documents (keys and tokens; prose stays far below);
* terms: over all different contexts of the corpus (lines, long ones in pieces), a
  term t and a protected entity e (one address, number, card or secret) have the
  point-wise mutual information log(N * n(t, e) / (n(t) * n(e))); e itself carries
  log(N / n(e)). A term that reveals at least ``GENERALISE`` of what the entity carries
  is replaced by a general word in the lines that hold the entity, one that reveals at
  least ``REMOVE`` is taken out, if the two meet more often than chance explains: over all
  pairs that are compared, or as many as there are contexts, ``CHANCE`` such findings are
  expected of unrelated words (Chernoff's bound on a Poisson count). So a word that was
  seen once says nothing about what stands beside it. All four counts are of different contexts, so that copies of a
  document prove nothing and hide nothing; an entity that was seen once is hidden itself,
  and the words around it stay.

Defined cases: null text counts as empty and has no spans; equal rows get equal
results; null ids stay; extra columns are ignored or stay as they are, whatever their
names; empty tables give an empty result. Spans of one kind don't overlap; spans of
different kinds may, and then the text is replaced over their union under the kind that
starts first, of equal starts the longer one. A term with equal shares for several
entities is one span. Very long texts are read whole, in time in proportion to them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import plain, saved, table, unused
from pagewright.llm.kernels import chunks, pieces, utf8

KINDS = ("email", "ip", "card", "phone")
SECRET_BITS, BITS_A_CHARACTER = 100, 4
GENERALISE = 0.75
REMOVE = 0.95
#: Pairs of unrelated words and entities that may be found together by chance, over the whole corpus.
CHANCE = 0.05
#: A line of more words than this is taken in pieces of so many, so that one endless line isn't one context.
CONTEXT_WORDS = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits and dots exclude each other, so possessive repeats match as greedy ones do, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_DENSE = re.compile(r"[A-Za-z0-9_+/=-]{20,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the @ signs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str, digits: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by kind and start. ``digits``: whether the text has any."""
    out = [("email", a, b) for a, b in emails(text)]
    if not digits:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 3 or (len(p.lstrip("0")) == 3 and p.lstrip("0") <= "255") for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        number = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(number) <= 19 and luhn(number):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte follows each other one in the texts of a task."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for _, part, at in chunks(data, offsets):
            for _, piece, bounds in pieces(part, at, 1):
                pair = (piece[:-1].astype(np.uint16) << 8) | piece[1:]
                total += np.bincount(pair, minlength=1 << 16)
                edges = bounds[1:-1]
                across = edges[(edges > 0) & (edges < len(piece))]
                total -= np.bincount(pair[np.unique(across) - 1], minlength=1 << 16)
    pair = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(total[pair])})


def information(docs: DataFrame) -> np.ndarray:
    """Bits that a byte carries after the byte before it, over all documents: 256 x 256."""
    rows = docs.mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 65536 rows
    n = np.zeros(1 << 16)
    for r in rows:
        n[r["pair"]] = r["n"]
    n = n.reshape(256, 256)
    return np.log2((n.sum(1, keepdims=True) + 256) / (n + 1)).astype(np.float32)


def secrets(text: str, bits: np.ndarray) -> list[tuple[str, int, int]]:
    out = []
    for m in _DENSE.finditer(text):
        b = np.frombuffer(m[0].encode(), np.uint8)
        digit = (b >= 48) & (b <= 57)
        if digit.any() and (((b | 32) >= 97) & ((b | 32) <= 122)).any() and (held := float(bits[b[:-1], b[1:]].sum())) >= SECRET_BITS and held >= BITS_A_CHARACTER * len(b):
            out.append(("secret", m.start(), m.end()))
    return out


def _suspects(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have a digit, and which an @ sign."""
    data, offsets = utf8(column)
    digit, sign = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for _, part, at in chunks(data, offsets):
        for out, hit in ((digit, (part >= 48) & (part <= 57)), (sign, part == 64)):
            before = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
            out.append(before[at[1:]] > before[at[:-1]])
    return np.concatenate(digit), np.concatenate(sign)


def entity(kind: str, value: str) -> int:
    """A signed 64-bit name of a protected value; case, blanks and punctuation of a value don't matter."""
    value = re.sub(r"[^0-9a-z.@]", "", value.lower())
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def contexts(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every line, long lines in pieces of ``CONTEXT_WORDS`` words."""
    for line in re.finditer(r"[^\n]+", text):
        start, count = line.start(), 0
        if line[0].count(" ") < CONTEXT_WORDS:
            yield line.span()
            continue
        for gap in re.finditer(r" +", line[0]):
            count += 1
            if count % CONTEXT_WORDS == 0:
                yield start, line.start() + gap.start()
                start = line.start() + gap.end()
        if start < line.end():
            yield start, line.end()


def _found(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, list[int], list[tuple[str, int, int]]]]:
    """Contexts that hold entities: start, end, entities, and the spans that reach into it."""
    spans = sorted(spans, key=lambda s: s[1])
    low, first = 0, 0
    for a, b in contexts(text):
        while low < len(spans) and spans[low][2] <= a:
            low += 1
        while first < len(spans) and spans[first][1] < a:
            first += 1
        last = first
        while last < len(spans) and spans[last][1] < b:
            last += 1
        if first < last:
            here = {entity(k, text[s:e]) for k, s, e in spans[first:last]}
            yield a, b, sorted(here), [s for s in spans[low:last] if s[2] > a]


def _terms(text: str, a: int, b: int, near: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Words of a context outside the spans ``near``, which come by their start."""
    starts, ends = [], []
    for _, s, e in near:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in _WORD.finditer(text, a, b):
        i = bisect_left(starts, m.end()) - 1
        if i < 0 or ends[i] <= m.start():
            yield m[0].lower(), m.start(), m.end()


def _name(text: str, a: int, b: int) -> int:
    """A signed 64-bit name of a context's text."""
    return int.from_bytes(hashlib.blake2b(text[a:b].encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every context and its different words, blanks between them; one that comes again in a batch once."""
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            out: dict[int, str] = {}
            for text in batch.column("text").slice(first, 1024).to_pylist():
                for a, b in contexts(text or ""):
                    if (name := _name(text, a, b)) not in out:
                        out[name] = " ".join({m.lower() for m in _WORD.findall(text, a, b)})
            yield pa.RecordBatch.from_pydict({"context": pa.array(list(out), pa.int64()), "words": pa.array(list(out.values()), pa.string())})


def _pairs(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digit, sign = _suspects(batch.column("text"))
        texts, ids, keys = batch.column("text"), batch.column("doc_id"), batch.column("row_key")
        out: dict[str, list] = {"doc_id": [], "row_key": [], "entity": [], "context": [], "terms": []}
        for i in np.flatnonzero(digit | sign):
            text = texts[i].as_py()
            spans = base_spans(text, bool(digit[i])) + secrets(text, bits)
            for a, b, entities, near in _found(text, spans) if spans else ():
                terms = sorted({t for t, _, _ in _terms(text, a, b, near)})
                line = _name(text, a, b)
                for e in entities:
                    for k, v in zip(out, (ids[i].as_py(), keys[i].as_py(), e, line, terms)):
                        out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("entity", pa.int64()), ("context", pa.int64()), ("terms", pa.list_(pa.string()))]))


def disclosing(seen: DataFrame, docs: DataFrame) -> DataFrame:
    """entity, term, share: the terms that reveal at least ``GENERALISE`` of an entity, beyond chance."""
    lines = seen.select("entity", "context", "terms").dropDuplicates(["entity", "context"])
    n_e = lines.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    n_te = lines.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    pairs = saved(n_te.join(n_e, "entity"), "pairs")
    # The empty term stands for every context: its count is N.
    wanted = pairs.select("term").distinct().union(pairs.sparkSession.range(1).select(F.lit("").alias("term")))
    every = docs.select("text").mapInArrow(_contexts, "context long, words string").dropDuplicates(["context"])
    terms = every.select(F.explode(F.array_distinct(F.split(F.concat(F.lit(" "), "words"), " "))).alias("term"))
    # Counted before the join: that would deal a common term's rows to one task.
    n_t = saved(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(wanted, "term", "left_semi"), "terms")
    total = n_t.filter(F.col("term") == "").first()
    n = F.lit(float(total["n_t"]) if total else 0.0)
    share = (F.log(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log(n / F.col("n_e"))).alias("share")
    told = pairs.join(n_t, "term").filter(n > F.col("n_e"))  # what stands in every context tells nothing
    expected = F.col("n_t") * F.col("n_e") / n
    evidence = F.col("n_te") * F.log(F.col("n_te") / expected) - F.col("n_te") + expected
    told = told.filter((F.col("n_te") > expected) & (evidence >= F.log(F.greatest(F.lit(float(pairs.count())), n) / CHANCE)))
    return told.select("entity", "term", share).filter(F.col("share") >= GENERALISE)


def sanitised(text: str, spans: list[tuple[str, int, int]], removed: set[tuple[int, int]]) -> str:
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= done:
            continue
        if a >= done:
            out.append(text[done:a])
            out.append("" if (a, b) in removed else f"[{kind.upper()}]")
        done = b
    out.append(text[done:])
    return "".join(out)


def _mark(batches: Iterator[pa.RecordBatch], bits: np.ndarray, risky_name: str = "risky") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digit, sign = _suspects(batch.column("text"))
        texts, risky = batch.column("text"), batch.column(risky_name)
        listed: list[str] = []
        clean: list[str | None] = []
        counts = np.zeros((batch.num_rows, 5), np.int64)
        bases: list[str] = []
        for i in range(batch.num_rows):
            if not (digit[i] or sign[i]):
                listed.append("")
                bases.append("")
                clean.append(None)
                continue
            text = texts[i].as_py()
            base = base_spans(text, bool(digit[i]))
            for kind, _, _ in base:
                counts[i, KINDS.index(kind)] += 1
            spans, removed = base + secrets(text, bits), set()
            if spans and (marked := risky[i].as_py()):
                shares = {(m["entity"], m["term"]): m["share"] for m in marked}
                found = []
                for a, b, entities, near in _found(text, spans):
                    for term, s, e in _terms(text, a, b, near):
                        if (share := max((shares.get((x, term), 0.0) for x in entities), default=0.0)) >= GENERALISE:
                            found.append(("term", s, e))
                            if share >= REMOVE:
                                removed.add((s, e))
                spans += found
            name = lambda ss: ",".join(f"{k}:{a}:{b}" for k, a, b in ss)
            bases.append(name(base))
            listed.append(name(spans))
            counts[i, 4] = len(spans)
            clean.append(sanitised(text, spans, removed) if spans else None)
        extra = {"n_" + k: pa.array(counts[:, j]) for j, k in enumerate((*KINDS, "spans"))}
        yield pa.RecordBatch.from_pydict({**extra, "base": pa.array(bases, pa.string()), "spans": pa.array(listed, pa.string()), "clean": pa.array(clean, pa.string())})


def _marked_rows(docs: DataFrame) -> tuple[DataFrame, str, np.ndarray]:
    """``docs`` with the terms to mark in a new column, its name, and the bits of byte pairs."""
    key, risky = unused(docs, "row_key"), unused(docs, "risky")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    few = plain(docs, "doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    bits = information(few)
    seen = saved(few.mapInArrow(lambda b: _pairs(b, bits), "doc_id long, row_key long, entity long, context long, terms array<string>"), "entities")
    # Each document's own terms only: an entity's terms never meet its other documents.
    own = seen.select("doc_id", "row_key", "entity", F.explode("terms").alias("term")).distinct()
    held = own.join(disclosing(seen, few), ["entity", "term"])
    held = saved(held.groupBy(F.col("doc_id").alias("h_id"), F.col("row_key").alias("h_key")).agg(F.collect_list(F.struct("entity", "term", "share")).alias("h_terms")), "risky")
    same = (keyed[key] == held["h_key"]) & keyed["doc_id"].eqNullSafe(held["h_id"])
    return keyed.join(held, same, "left").select(*[keyed[c] for c in docs.columns], held["h_terms"].alias(risky)), risky, bits


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds and of all spans, base and all spans as text, and the sanitised text (null where nothing was found)."""
    rows, risky, bits = _marked_rows(plain(docs, "doc_id", "text"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in _mark(iter([batch]), bits, risky):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.columns], ["doc_id", *out.schema.names])

    return rows.mapInArrow(marked, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base string, spans string, clean string")


def _rewrite(batches: Iterator[pa.RecordBatch], bits: np.ndarray, risky: str) -> Iterator[pa.RecordBatch]:
    """The columns as they came, the text sanitised."""
    for batch in batches:
        clean = next(_mark(iter([batch]), bits, risky)).column("clean")
        columns = {n: batch.column(n) for n in batch.schema.names if n != risky}
        text = columns["text"]
        columns["text"] = pa.array([c if c is not None else t for c, t in zip(clean.to_pylist(), text.to_pylist())], text.type)
        if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in columns["text"].to_pylist()], columns["n_chars"].type)
        yield pa.RecordBatch.from_pydict(columns)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, its texts without personal data, secrets and terms that disclose them."""
    rows, risky, bits = _marked_rows(docs)
    return rows.mapInArrow(lambda b: _rewrite(b, bits, risky), docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans")
