"""Operator 3: base spans against the plain patterns, disclosing terms against plain counts."""

import math
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()  # noqa: B023
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def luhn(digits):
    double = {0: 0, 1: 2, 2: 4, 3: 6, 4: 8, 5: 1, 6: 3, 7: 5, 8: 7, 9: 9}
    return sum(double[int(c)] if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


TEXTS = ["", "a@b.c", "a@b", "x a@b@c.d.e.", "a.b%c+d@e-f.g.h..i @x.y", "é@b.c", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0.0.0.0 00255.1.1.001", "1234.5", "4111 1111 1111 1111", "4111-1111 1111-1111 x 4111111111111112", "4111  1111 1111 1111", "+1 (988) 555-2485", "+1 23", "+49 30 1234567 8901234567", "++1234567890+", "+1.2.3.4.5.6.7.8"]
KEY = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"


def test_base_spans():
    for text in TEXTS:
        assert pii.base_spans(text) == plain(text), text


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("aZ09.@+- ()é%125")), max_size=40))
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for unit in ("1", "a", "1.", "@", "+1(", "a@"):
        pii.base_spans(unit * 100_000)


def test_whole_table(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = 0
    for r in pii.find(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        spans = plain(rows[r.doc_id] or "")
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.spans.startswith(r.base)
        count = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in PLAIN)
        found += len(spans)
    assert found


def test_disclosing_terms(spark):
    """A word that stands in an address's lines only is taken out there; one that stands everywhere stays."""
    rows = [(i, f"Falconridge met staff at {p} with a@x.example here number{i}\nthe rest of it {i}") for i, p in enumerate(["noon", "dusk", "dawn", "night"])]
    rows += [(100 + i, f"met staff here with the rest line {i}\nand more staff met {i}") for i in range(400)]
    rows += [(60, "Falconridge alone"), (61, None), (62, ""), (None, "a@x.example"), (0, rows[0][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, entity int").repartition(3)
    # Plain counts.
    lines = [x for _, t in rows if t for x in t.split("\n")]
    terms = lambda x: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", re.sub(PLAIN["email"], "#", x))}
    n, n_t, held = len({x for x in lines if x}), Counter(), set()
    for x in set(lines):
        n_t.update({w.lower() for w in re.findall(r"[^\W\d_]{3,}", x)})
        if "@" in x:
            held.add(x)
    n_te = Counter(w for x in held for w in terms(x))
    by_chance = {w: n_t[w] * len(held) / n for w in n_te}
    sure = lambda w, k: k > by_chance[w] and k * math.log(k / by_chance[w]) - k + by_chance[w] >= math.log(max(len(n_te), n) / pii.CHANCE)
    expect = {w for w, k in n_te.items() if sure(w, k) and math.log(n * k / (n_t[w] * len(held))) / math.log(n / len(held)) >= pii.GENERALISE}
    got = defaultdict(set)
    texts = dict(rows)
    for r in pii.find(df).collect():
        for s in filter(None, r.spans.split(",")):
            kind, a, b = s.split(":")
            if kind == "term":
                got[r.doc_id].add(texts[r.doc_id][int(a) : int(b)].lower())
    assert expect == {"falconridge", "number"}  # noon, dusk and dawn were seen once
    for i in range(4):
        assert got[i] == {w for w in expect if w in terms(rows[i][1].split("\n")[0])}
    assert set(got) == {0, 1, 2, 3}
    clean = {(r.doc_id, r.text) for r in pii.sanitise(df).collect()}
    assert (60, "Falconridge alone") in clean and (61, None) in clean and (62, "") in clean and (None, "[EMAIL]") in clean
    assert not any("a@x" in (t or "") for _, t in clean)
    assert pii.sanitise(df).columns == df.columns
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shares(spark, texts):
    """(term -> share) of the one entity in the texts."""
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row_key long").repartition(3)
    bits = pii.information(docs)
    seen = docs.mapInArrow(lambda b: pii._pairs(b, bits), "doc_id long, row_key long, entity long, context long, terms array<string>")
    return {r.term: r.share for r in pii.disclosing(seen, docs).collect()}


def test_copies_hide_no_term(spark):
    held = "\n".join(f"falconridge at {p} a@x.example" for p in ("noon", "dusk", "dawn"))
    other = [f"something else {i} of it\nand more {i} of it" for i in range(60)]
    once, copied = shares(spark, [held, *other]), shares(spark, [held] * 200 + other)
    assert once == copied and once["falconridge"] == 1.0


def test_pieces_of_a_long_line_count_alike(spark):
    pieces = [" ".join(["falconridge", "a@x.example" if i < 3 else "b", f"x{i}", *(f"w{k}" for k in range(61))]) for i in range(43)]
    found = shares(spark, [" ".join(pieces)] + [f"nothing of it {i}" for i in range(20)])
    assert "falconridge" not in found and all(v <= 1 for v in found.values())


def test_planted_terms_go_and_harmless_words_stay(spark):
    """Code names that stand beside one address each, four times over, and everything else around addresses in sf0.01."""
    import random

    rng = random.Random(12)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    names = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(60)]
    planted = [(10**6 + 10 * i + j, f"{rng.choice(docs[j * 7][1].split())} {name} wrote to box{i}@mail{i}.example about item {i} of list {j}") for i, name in enumerate(names) for j in range(4)]
    df = spark.createDataFrame(docs + planted, "doc_id long, text string").repartition(4)
    texts, hit, around, marked = dict(docs + planted), 0, 0, 0
    for r in pii.find(df).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in filter(None, r.spans.split(",")))]
        terms = {(a, b) for k, a, b in spans if k == "term"}
        if r.doc_id >= 10**6:
            hit += any(texts[r.doc_id][a:b] == names[(r.doc_id - 10**6) // 10] for a, b in terms)
            continue
        held = [(a, b) for k, a, b in spans if k != "term"]
        for m in re.finditer(r"[^\n]+", texts[r.doc_id] or ""):
            inside = [(a, b) for a, b in held if m.start() <= a < m.end()]
            if inside:
                words = [w for w in re.finditer(r"[^\W\d_]{3,}", m[0]) if not any(a < m.start() + w.end() and m.start() + w.start() < b for a, b in inside)]
                around += len(words)
                marked += sum((m.start() + w.start(), m.start() + w.end()) in terms for w in words)
    print(f"{hit} of {len(planted)} planted terms, {marked} of {around} harmless words")
    assert hit >= 0.9 * len(planted) and around > 1000 and marked <= 0.05 * around


def test_an_entity_in_every_context(spark):
    assert shares(spark, [f"met here at a@x.example {i}" for i in range(5)]) == {}


def test_pair_counts(spark, monkeypatch):
    """Against a plain count inside each text, pieces of long texts included."""
    from pagewright.llm import kernels

    texts = ["abab", "", None, "b", "ba" * 5000, "é-"]
    count = Counter((x, y) for t in texts for b in [(t or "").encode()] for x, y in zip(b, b[1:]))
    monkeypatch.setattr(kernels, "CHUNK_BYTES", 64)
    got = Counter()
    import pyarrow as pa

    for batch in pii._pair_counts(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})])):
        got.update({(k >> 8, k & 255): n for k, n in zip(*(batch.column(c).to_pylist() for c in ("pair", "n")))})
    assert got == count


def test_secrets(spark, sf):
    """Every planted key is found, whatever the word before it; no word of prose is."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    keys = {d: set(re.findall(r"[0-9a-f]{40}", t)) for d, t in rows.items()}
    hit = total = 0
    for r in pii.find(docs).collect():
        spans = [s.split(":") for s in filter(None, r.spans.split(","))]
        found = {rows[r.doc_id][int(a) : int(b)] for k, a, b in spans if k == "secret"}
        assert all(re.search("[0-9]", x) for x in found)
        hit, total = hit + len(found & keys[r.doc_id]), total + len(keys[r.doc_id])
        assert r.n_spans == len(spans) and (r.n_spans > 0) == bool(plain(rows[r.doc_id]) or found)
    assert total and hit / total >= 0.9


def test_sanitised_secrets_and_clashing_names(spark):
    rows = [(i, f"plain words of line {i} and more words here") for i in range(200)] + [(900, f"zebrafinch token = {KEY} words"), (901, "see /plain-words-and-more-words-of-line-2024 here")]
    df = spark.createDataFrame([(a, b, 1, [2], "x", len(b)) for a, b in rows], "doc_id long, text string, row_key int, risky array<int>, h_key string, n_chars long")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert pii.sanitise(df).columns == df.columns and len(got) == len(rows)
    # The key goes; a word that was seen once, beside it, tells nothing about it.
    assert KEY not in got[900].text and "zebrafinch" in got[900].text and got[900].n_chars == len(got[900].text)
    assert got[901].text == dict(rows)[901] and got[5].text == dict(rows)[5] and got[5].risky == [2]


def test_many_lines_are_linear():
    import time

    bits = pii.np.full((256, 256), 3.0, "f4")

    def seconds(n):
        import pyarrow as pa

        text = "\n".join(f"word {i} met us at a{i}@x.example today" for i in range(n))
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "row_key": pa.array([1]), "text": pa.array([text]), "risky": pa.array([None], pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("share", pa.float64())])))})
        start = time.perf_counter()
        list(pii._pairs(iter([batch]), bits)), list(pii._mark(iter([batch]), bits))
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.02)
