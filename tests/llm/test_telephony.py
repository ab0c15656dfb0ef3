"""Operator 8: round trips, the expansions against their formulas, ADPCM against a sample-by-sample decoder."""

import hashlib
import zlib

import numpy as np
import pytest

from pagewright.llm import telephony as t


def test_mulaw_and_alaw():
    for i in range(256):
        u = ~i & 255
        size = (((u & 15) * 2 + 33) << ((u >> 4) & 7)) - 33
        assert t.MULAW[i] == 4 * (-size if u & 128 else size)
        a = i ^ 0x55
        e, m = (a >> 4) & 7, a & 15
        size = 2 * m + 1 if e == 0 else (2 * m + 33) << (e - 1)
        assert t.ALAW[i] == 8 * (size if a & 128 else -size)


def slow_adpcm(data, block):
    out = []
    for first in range(0, len(data), block):
        b = data[first : first + block]
        value, place = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(t.STEPS[place])
                change = step >> 3
                if code & 4:
                    change += step
                if code & 2:
                    change += step >> 1
                if code & 1:
                    change += step >> 2
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                place = max(0, min(88, place + int(t.MOVES[code & 7])))
                out.append(value)
    return out


def test_adpcm():
    data = np.random.default_rng(1).integers(0, 256, 64 * 9, dtype=np.uint8)
    assert t.adpcm(data, 64).tolist() == slow_adpcm(data.tobytes(), 64)


def test_steps_follow_their_law():
    """Each step is about 1.1 times the one before."""
    assert len(t.STEPS) == 89 and np.all(np.abs(t.STEPS[20:] / t.STEPS[19:-1] - 1.1) < 0.02)


@pytest.mark.parametrize("codec", list(t.CODECS))
def test_round_trip(codec):
    payload = bytes(range(256)) * 3
    assert t.unwrap(t.wrap(payload, codec))[::2] == (codec, payload)
    with pytest.raises(ValueError):
        t.unwrap(b"no")


def tone(hertz, rate, seconds=0.25):
    return np.rint(12_000 * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)).astype(np.int16)


def test_resample(monkeypatch):
    for rate, target in ((8000, 16000), (8000, 11025), (16000, 8000), (8000, 8000)):
        for hertz in (200, 1000, 2500):
            got, want = t.resample(tone(hertz, rate), rate, target), tone(hertz, target)
            inner = slice(200, min(len(got), len(want)) - 200)
            assert abs(len(got) - len(want)) <= 1 and np.abs(got[inner].astype(int) - want[inner]).max() < 300, (rate, target, hertz)
    assert np.array_equal(t.resample(tone(700, 8000))[0::2], tone(700, 8000))
    assert np.abs(t.resample(tone(6000, 16000), 16000, 8000)[50:-50]).max() < 300  # what the new rate can't hold goes
    assert set(t.resample(np.full(100, 77, np.int16)).tolist()) == {77}
    assert t.resample(np.zeros(0, np.int16)).tolist() == []
    whole = t.resample(tone(900, 8000), 8000, 11025)
    monkeypatch.setattr(t, "SPAN", 7)
    assert np.array_equal(t.resample(tone(900, 8000), 8000, 11025), whole)


def test_feature():
    """Against a sample-by-sample count."""
    for codec in t.CODECS:
        data = np.random.default_rng(4).integers(0, 256, 128, dtype=np.uint8).tobytes()
        pcm = slow_adpcm(data, 64) if codec == "adpcm" else [int((t.MULAW if codec == "mulaw" else t.ALAW)[b]) for b in data]
        stored = t.resample(np.array(pcm, np.int16)).astype("<i2").tobytes()
        turns = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
        want = f"{codec}:{len(pcm)}:{sum(x * x for x in pcm)}:{turns}:{max(map(abs, pcm))}:{zlib.crc32(stored):08x}"
        assert t.feature(codec, t.decode(codec, 64, data), stored) == want


def test_rows(spark, sf):
    rows = [(1, None), (2, ""), (3, "a"), (4, "x" * 64), (5, "é" * 33), (3, "a"), (None, "b")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, media int")
    for r in t.store(df).collect():
        payload = t.payload_of((dict(rows)[r.doc_id] or "").encode())
        codec, block, data = t.unwrap(r.media)
        assert data == payload and len(payload) % 64 == 0 and len(payload) >= 64
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert np.array_equal(np.frombuffer(r.pcm, "<i2"), t.resample(t.decode(codec, block, data)))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in t.op8_telephony_audio(spark, sf).collect():
        payload = t.payload_of((docs[r.doc_id] or "").encode())
        media = t.wrap(payload, t.codec_of(payload))
        assert (r.n_bytes, r.payload_sha256, r.media_bytes, r.media_sha256) == (len((docs[r.doc_id] or "").encode()), hashlib.sha256(payload).hexdigest(), len(media), hashlib.sha256(media).hexdigest())
    assert t.store(df.limit(0)).count() == 0
