"""Operator 8: telephony audio columns.

A payload of bytes is stored as a WAV file of 8-bit mu-law, 8-bit A-law or 4-bit
IMA ADPCM samples (``media``) and expanded from the file that was stored
(``expanded``). mu-law and A-law samples expand through tables of 256 values that follow
from their definitions; ADPCM decodes all blocks of many files at once, one numpy step
for each sample of a block. The PCM is resampled by a windowed sinc filter, from 8 to
16 kHz, and stored as 16-bit samples.

Payload: the UTF-8 bytes of a text (null: empty) and zero bytes up to the next
positive multiple of ``BLOCK``. The codec of a text follows from its checksum, so
that equal texts have equal values.

Defined cases: empty and null texts are one block of zeros; equal rows get equal
results, and there are no ties to break; null ids stay; extra columns are ignored; an
empty table gives an empty result. A file whose header is damaged raises ``ValueError``.
A text of any length is one file; its PCM takes up to eight times its bytes, and both
have to fit in a task's memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import plain, saved, table
from pagewright.llm.tokens import parts_of

BLOCK = 64
RATE, TARGET_RATE = 8000, 16000
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
NAMES = {v: k for k, v in CODECS.items()}


def _mulaw() -> np.ndarray:
    """ITU-T G.711: sign, three bits of exponent, four of mantissa, all inverted; bias 33, scaled by 4."""
    u = ~np.arange(256, dtype=np.uint8)
    size = ((((u & 15).astype(np.int32) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    """ITU-T G.711: every second bit inverted; exponent 0 is linear."""
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent.astype(np.int32) - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def _steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


MULAW, ALAW, STEPS = _mulaw(), _alaw(), _steps()
#: How a nibble's size moves the step index.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def wrap(payload: bytes, codec: str) -> bytes:
    """A mono WAV file whose data are exactly ``payload``."""
    tag = CODECS[codec]
    if codec == "adpcm":
        samples = 1 + (BLOCK - 4) * 2
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * BLOCK // samples, BLOCK, 4, 2, samples)
        count = len(payload) // BLOCK * samples
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
        count = len(payload)
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(payload)) + payload
    body += b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def unwrap(media: bytes) -> tuple[str, int, bytes]:
    """Codec, block size and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, block, data = 12, None, 1, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, _, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            codec = NAMES.get(tag)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if codec is None or data is None:
        raise ValueError("no telephony audio in this file")
    return codec, block, data


def adpcm(data: np.ndarray, block: int) -> np.ndarray:
    """All blocks of ``block`` bytes at once: predictor, step index, then two samples a byte, low nibble first."""
    blocks = data.reshape(-1, block)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    place = np.minimum(blocks[:, 2], 88).astype(np.int32)
    nibbles = np.empty((len(blocks), 2 * (block - 4)), np.uint8)
    nibbles[:, 0::2], nibbles[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    out = np.empty((1 + nibbles.shape[1], len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(nibbles.T, 1):
        step, size = STEPS[place], (code & 7).astype(np.int32)
        # step/8 and the bits of the code worth step, step/2 and step/4, each cut to a whole number
        change = (step >> 3) + (step & -(size >> 2)) + ((step >> 1) & -((size >> 1) & 1)) + ((step >> 2) & -(size & 1))
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        place = np.clip(place + MOVES[size], 0, 88)
        out[k] = value
    return out.T.ravel()


def decode(codec: str, block: int, data: bytes) -> np.ndarray:
    samples = np.frombuffer(data, np.uint8)
    if codec == "adpcm":
        return adpcm(samples[: len(samples) // block * block], block)
    return (MULAW if codec == "mulaw" else ALAW)[samples]


def decode_all(parts: list[tuple[str, int, bytes]]) -> list[np.ndarray]:
    """``decode`` for many files; the ADPCM blocks of all files with one block size are decoded together."""
    out: list[np.ndarray | None] = [None if codec == "adpcm" else decode(codec, block, data) for codec, block, data in parts]
    for size in {block for codec, block, _ in parts if codec == "adpcm"}:
        mine = [i for i, (codec, block, _) in enumerate(parts) if codec == "adpcm" and block == size]
        count = [len(parts[i][2]) // size for i in mine]
        samples = decode("adpcm", size, b"".join(parts[i][2][: n * size] for i, n in zip(mine, count)))
        ends = np.cumsum(count) * (1 + 2 * (size - 4))
        for i, pcm in zip(mine, np.split(samples, ends[:-1])):
            out[i] = pcm
    return out


#: Samples on each side that a resampled one is made of; samples that are filtered together.
HALF, SPAN = 8, 1 << 16


@lru_cache(maxsize=8)
def taps(up: int, down: int) -> np.ndarray:
    """Weights of the 2 * half samples around a place, for each of ``up`` places between two samples: a sinc under a Hann window.

    When the rate falls, the sinc is as much wider, so that nothing above half the new rate passes.
    """
    cutoff = min(1.0, up / down)
    half = int(np.ceil(HALF / cutoff))
    away = np.arange(1 - half, half + 1)[None, :] - np.arange(up)[:, None] / up
    weight = cutoff * np.sinc(cutoff * away) * (0.5 + 0.5 * np.cos(np.pi * away / half))
    weight[np.abs(weight) < 1e-12] = 0
    return weight / weight.sum(1, keepdims=True)


def resample(pcm: np.ndarray, rate: int = RATE, target: int = TARGET_RATE) -> np.ndarray:
    """16-bit samples at the new rate; beyond its ends the sound keeps its first and last sample."""
    if not len(pcm):
        return pcm
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    weight = taps(up, down)
    half = weight.shape[1] // 2
    padded = np.concatenate((np.repeat(pcm[:1], half - 1), pcm, np.repeat(pcm[-1:], half)))
    out = np.empty(-(-len(pcm) * up // down), np.int16)
    for first in range(0, len(pcm), SPAN * down):
        span = padded[first : first + SPAN * down + 2 * half - 1].astype(np.float64)
        inside = min(SPAN * down, len(pcm) - first)
        at = np.arange(first * up // down, min(-(-(first + inside) * up // down), len(out)))
        base, phase = at * down // up - first, at * down % up
        for p in range(up):
            mine = phase == p
            if np.count_nonzero(weight[p]) == 1:  # the place of a sample
                value = span[half - 1 :][base[mine]]
            else:
                value = np.convolve(span, weight[p][::-1], "valid")[base[mine]]
            out[at[mine]] = np.clip(np.rint(value), -32768, 32767)
    return out


def payload_of(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % BLOCK or (0 if data else BLOCK))


def codec_of(payload: bytes) -> str:
    return list(CODECS)[zlib.crc32(payload) % len(CODECS)]


def feature(codec: str, pcm: np.ndarray, stored: bytes) -> str:
    """Codec, samples, energy, sign changes, peak and the checksum of the resampled PCM."""
    wide = pcm.astype(np.int64)
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec}:{len(pcm)}:{int((wide * wide).sum())}:{turns}:{int(np.abs(wide).max(initial=0))}:{zlib.crc32(stored):08x}"


#: Bytes of texts, or of media, that a task has in hand at a time.
SLICE = 1 << 18


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        for texts in parts_of(batch.column("text"), SLICE):
            payloads = [(text or "").encode() for text in texts.to_pylist()]
            files = [wrap(p, codec_of(p)) for p in map(payload_of, payloads)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(map(len, payloads), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
            first += len(texts)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the file of every row."""
    return plain(docs, "doc_id", "text").mapInArrow(_media, "doc_id long, n_bytes long, media binary")


_EXPANDED = "doc_id long, n_bytes long, pcm binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _expand(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        for column in parts_of(batch.column("media"), SLICE):
            files, n = column.to_pylist(), len(column)
            parts = [unwrap(m) for m in files]
            rows = []
            for m, (codec, _, back), pcm in zip(files, parts, decode_all(parts)):
                stored = resample(pcm).astype("<i2").tobytes()
                rows.append((stored if keep else None, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(codec, pcm, stored)))
            types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["pcm", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("n_bytes").slice(first, n), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["doc_id", "n_bytes", *names])
            first += n


def expanded(files: DataFrame, keep: bool = True) -> DataFrame:
    """What ``media`` gave, as it was stored: the resampled PCM (null if not ``keep``), and digests of file, payload and PCM."""
    return files.mapInArrow(lambda b: _expand(b, keep), _EXPANDED)


def store(docs: DataFrame) -> DataFrame:
    """Media and PCM of every row as two stored tables joined by row: doc_id, media, pcm and the digests."""
    files = saved(media(docs).withColumn("row_no", F.monotonically_increasing_id()), "media", "zstd")
    pcm = saved(files.select("row_no", "doc_id", "n_bytes", "media").mapInArrow(_with_row, "row_no long, " + _EXPANDED), "pcm", "zstd")
    return pcm.join(files.select("row_no", "media"), "row_no").drop("row_no")


def _with_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        for out in _expand(iter([batch]), True):
            yield pa.RecordBatch.from_arrays([batch.column("row_no").slice(first, out.num_rows), *out.columns], ["row_no", *out.schema.names])
            first += out.num_rows


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are stored in the shared folder and read back; the PCM, half as large again as the tables even when compressed, isn't (see README)."""
    files = saved(media(table(spark, sf_dir, "documents")), "media", "zstd")
    return expanded(files, keep=False).drop("pcm")
