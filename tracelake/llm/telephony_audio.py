"""Telephony audio: mu-law and A-law by lookup tables, IMA ADPCM blocks by numpy across blocks.

A payload of 8-bit samples is stored losslessly as a RIFF/WAVE mu-law file in a table. Reading it back
parses the file, expands the samples by both companding tables, decodes the same bytes as ADPCM
blocks, and resamples the mu-law signal to twice its rate; the PCM is stored in a table too, every
sample without loss, and read back.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracelake.llm.common import map_texts, materialize, slices, tidied

RATE = 8000
#: Rate of the PCM that digest() stores.
STORED_RATE = 16_000
#: Payloads are padded with 255 to a positive multiple of this: 16 ADPCM blocks.
FRAME = 576
BLOCK = 36
MULAW_TAG = 7

#: Fixed values of the IMA ADPCM format: step sizes follow from the published table; index changes by code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    size = ((((u & 15).astype(np.int32) << 3) + 132) << ((u >> 4) & 7).astype(np.int32)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = ((a >> 4) & 7).astype(np.int32), ((a & 15).astype(np.int32) << 4) + 8
    size = np.where(exponent > 0, (mantissa + 256) << np.maximum(exponent - 1, 0), mantissa)
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
#: Change of the predictor by step index and code.
_DELTA = np.array([[(1 - 2 * (c >> 3)) * ((s >> 3) + (s >> 2) * (c & 1) + (s >> 1) * (c >> 1 & 1) + s * (c >> 2 & 1)) for c in range(16)] for s in STEPS.tolist()], np.int32)
_NEXT = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[None, :], 0, len(STEPS) - 1).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) uint8 -> (n, samples) int16. A block is a predictor (int16), a step index, a spare byte, then two codes a byte, the low one first. All blocks go forward together, one code at a time."""
    predictor = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)  # one row a step: contiguous
    codes[0::2] = (blocks[:, 4:] & 15).T
    codes[1::2] = (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = predictor
    delta, following = _DELTA.ravel(), _NEXT.ravel()
    for k, code in enumerate(codes):
        at = (index << 4) | code
        predictor += delta[at]
        np.clip(predictor, -32768, 32767, out=predictor)
        index = following[at]
        out[k + 1] = predictor
    return out.T


def wave(payload: bytes, rate: int = RATE) -> bytes:
    """A mono mu-law WAVE file whose samples are the payload's bytes."""
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVE" + struct.pack("<4sIHHIIHHH", b"fmt ", 18, MULAW_TAG, 1, rate, rate, 1, 8, 0) + struct.pack("<4sII", b"fact", 4, len(payload)) + struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(stored: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and sample bytes of a WAVE file; raises ValueError on anything else."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, None, None
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            if tag is None or at + 8 + size > len(stored):
                raise ValueError("truncated WAVE file")
            return tag, rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples in WAVE file")


def expand(tag: int, data: bytes) -> np.ndarray:
    """int16 PCM of mu-law (7), A-law (6) or IMA ADPCM (17, blocks of BLOCK bytes) samples."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW_TAG:
        return MULAW[raw]
    if tag == 6:
        return ALAW[raw]
    if tag == 17:
        return decode_adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    raise ValueError(f"format {tag} is not telephony audio")


def lowpassed(pcm: np.ndarray, share: float) -> np.ndarray:
    """PCM without what lies above `share` of its band: a windowed sinc of unit gain, ends held."""
    half = 8 * math.ceil(1 / share)
    k = np.arange(-half, half + 1)
    taps = np.sinc(share * k) * np.hanning(2 * half + 3)[1:-1]
    made = np.convolve(np.pad(pcm.astype(np.float64), half, "edge"), taps / taps.sum(), "valid")
    return np.clip(np.rint(made), -32768, 32767).astype(np.int16)


def resampled(pcm: np.ndarray, rate: int, source_rate: int = RATE) -> np.ndarray:
    """PCM at another rate by linear interpolation in whole numbers, behind a low-pass where the rate falls; the last sample is held."""
    if rate < source_rate:
        pcm = lowpassed(pcm, rate / source_rate)
    common = math.gcd(rate, source_rate)
    up, down = rate // common, source_rate // common
    k = np.arange(-(-len(pcm) * up // down), dtype=np.int64) * down
    at, part = k // up, (k % up).astype(np.int32)
    wide = pcm.astype(np.int32)
    after = wide[np.minimum(at + 1, len(pcm) - 1)]
    return ((wide[at] * (up - part) + after * part) // up).astype(np.int16)


#: The mu-law code of each PCM value that has one, -1 for others, by value + 32768.
_CODE = np.full(65536, -1, np.int16)
_CODE[MULAW.astype(np.int32) + 32768] = np.arange(256)


def packed(pcm: np.ndarray) -> bytes:
    """PCM without loss, small where it is a mu-law signal at twice its rate: samples at even places by their codes, at odd places by their difference from the mean of their neighbours, which is kept only where there is any. Other PCM is kept as it is."""
    codes = _CODE[pcm[::2].astype(np.int32) + 32768]
    if (codes < 0).any():
        return struct.pack("<cq", b"P", len(pcm)) + pcm.astype("<i2").tobytes()
    rest = (pcm[1::2] - _between(pcm[::2], len(pcm) // 2)).astype("<i2")
    return struct.pack("<cq", b"M", len(pcm)) + codes.astype(np.uint8).tobytes() + (rest.tobytes() if rest.any() else b"")


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """Means of neighbours, rounded down, modulo 2 ** 16; the last one is held."""
    wide = even.astype(np.int32)
    return ((wide[:n] + np.append(wide[1:], wide[-1:])[:n]) // 2).astype(np.int16)


def unpacked(stored: bytes) -> np.ndarray:
    """The int16 PCM of `packed` bytes; raises ValueError on anything else."""
    if len(stored) < 9 or stored[:1] not in b"PM":
        raise ValueError("not packed PCM")
    kind, n = struct.unpack_from("<cq", stored)
    if kind == b"P":
        return np.frombuffer(stored, "<i2", n, 9).astype(np.int16)
    out, half = np.empty(n, np.int16), n - n // 2
    out[::2] = MULAW[np.frombuffer(stored, np.uint8, half, 9)]
    out[1::2] = _between(out[::2], n // 2)
    if len(stored) > 9 + half:
        out[1::2] += np.frombuffer(stored, "<i2", n // 2, 9 + half)
    return out


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME)


def _features(data: bytes, adpcm: np.ndarray) -> str:
    mu, a = expand(7, data), expand(6, data)
    crc = lambda x: zlib.crc32(np.ascontiguousarray(x))
    crossings = int(np.count_nonzero((mu[1:] < 0) != (mu[:-1] < 0)))
    level = int(np.sqrt(np.square(mu.astype(np.float64)).mean()))
    return f"alaw={crc(a):08x};adpcm={crc(adpcm):08x};rms={level};zc={crossings};peak={int(np.abs(mu.astype(np.int32)).max())}"


MEDIA = "doc_id long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DECODED = SCHEMA + ", pcm binary"


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the WAVE file of each text's bytes; a null text is empty, and an empty one is a frame of 255."""

    def work(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "media": [wave(payload_of(t)) for t in texts]}

    return map_texts(docs, work, MEDIA, doc_id, text)


def pcm(media: DataFrame, rate: int = 16_000) -> DataFrame:
    """doc_id and little-endian PCM at `rate` of each stored file. A null file gives null; one that is no telephony audio fails the job, as its samples cannot be told. Repeated rows get equal PCM; an empty table gives an empty one."""

    def of(stored: bytes) -> bytes:
        tag, own_rate, data = samples(stored)
        return resampled(expand(tag, data), rate, own_rate).astype("<i2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "media"):
                made = [None if stored is None else of(stored) for stored in part.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(tidied(run), "doc_id long, pcm binary")


def _mapped(df: DataFrame, column: str, schema: str, work: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """work over slices of a table with binary payloads."""
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(out)
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(work(part), to)], schema=to)

    return df.mapInArrow(tidied(run), out)


def _decode(rate: int) -> Callable[[pa.RecordBatch], list]:
    """Stored files -> _DECODED: digests of payload and file, features of the samples by each format, and the resampled PCM."""

    def work(part: pa.RecordBatch) -> list:
        stored = part.column("media").to_pylist()
        read = [samples(s)[2] for s in stored]
        adpcm = decode_adpcm(np.frombuffer(b"".join(read), np.uint8).reshape(-1, BLOCK))
        ends = np.cumsum([len(r) // BLOCK for r in read])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        made = [(len(r), sha(r), zlib.crc32(r[-32:]), len(s), sha(s), _features(r, p), packed(resampled(expand(7, r), rate))) for r, s, p in zip(read, stored, np.split(adpcm, ends[:-1]))]
        return [part.column("doc_id"), part.column("n_bytes"), *(list(c) for c in zip(*made))]

    return work


def _heard(part: pa.RecordBatch) -> list:
    """_DECODED -> SCHEMA: the features end with those of the PCM as it was read back."""

    def of(stored: bytes) -> str:
        pcm = unpacked(stored)
        return f"pcm={zlib.crc32(pcm.astype('<i2').tobytes()):08x};samples={len(pcm)};mean={int(pcm.astype(np.int64).sum()) // len(pcm)}"

    features = [f"{f};{of(p)}" for f, p in zip(part.column("feature").to_pylist(), part.column("pcm").to_pylist())]
    return [*(part.column(n) for n in part.schema.names if n not in ("feature", "pcm")), features]


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = STORED_RATE) -> DataFrame:
    """One row per row of docs with SCHEMA. The WAVE files and then the PCM at `rate`, packed without loss, are written as tables and read back. Equal texts give equal values; extra columns are left out; an empty table gives an empty one."""
    media = materialize(store(docs, doc_id, text), "audio-media", "zstd")
    decoded = materialize(_mapped(media, "media", _DECODED, _decode(rate)), "audio-pcm", "zstd")
    return _mapped(decoded, "pcm", SCHEMA, _heard)
