"""Telephony audio columns: mu-law and A-law expanded by lookup tables, IMA ADPCM decoded across blocks, resampled PCM.

A media column holds RIFF/WAVE bytes. Payload bytes are stored as they are, one 8-bit sample each, so storing is
lossless. Resampled PCM is stored losslessly coded by one step of integer lifting, as lossless codecs do: every other
sample, and what the rest differ from the mean of their neighbours. Decoders work on the bytes of many rows at once: companded samples by one table lookup, ADPCM by one
numpy step for the same nibble of all blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from attestor.llm.common import CHUNK_BYTES, release, scratch, table

#: Format codes of RIFF/WAVE.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 0x11
RATE, PCM_RATE = 8000, 16000
UNIT = 64
BLOCK = 64
#: Row groups of stored PCM, which a task holds in memory until they are written.
ROW_GROUP_BYTES, ZSTD_LEVEL = 16 << 20, 6


def mu_law_table() -> np.ndarray:
    """16-bit values of the 256 mu-law codes (G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit values of the 256 A-law codes (G.711)."""
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MU_TABLE, A_TABLE = mu_law_table(), a_law_table()

# Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
#: For each index and nibble, the change of the predictor and the next index.
_DELTA = np.zeros((len(STEPS), 16), dtype=np.int32)
_NEXT = np.zeros((len(STEPS), 16), dtype=np.int32)
for _n in range(16):
    _size = STEPS // 8 + STEPS * ((_n >> 2) & 1) + STEPS // 2 * ((_n >> 1) & 1) + STEPS // 4 * (_n & 1)
    _DELTA[:, _n] = -_size if _n & 8 else _size
    _NEXT[:, _n] = np.clip(np.arange(len(STEPS)) + CHANGES[_n & 7], 0, len(STEPS) - 1)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of IMA ADPCM blocks (a row of bytes each): the header's sample, then two for each byte.

    A step index above the table's end in a damaged header is taken as the last.
    """
    n, size = blocks.shape
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out = np.empty((2 * (size - 4) + 1, n), dtype=np.int16)
    out[0] = value
    delta, after = _DELTA.ravel(), _NEXT.ravel()
    for i, column in enumerate(np.ascontiguousarray(blocks[:, 4:].T)):
        for j, nibble in enumerate((column & 15, column >> 4)):
            at = index * 16 + nibble
            value = np.clip(value + delta[at], -32768, 32767)
            index = after[at]
            out[2 * i + j + 1] = value
    return np.ascontiguousarray(out.T)


def wave(payload: bytes, code: int = MU_LAW, rate: int = RATE, block: int = 1, bits: int = 8, per_block: int = 1) -> bytes:
    """RIFF/WAVE bytes of one channel around payload."""
    extra = struct.pack("<HH", 2, per_block) if code == IMA_ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", code, 1, rate, rate * block // per_block, block, bits) + extra
    fact = struct.pack("<4sII", b"fact", 4, len(payload) // block * per_block)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + fact + struct.pack("<4sI", b"data", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _chunks(media: bytes | memoryview) -> tuple[tuple[int, int, int, int, int, int], memoryview]:
    """The fields of fmt, and the payload. ValueError for anything else than RIFF/WAVE with fmt and data."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not RIFF/WAVE")
    at, fmt = 12, None
    while at + 8 <= len(view):
        name, size = struct.unpack_from("<4sI", view, at)
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", view, at + 8)
        if name == b"data" and fmt:
            return fmt, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def parse_wave(media: bytes | memoryview) -> tuple[int, int, int, memoryview]:
    """(format code, rate, block size, payload). ValueError for anything else than RIFF/WAVE with fmt and data."""
    fmt, payload = _chunks(media)
    return fmt[0], fmt[2], fmt[4], payload


def samples_of(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of one media value in any of the four formats; ValueError for other depths and channel counts."""
    (code, channels, rate, _, block, bits), payload = _chunks(media)
    raw = np.frombuffer(payload, dtype=np.uint8)
    if channels != 1:
        raise ValueError(f"{channels} channels")
    if code == MU_LAW:
        return rate, MU_TABLE[raw]
    if code == A_LAW:
        return rate, A_TABLE[raw]
    if code == PCM and bits == 16:
        return rate, raw[: len(raw) // 2 * 2].view("<i2")
    if code == PCM and bits == 8:
        return rate, ((raw.astype(np.int16) - 128) << 8).astype(np.int16)
    if code == IMA_ADPCM and block > 4:
        whole = len(raw) // block * block
        parts = [decode_adpcm(raw[:whole].reshape(-1, block)).ravel()]
        if len(raw) - whole >= 4:  # the last block may be shorter
            parts.append(decode_adpcm(raw[whole:].reshape(1, -1)).ravel())
        return rate, np.concatenate(parts)
    raise ValueError(f"format {code} of {bits} bits")


#: Head of coded PCM: mark, rate and number of samples.
_CODED = struct.Struct("<4sII")


def coded(x: np.ndarray, rate: int) -> bytes:
    """16-bit samples, losslessly: the even ones, then the odd ones less the mean of their neighbours, modulo 2**16."""
    even, odd = x[::2].astype(np.int32), x[1::2].astype(np.int32)
    return _CODED.pack(b"LPCM", rate, len(x)) + even.astype("<i2").tobytes() + (odd - _between(even, len(odd))).astype("<i2").tobytes()


def uncoded(value: bytes | memoryview) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of coded PCM; ValueError for other bytes."""
    view = memoryview(value)
    if len(view) < _CODED.size or view[:4] != b"LPCM":
        raise ValueError("not coded PCM")
    _, rate, n = _CODED.unpack_from(view)
    held = np.frombuffer(view[_CODED.size :], dtype="<i2").astype(np.int32)
    out, half = np.empty(n, dtype=np.int16), (n + 1) // 2
    out[::2] = held[:half]
    out[1::2] = (held[half:] + _between(held[:half], n // 2)).astype(np.int16)
    return rate, out


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """Means of neighbouring even samples; after the last, itself."""
    return (even[:n] + np.append(even[1:], even[-1:])[:n]) >> 1


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate, by linear interpolation; the last sample is held."""
    if rate == to or not len(x):
        return x.astype(np.int16)
    n = len(x) * to // rate
    at = np.arange(n) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(x) - 1)
    a, b = x[left].astype(np.int64), x[right].astype(np.int64)
    return (a + (b - a) * part // to).astype(np.int16)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for lo, hi in _parts([len(t) for t in raw]):
            media = [wave(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b"\0")) for t in raw[lo:hi]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in raw[lo:hi]], type=pa.int64()), pa.array(media, type=pa.binary())], names=["doc_id", "n_bytes", "media"])


def encoded(docs: DataFrame, rate: int | None = None) -> DataFrame:
    """doc_id, n_bytes and media: the UTF-8 bytes of text, zero-padded to a positive multiple of UNIT, as mu-law WAVE.

    With a rate, also pcm, coded as store_pcm() has it, made in the same pass. Null and empty texts become one unit of zeros;
    repeated rows stay repeated.
    """
    docs, schema = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id bigint, n_bytes bigint, media binary"
    if rate is None:
        return docs.mapInArrow(_encode, schema)
    return docs.mapInArrow(lambda batches: _add_pcm(_encode(batches), rate, coded), f"{schema}, pcm binary")


def _parts(sizes: list[int], limit: int = 4 * CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n + 1
    if lo < len(sizes):
        yield lo, len(sizes)


def _wave_pcm(x: np.ndarray, rate: int) -> bytes:
    return wave(x.astype("<i2").tobytes(), PCM, rate, 2, 16)


def _add_pcm(batches: Iterator[pa.RecordBatch], rate: int, form: Callable[[np.ndarray, int], bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(batch.schema.get_field_index("media"))
        for lo, hi in _parts([len(v.as_buffer() or b"") for v in values], CHUNK_BYTES):
            out: list[bytes | None] = []
            for value in values.slice(lo, hi - lo).to_pylist():
                try:
                    own, x = samples_of(value or b"")
                    out.append(form(resample(x, own, rate), rate))
                except (ValueError, struct.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(out, type=pa.binary())], names=[*batch.schema.names, "pcm"])
            del out
            release()


def with_pcm(media: DataFrame, rate: int = PCM_RATE, form: Callable[[np.ndarray, int], bytes] = _wave_pcm) -> DataFrame:
    """All columns of media with pcm, WAVE bytes of 16-bit samples at the rate; null where media can't be read."""
    return media.mapInArrow(lambda batches: _add_pcm(batches, rate, form), StructType([*media.schema.fields, StructField("pcm", BinaryType())]))


def pcm_column(media: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """doc_id and pcm of media(doc_id, media), as with_pcm() makes it."""
    return with_pcm(media.select(F.col("doc_id").cast("long"), "media"), rate).select("doc_id", "pcm")


def store_pcm(media: DataFrame, out: str, rate: int = PCM_RATE) -> None:
    """Writes all columns of media and its resampled PCM, losslessly coded, to Parquet; restored() gives it back as WAVE."""
    rows = media if "pcm" in media.columns else with_pcm(media, rate, coded)
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(ZSTD_LEVEL), "parquet.block.size": str(ROW_GROUP_BYTES)}
    rows.write.options(**options).parquet(out)


def restored(stored: DataFrame) -> DataFrame:
    """stored, as store_pcm() wrote it, with pcm as WAVE bytes; null where it is null."""
    at = stored.columns.index("pcm")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _parts([len(v.as_buffer() or b"") for v in batch.column(at)], CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                out = [v if v is None else _wave_pcm(*uncoded(v)[::-1]) for v in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(out, type=pa.binary()))

    return stored.mapInArrow(restore, stored.schema)


def features(media: DataFrame) -> DataFrame:
    """Digests of stored mu-law media and its stored PCM, and of the PCM that the other decoders make of the payload.

    feature: crc32 of the stored PCM's samples, of the payload as A-law PCM and as ADPCM PCM; the mu-law signal's root
    mean square, peak and zero crossings.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, pcm = ([v.as_buffer() for v in batch.column(i)] for i in (2, 3))
            for lo, hi in _parts([len(v) for v in values]):
                yield _measured(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), values[lo:hi], pcm[lo:hi])
            del values, pcm, batch
            release()

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(measure, schema)


def _measured(ids: pa.Array, n_bytes: pa.Array, values: list[pa.Buffer], pcm: list[pa.Buffer]) -> pa.RecordBatch:
    payloads = [parse_wave(memoryview(v))[3] for v in values]
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    mu = MU_TABLE[raw]
    law = memoryview(A_TABLE[raw].tobytes())
    blocks = decode_adpcm(raw.reshape(-1, BLOCK))
    adpcm, width = memoryview(blocks.tobytes()), 2 * blocks.shape[1]
    power = np.add.reduceat(mu.astype(np.int64) ** 2, at[:-1])
    peak = np.maximum.reduceat(np.abs(mu.astype(np.int32)), at[:-1])
    turns = np.zeros(len(mu), dtype=np.int64)
    turns[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
    turns[at[:-1]] = 0
    crossings = np.add.reduceat(turns, at[:-1])
    feature = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        crcs = (zlib.crc32(uncoded(memoryview(pcm[i]))[1].astype("<i2").tobytes()), zlib.crc32(law[2 * a : 2 * b]), zlib.crc32(adpcm[a // BLOCK * width : b // BLOCK * width]))
        feature.append(f"{crcs[0]:08x}:{crcs[1]:08x}:{crcs[2]:08x}:{int((power[i] / sizes[i]) ** 0.5)}:{peak[i]}:{crossings[i]}")
    return pa.RecordBatch.from_arrays(
        [
            ids,
            n_bytes,
            pa.array(sizes),
            pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], type=pa.int64()),
            pa.array([len(v) for v in values], type=pa.int64()),
            pa.array([hashlib.sha256(memoryview(v)).hexdigest() for v in values]),
            pa.array(feature),
        ],
        names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    )


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every row's stored media and PCM, as features() has them; null and empty texts are one unit of zeros.

    Null ids and repeated rows are rows like any other; other columns are not read; without rows there is nothing.
    """
    out = scratch(spark, "media")
    store_pcm(encoded(table(spark, sf_dir, "documents"), PCM_RATE), out)
    return features(spark.read.schema("doc_id bigint, n_bytes bigint, media binary, pcm binary").parquet(out))
