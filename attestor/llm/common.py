"""Helpers shared by the corpus operators: tables, shared scratch folders, byte-level text kernels."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.sources.scratch import remove, scratch

#: Texts are taken in chunks of about so many bytes, which bounds the memory of the numpy kernels.
CHUNK_BYTES = 1 << 19
#: Bounds of the batches that are sent to Python workers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

#: Keys of more rows than this, and than this part of all rows, are broadcast in a join.
HOT_ROWS, HOT_KEYS = 256, 10_000

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first n bytes of eight, and the length from which a span is hashed as a whole.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
LONG_SPAN = 256


def bounded(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH, so that a worker's memory doesn't depend on how long texts are."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None) or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df, written to the shared scratch folder and read back: cuts lineage and survives lost executors. codec overrides the session's."""
    spark = df.sparkSession
    bounded(spark)
    path = scratch(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Removes the folders of written() frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)


def met(rows: DataFrame, keys: DataFrame, on: str, value: str, count: str, total: int, spread: Column) -> DataFrame:
    """rows with `value` of keys(on, value, count) where the column `on` agrees, null elsewhere; no task gets all rows of a key.

    count is how many rows each key meets, of total. Keys that meet more than HOT_ROWS rows and more than a HOT_KEYS-th of all
    are fewer than HOT_KEYS, and are broadcast. The rows that they met go through the join of all other keys by spread instead
    of their key.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = keys.where(F.col(count) > limit).select(F.col(on).alias("hot_key"), F.col(value).alias("hot_value"))
    cold = keys.where(F.col(count) <= limit).select(F.col(on).alias("cold_key"), F.col(value).alias("cold_value"))
    rows = rows.join(F.broadcast(hot), F.col(on) == F.col("hot_key"), "left")
    done = F.col("hot_key").isNotNull()
    rows = rows.withColumn("by_key", F.when(done | F.col(on).isNull(), spread.cast(rows.schema[on].dataType)).otherwise(F.col(on)))
    rows = rows.join(cold, F.col("by_key") == F.col("cold_key"), "left")
    found = F.when(done, F.col("hot_value")).when(F.col(on).isNotNull(), F.col("cold_value"))
    return rows.withColumn(value, found).drop("hot_key", "hot_value", "cold_key", "cold_value", "by_key")


def chunked(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of runs of whole texts; nulls count as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    raw, data = text.buffers()[1], text.buffers()[2]
    offs = np.frombuffer(raw, dtype=np.int64)[text.offset : text.offset + n + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, body[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    del text, raw, data, offs, body
    release()


def release() -> None:
    """Gives freed memory back to the system, so that idle workers keep little."""
    pa.default_memory_pool().release_unused()
    if _LIBC and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL(None)
    except (OSError, TypeError):  # no such library to load
        return None


_LIBC = _libc()


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """For each byte of buf, the eight bytes from there on as one little-endian number, with zeros after the end."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.

    Eight bytes at a time are mixed in by a step that no two values share, so spans of one length up to eight bytes never
    collide, and longer ones only as random numbers do; spans above LONG_SPAN are hashed by blake2b.
    """
    view, size = eights(buf), ends - starts
    out = mix(mix(size.astype(U64) + U64(0xD6E8FEB86659FD93)) ^ (view[starts] & FIRST_BYTES[np.minimum(size, 8)]))
    live, at = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(live):
        block = view[starts[live] + at] & FIRST_BYTES[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] * U64(0xE7037ED1A0B428DB) ^ block)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the bytes of the span whose number `other` gives."""
    view, size = eights(buf), ends - starts
    if (size != size[other]).any():
        return False
    live, at = np.flatnonzero(size <= LONG_SPAN), 0
    while len(live):
        differ = view[starts[live] + at] ^ view[starts[other[live]] + at]
        if (differ & FIRST_BYTES[np.minimum(size[live] - at, 8)]).any():
            return False
        at += 8
        live = live[size[live] > at]
    long = np.flatnonzero(size > LONG_SPAN).tolist()
    return all(np.array_equal(buf[starts[i] : ends[i]], buf[starts[other[i]] : ends[other[i]]]) for i in long)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each text the index of its first word (and the end)."""
    n = len(buf)
    solid = ~_SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offs[(offs > 0) & (offs < n)]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs, side="left")


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and for each text the index of its first word (and the end)."""
    starts, ends, at = words(buf, offs)
    return span_hashes(_LOWER[buf], starts, ends), at


def shingle_hashes(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text with repeats, and where each text's begin.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    counts = np.diff(at)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(per)])
    total = int(bounds[-1])
    owner = np.repeat(np.arange(len(counts)), per)
    pos = at[:-1][owner] + (np.arange(total) - bounds[:-1][owner])
    padded = np.concatenate([h, np.zeros(k, dtype=U64)])
    left = counts[owner]
    out = np.minimum(left, k).astype(U64) * U64(0xA0761D6478BD642F)
    for j in range(k):
        part = padded[pos + j]
        if total and (left <= j).any():
            part = np.where(left > j, part, U64(0))
        out = mix(out * U64(0xE7037ED1A0B428DB) + part) if j else out + part
    return mix(out), bounds


def distinct_in_text(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and the new bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    if len(h):
        keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(bounds)), side="left")


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
