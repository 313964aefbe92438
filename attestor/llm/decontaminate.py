"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Items are partitioned by the size of their shingle set. Each partition has a bottom-m MinHash sample per item,
with m the least for which an item of the partition that a document contains to the threshold is missed with
a chance below MISS. A document is a candidate for an item if it holds one of the sampled shingles and is large
enough for the partition, so a short item is found in a document of any length. Candidates are verified by
comparing the words of all shingles of the item. Items of fewer words than a shingle are one shingle of their own
length, and are looked up among the documents' shingles of that length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import U64, chunked, discard, shingle_hashes, table, word_hashes, written

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
MISS = 1e-9
#: Items are taken in blocks of at most so many rows and bytes of text, which are broadcast; each block is one pass over the
#: documents, and what a pass found is written before the next, so that one Python process a task runs at a time.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 32 << 20
#: Items whose shingles a worker keeps parsed.
PARSED = 4096

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def text_shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """Distinct k-word shingles; the whole sequence where there are fewer words; empty without words."""
    w = _WORD.findall(text.translate(_TO_LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def sample_size(size: int, percent: int) -> int:
    """The least bottom-m sample of a set of this size that hits a set holding percent of it, but for a chance of MISS."""
    absent = size - -(-size * percent // 100)
    return next(m for m in range(1, size + 1) if comb(absent, m) <= MISS * comb(size, m))


@dataclass
class Samples:
    """Sampled shingles of the items of one shingle length, sorted by hash, and what the document must hold."""

    keys: np.ndarray
    items: np.ndarray
    needs: np.ndarray
    seen: np.ndarray

    @staticmethod
    def of(sets: list[tuple[int, np.ndarray]], percent: int) -> Samples:
        """Of (item, its distinct hashes)."""
        keys, owners, needs = [], [], []
        for j, own in sets:
            low, high = 1 << (len(own).bit_length() - 1), 2 << (len(own).bit_length() - 1)
            m = min(len(own), max(sample_size(n, percent) for n in {low, len(own), high - 1}))
            keys.append(own[:m])
            owners.append(np.full(m, j))
            needs.append(np.full(m, -(-low * percent // 100)))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << 20, dtype=bool)
        seen[(key >> U64(44)).astype(np.int64)] = True
        return Samples(key[order], np.concatenate(owners)[order], np.concatenate(needs)[order], seen)

    def candidates(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, set[int]]]:
        """(text, items) of the texts that hold a sample and enough shingles."""
        maybe = np.flatnonzero(self.seen[(h >> U64(44)).astype(np.int64)])
        first, last = (np.searchsorted(self.keys, h[maybe], side=s) for s in ("left", "right"))
        hit = last > first
        rows = np.searchsorted(at, maybe[hit], side="right") - 1
        found: dict[int, set[int]] = defaultdict(set)
        for row, a, b in zip(rows.tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
            room = at[row + 1] - at[row]
            found[row].update(self.items[j] for j in range(a, b) if self.needs[j] <= room)
        yield from found.items()


class Index:
    """A block of items: samples by shingle length, and the items' texts."""

    def __init__(self, items: list[tuple[int, str | None]], k: int, percent: int):
        self.ids, self.texts, self.percent = [i for i, _ in items], [(t or "").encode() for _, t in items], percent
        buf = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        h, at = word_hashes(buf, offs) if len(buf) else (np.zeros(0, dtype=U64), offs * 0)
        self.lengths = np.minimum(np.diff(at), k)
        self.samples: dict[int, Samples] = {}
        for n in sorted(set(self.lengths.tolist()) - {0}):
            shingles, bounds = shingle_hashes(h, at, n)
            self.samples[n] = Samples.of([(j, np.unique(shingles[bounds[j] : bounds[j + 1]])) for j in np.flatnonzero(self.lengths == n).tolist()], percent)

    def _shingles(self, item: int, parsed: dict[int, set[tuple[bytes, ...]]]) -> set[tuple[bytes, ...]]:
        if item not in parsed:
            if len(parsed) >= PARSED:
                parsed.clear()
            parsed[item] = text_shingles(self.texts[item], int(self.lengths[item]))
        return parsed[item]

    def matches(self, text: pa.Array, parsed: dict[int, set[tuple[bytes, ...]]]) -> Iterator[tuple[int, list[int]]]:
        """(row, ids of the items that its text contains), for rows that have any. parsed is kept from call to call."""
        for lo, _, buf, offs in chunked(text):
            if not self.samples or not len(buf):
                continue
            h, at = word_hashes(buf, offs)
            rows: dict[int, set[int]] = defaultdict(set)
            for n, samples in self.samples.items():
                for row, items in samples.candidates(*shingle_hashes(h, at, n)):
                    own = text_shingles(buf[offs[row] : offs[row + 1]].tobytes(), n)
                    for j in items:
                        wanted = self._shingles(j, parsed)
                        if 100 * len(wanted & own) >= self.percent * len(wanted):
                            rows[row].add(self.ids[j])
            for row, found in rows.items():
                yield lo + row, sorted(found)


def blocks(benchmark: DataFrame, k: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT, block_items: int = BLOCK_ITEMS) -> Iterator[Index]:
    """Indexes of all items of benchmark(item_id, text), block by block; rows without item_id are left out."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-n // block_items), -(-(size or 0) // BLOCK_BYTES))
    for i in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else items
        yield Index([(r.item_id, r.text) for r in rows.collect()], k, percent)


def _passes(docs: DataFrame, indexes: Iterator[Index], once: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """docs after a pass for each index; all but the last are written."""
    before = None
    for index in indexes:
        if before is not None:
            held, docs = docs, written(before, "pass")
            discard(held)
        before = once(docs, docs.sparkSession.sparkContext.broadcast(index))
    return before


def contained(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id and items, the sorted distinct ids of the items of whose shingles it holds percent or more, of each row of docs.

    Each row has a row of its own, whatever its doc_id: null ids and repeated rows are judged by their own texts. Null and
    empty texts, and items without words, match nothing; an item of fewer than k words matches where all its words follow
    one another. Without items, or without rows, there is nothing to find.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.array().cast("array<bigint>").alias("items"))

    def once(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parsed: dict[int, set[tuple[bytes, ...]]] = {}
            for batch in batches:
                items = batch.column(2).to_pylist()
                for row, found in shared.value.matches(batch.column(1), parsed):
                    items[row] = sorted({*items[row], *found})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, type=pa.list_(pa.int64()))], names=["doc_id", "text", "items"])

        return rows.mapInArrow(search, "doc_id bigint, text string, items array<bigint>")

    return _passes(docs, blocks(benchmark, k, percent, block_items), once).select("doc_id", "items")


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id of each pair that contained() finds, once."""
    return contained(docs, benchmark, k, percent, block_items).select("doc_id", F.explode("items").alias("item_id")).distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs, with all columns, whose text contains no item; each block filters what the one before kept.

    Rows are judged by their own texts, as in contained(): null and empty texts stay, repeated rows go or stay together.
    Columns beside doc_id and text may have any names.
    """
    at = docs.columns.index("text")

    def once(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parsed: dict[int, set[tuple[bytes, ...]]] = {}
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[row for row, _ in shared.value.matches(batch.column(at), parsed)]] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(keep, rows.schema)

    return _passes(docs, blocks(benchmark, k, percent, block_items), once)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_items, item_ids and leaked of every row of documents, each judged by its own text, as contained() has it.

    Null and empty texts contain nothing; other columns are not read; without rows there is nothing, without items no leak.
    """
    rows = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("item_ids"), (F.size("items") > 0).alias("leaked"))


#: The same by joining all shingles of all documents with those of the items, and all runs of a short item's length with it.
OP6_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT side, id, w, unnest(range(1, len(w) - 4 + 1)) AS i FROM w WHERE len(w) >= 5)
), sizes AS (SELECT id, count(*) AS n FROM s WHERE side = 'b' GROUP BY id),
hits AS (
  SELECT d.id AS doc_id, b.id AS item_id
  FROM s d JOIN s b ON d.side = 'd' AND b.side = 'b' AND d.g = b.g JOIN sizes z ON z.id = b.id
  GROUP BY d.id, b.id, z.n HAVING 100 * count(*) >= 80 * z.n
), short AS (SELECT id, len(w) AS n, w FROM w WHERE side = 'b' AND len(w) BETWEEN 1 AND 4),
runs AS (SELECT id, n, w[i : i + n - 1] AS w FROM (SELECT w.id, w.w, k.n, unnest(range(1, len(w.w) - k.n + 2)) AS i FROM w JOIN (SELECT DISTINCT n FROM short) k ON w.side = 'd' AND len(w.w) >= k.n)),
all_hits AS (SELECT doc_id, item_id FROM hits UNION SELECT r.id, s.id FROM runs r JOIN short s ON r.n = s.n AND r.w = s.w),
per AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM all_hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_items, coalesce(p.items, '') AS item_ids, p.n IS NOT NULL AS leaked
FROM documents d LEFT JOIN per p ON p.doc_id = d.doc_id
"""
