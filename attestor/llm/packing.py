"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Only the counts of each length decide how sequences are filled, and there are no more lengths than the sequence
has tokens, so the plan is made on the driver from a histogram of bounded size, whatever the number of rows.
A plan is a list of patterns (lengths and how often). Pieces of one length take the pattern's places by their
rank, which is counted in two levels so that a frequent length isn't ranked in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import table, written
from attestor.llm.encoding import Encoder

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Parts over which the ranks within one length are counted.
RANK_PARTS = 4096


class Remaining:
    """Counts of unpacked pieces by length, with the largest length at or below a bound found by path halving."""

    def __init__(self, counts: dict[int, int], most: int):
        self.count = [0] * (most + 1)
        for length, n in counts.items():
            self.count[length] += n
        self.below = list(range(most + 1))

    def largest(self, bound: int) -> int:
        """The largest length up to bound that is left; 0 if none is."""
        below, count = self.below, self.count
        while bound > 0 and not count[bound]:
            if below[bound] == bound:
                below[bound] = bound - 1
            below[bound] = below[below[bound]]
            bound = below[bound]
        return max(bound, 0)

    def take(self, length: int, n: int = 1) -> None:
        self.count[length] -= n

    def give(self, length: int, n: int = 1) -> None:
        self.count[length] += n
        self.below[length] = length


def best_two(left: Remaining, gap: int, above: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest within gap and above `above`; of equal sums, the one with the longest piece."""
    best, found = above, None
    a = left.largest(gap - 1)
    while a and 2 * a > best:
        left.take(a)
        b = left.largest(min(a, gap - a))
        left.give(a)
        if b and a + b > best:
            best, found = a + b, (a, b)
            if best == gap:
                break
        a = left.largest(a - 1)
    return found


def plan(counts: dict[int, int], most: int = SEQUENCE_TOKENS) -> list[tuple[list[int], int]]:
    """Patterns of lengths and their numbers, which use up the counted pieces.

    Each sequence is filled greedily, the longest piece that fits first; then its smallest piece gives way to two
    unpacked ones that fill the gap it leaves more tightly. The same pattern is repeated as often as pieces last.
    """
    left = Remaining(counts, most)
    out = []
    while longest := left.largest(most):
        taken = [longest]
        left.take(longest)
        room = most - longest
        while room and (n := left.largest(room)):
            taken.append(n)
            left.take(n)
            room -= n
        if room and len(taken) > 1 and (two := best_two(left, room + taken[-1], taken[-1])):
            left.give(taken.pop())
            for n in two:
                left.take(n)
            taken += two
        uses: dict[int, int] = {}
        for n in taken:
            uses[n] = uses.get(n, 0) + 1
        again = min(left.count[n] // k for n, k in uses.items())
        for n, k in uses.items():
            left.take(n, k * again)
        out.append((taken, again + 1))
    return out


def pieces(docs: DataFrame, vocabulary: str, kind: str = "word", most: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and token_ids) of the pieces of each row of docs(doc_id, text).

    A null or empty text is one piece of the end id. Only rows longer than most are cut.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary, kind)
        for batch in batches:
            for lo, hi, ids, at in encoder.encode(batch.column(1)):
                full = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                n = np.diff(at)
                parts = -(-n // most)
                owner = np.repeat(np.arange(hi - lo), parts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * most
                length = np.minimum(n[owner] - start, most)
                raw, begin = memoryview(full.tobytes()), at[owner] + start
                crcs = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, type=pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(full)).astype(np.int32)), pa.array(full.view(np.int32))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", token_ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def _places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) for each place of each pattern."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            first = used.get(n, 0)
            rows.append((n, first, first + times - 1, sequence, offset))
            used[n] = first + times
            offset += n
        sequence += times
    return rows


def packed(cut: DataFrame, most: int = SEQUENCE_TOKENS) -> DataFrame:
    """The rows of pieces(), as written to storage, with sequence_id and offset.

    Every piece is in one sequence, offsets are gapless from 0, no sequence exceeds most. An empty input gives none; pieces
    of null ids and repeated rows are packed like any other.
    """
    spark = cut.sparkSession
    keyed = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_PARTS)).cast("int"))
    counts = written(keyed.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `most` rows
    rows = _places(plan(histogram, most))
    schema = "length bigint, first bigint, last bigint, sequence bigint, offset bigint"
    places = spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], type=pa.int64()) for i in range(5)], names=["length", "first", "last", "sequence", "offset"])) if rows else spark.createDataFrame([], schema)
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("turn", F.row_number().over(inside) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("turn"))
    # The plan's size depends on the sequence length alone: a place for each length of each pattern.
    placed = ranked.join(F.broadcast(places.withColumnRenamed("length", "of_length")), (F.col("length") == F.col("of_length")) & F.col("rank").between(F.col("first"), F.col("last")))
    return placed.select(*cut.columns, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, vocabulary: str, kind: str = "word", most: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text) with their sequences; the pieces are written once to shared storage; other columns are not read."""
    return packed(written(pieces(docs, vocabulary, kind, most, end_id, with_ids), "pieces"), most)


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every row of documents and their places; a null or empty text is one piece, repeated rows repeat.

    A null doc_id is one like any other; other columns are not read; without rows there are no pieces.
    """
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
