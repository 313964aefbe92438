"""Token ids as ORC: run-length encoded integers in stripes, with row indexes and Bloom filters on document ids.

write_tokens() range-partitions documents by id, encodes them, sorts each range and writes one ORC file per
range. ORC's integer run-length encoding packs the ids, its row index and the Bloom filter on `doc_id` let a
reader skip files, stripes and row groups, and splits fall on stripe borders, so stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import lists, scratch, table
from attestor.llm.encoding import Encoder

END_ID = 2
STRIPE_BYTES = 32 << 20
ROW_GROUP = 1000
#: Bytes of text of a range, which a task sorts and a file holds, and the first rows whose mean size tells how many ranges
#: that makes. Only the number of ranges follows from these rows.
RANGE_BYTES, SIZED_ROWS = 256 << 20, 2000
BLOOM_FPP = 0.01
FILE_SCHEMA = "doc_id bigint, text_hash bigint, n_tokens bigint, token_ids array<int>"


def tokenized(docs: DataFrame, path: str, kind: str = "byte", end_id: int = END_ID) -> DataFrame:
    """doc_id, text_hash, n_tokens, token_ids of each row of docs(doc_id, text), with end_id appended.

    A null or empty text gives the end id alone; repeated rows stay repeated; a null doc_id stays null.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, kind)
        for batch in batches:
            for lo, hi, ids, at in encoder.encode(batch.column(2)):
                full = np.insert(ids, at[1:], end_id).astype(np.int32)
                bounds = at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(np.diff(bounds)), lists(full, bounds, pa.int32())], names=["doc_id", "text_hash", "n_tokens", "token_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text"), "text").mapInArrow(encode, FILE_SCHEMA)


def write_tokens(docs: DataFrame, vocabulary: str, out: str, kind: str = "byte", end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES, row_group: int = ROW_GROUP) -> None:
    """Writes docs(doc_id, text) to the folder out, in ascending doc_id order over files and within them.

    Nulls in doc_id come first; rows of equal doc_id are ordered by text_hash, a hash of their text, so that a doc_id which
    many rows share is spread over files too.
    """
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    sizes = [r[0] or 0 for r in ranged.select(F.octet_length("text")).take(SIZED_ROWS)]
    held = docs.count() * sum(sizes) / max(1, len(sizes))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(held / RANGE_BYTES))
    ranged = ranged.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    writer = tokenized(ranged, vocabulary, kind, end_id).write.mode("error")
    options = {"orc.compress": "ZSTD", "orc.stripe.size": stripe_bytes, "orc.create.index": "true", "orc.row.index.stride": row_group, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP}
    writer.options(**{k: str(v) for k, v in options.items()}).orc(out)


def read_tokens(spark: SparkSession, out: str, where: Column | None = None) -> DataFrame:
    """The stored rows; where is pushed to ORC's file, stripe and row-group statistics and Bloom filters."""
    rows = spark.read.schema(FILE_SCHEMA).orc(out)
    return rows if where is None else rows.where(where)


def with_starts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds start, the number of ids in all documents before, to rows of checksums(stored).

    File totals come from narrow columns alone; files hold disjoint ascending ranges, so one row a file places them and
    running sums stay within files. The order is the files' own: doc_id, then text_hash; rows equal in both have equal ids.
    """
    place = F.struct("doc_id", "text_hash")  # nulls come first, as in the files
    totals = stored.groupBy(F.col("_metadata.file_name").alias("of_file")).agg(F.min(place).alias("least"), F.max(place).alias("most"), F.sum("n_tokens").alias("ids"))
    ahead = Window.orderBy("least", "most", "of_file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("of_file", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy(F.asc_nulls_first("doc_id"), "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return summed.join(totals, F.col("file") == F.col("of_file")).withColumn("start", F.col("before") + F.col("within")).drop("of_file", "before", "within")


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_tokens, ids_crc32 and the file of each stored row."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            raw = memoryview(flat.tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, type=pa.int64()), batch.column(3)], names=["doc_id", "text_hash", "n_tokens", "ids_crc32", "file"])

    read = stored.select("doc_id", "text_hash", "token_ids", F.col("_metadata.file_name").alias("file"))
    return read.mapInArrow(sums, "doc_id bigint, text_hash bigint, n_tokens bigint, ids_crc32 bigint, file string")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of documents, from its ORC files read back.

    A null or empty text is the end id alone; null ids come first, rows of one id in the order of text_hash.
    Other columns are not read; without rows there is nothing.
    """
    import public_tokenizers

    out = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    stored = read_tokens(spark, out)
    return with_starts(checksums(stored), stored).select("doc_id", "start", "n_tokens", "ids_crc32")
