"""Shuffled shards by a two-pass external shuffle, in DataFrame operations only.

A survey of hashes and sizes says which shard each group of equal texts goes to, so that shards are of nearly equal bytes and
a group is split only if no shard has room for it. Pass one scatters the records of a shard over its buckets of bounded
size by a seeded hash. Pass two puts a bucket, which is one partition, in order of that hash and permutes it by Spark's
shuffle(), an inside-out Fisher-Yates of a generator seeded by seed and bucket; the buckets of a shard one after another are
its slots. So all places follow from the seed and the records, however these are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestor.llm.common import discard, scratch, table, written

#: Bytes of a bucket, which a task holds in memory, and how many buckets a shard has at least and all have at most: beyond 12 TB
#: they grow with the input (500 MB at 100 TB), so that neither the shuffle's blocks nor the table of bucket starts do.
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS, MOST_BUCKETS = 8, 200_000
SEED = 20_240_611
#: Groups of more than a BIG_GROUPS-th of all bytes are placed one by one, so they are fewer than that; all others by RANGES of
#: their hash. A split group is cut into PARTS by its records' hashes.
BIG_GROUPS, RANGES, PARTS = 20_000, 1 << 14, 1 << 20
#: Equal records of more than a REPEATED-th of all rows, and of at least this many, are numbered, so that they spread over buckets.
REPEATED, LEAST_REPEATED = 100_000, 10_000


@dataclass(frozen=True)
class Layout:
    """Where records go: groups (a group's hash, the parts of its records, their shard), the first range of each later shard, the
    records that are numbered, and how many buckets a shard has."""

    groups: DataFrame
    cuts: list[int]
    repeated: DataFrame
    n_shards: int
    per_shard: int
    seed: int


def surveyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """of_group (a hash of the text), draw and tie (hashes of the record), size (UTF-8 bytes of the text plus 1) and bytes (of the
    whole record) of each row of docs, which has the record in `record`."""
    whole = [F.col("record")[c] for c in docs.schema["record"].dataType.names]
    text = F.col("record.text")
    others = (F.coalesce(F.octet_length(F.col("record")[c].cast("string")), F.lit(0)) for c in docs.schema["record"].dataType.names if c not in ("doc_id", "text"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    names = {"of_group": F.xxhash64(F.lit(seed), text), "draw": F.xxhash64(F.lit(seed), *whole), "tie": F.xxhash64(F.lit(seed + 1), *whole), "size": size, "bytes": _total([size, *others])}
    return docs.withColumns(names)


def _total(parts: list[Column]) -> Column:
    """The sum of parts, as a tree of little depth: a table may have hundreds of columns, and as many shards be asked for."""
    half = len(parts) // 2
    return parts[0] if half == 0 else _total(parts[:half]) + _total(parts[half:])


def layout(docs: DataFrame, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[Layout, DataFrame]:
    """The layout of docs(record), and the survey that it follows from: counts of equal hashes, as written."""
    spark = docs.sparkSession
    survey = written(surveyed(docs, seed).groupBy("of_group", "draw", "tie", "size", "bytes").agg(F.count("*").alias("n")), "survey")
    total, stored, rows = (x or 0 for x in survey.agg(F.sum(F.col("size") * F.col("n")), F.sum(F.col("bytes") * F.col("n")), F.sum("n")).first())
    repeated = survey.groupBy("draw").agg(F.sum("n").alias("n")).where(F.col("n") > max(LEAST_REPEATED, rows // REPEATED)).select("draw")
    repeated = written(repeated, "repeated")  # at most REPEATED rows
    sizes = survey.groupBy("of_group").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
    big = {r.of_group: r.size for r in sizes.where(F.col("size") * BIG_GROUPS > total).collect()}  # at most BIG_GROUPS
    groups, room = _big_groups(big, total, n_shards)
    groups = spark.createDataFrame(groups, "of_group long, low int, high int, shard int")
    small = sizes.where(F.col("size") * BIG_GROUPS <= total).groupBy(_range().alias("of_range")).agg(F.sum("size").alias("size"))
    cuts = _cuts({r.of_range: r.size for r in small.collect()}, room)
    per_shard = min(MOST_BUCKETS // n_shards, max(LEAST_BUCKETS, -(-stored // (n_shards * bucket_bytes))))
    return Layout(groups, cuts, repeated, n_shards, per_shard, seed), survey


def _range():
    return F.pmod(F.xxhash64(F.col("of_group")), F.lit(RANGES)).cast("int")


def _big_groups(sizes: dict[int, int], total: int, n_shards: int) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """(group, first part, end part, shard), the largest groups first to the emptiest shard, and what room is then left.

    A group that is larger than any shard's room fills up as many as it takes.
    """
    room = [total / n_shards] * n_shards
    placed = []
    for group, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        low, left = 0, float(size)
        while low < PARTS:
            k = max(range(n_shards), key=lambda i: (room[i], -i))
            # what is over by a ten-thousandth of a shard isn't worth a split
            take = left if left <= room[k] + total / n_shards / 10_000 else room[k]
            high = PARTS if take >= left else min(PARTS, low + max(1, round(PARTS * take / size)))
            placed.append((group, low, high, k))
            room[k] -= take
            low, left = high, left - take
    return placed, room


def _cuts(sizes: dict[int, int], room: list[float]) -> list[int]:
    """The first range of each shard but the first: ranges in order fill up what room the shards have."""
    free = [max(0.0, r) for r in room]
    scale = sum(sizes.values()) / (sum(free) or 1.0)
    left, cuts = free[0] * scale, []
    for k in range(RANGES):
        size = sizes.get(k, 0)
        while len(cuts) < len(free) - 1 and left < size / 2:
            cuts.append(k)
            left += free[len(cuts)] * scale
        left -= size
    return cuts + [RANGES] * (len(free) - 1 - len(cuts))


def scattered(rows: DataFrame, to: Layout) -> DataFrame:
    """Adds shard, bucket and draw to rows of surveyed(); equal records in great numbers need a number `copy` each (null: none)."""
    part = F.pmod(F.xxhash64(F.lit(to.seed + 2), "draw", "copy"), F.lit(PARTS)).cast("int")
    cut = F.broadcast(to.groups.withColumnRenamed("shard", "own_shard").withColumnRenamed("of_group", "in_group"))
    rows = rows.withColumns({"part": part, "of_range": _range()})
    rows = rows.join(cut, (F.col("of_group") == F.col("in_group")) & (F.col("part") >= F.col("low")) & (F.col("part") < F.col("high")), "left")
    by_range = _total([F.lit(0), *(F.when(F.col("of_range") >= c, 1).otherwise(0) for c in to.cuts)])
    rows = rows.withColumn("shard", F.coalesce("own_shard", by_range))
    draw = F.when(F.col("copy").isNull(), F.col("draw")).otherwise(F.xxhash64("draw", "copy"))
    rows = rows.withColumn("draw", draw).withColumn("bucket", F.col("shard") * to.per_shard + F.pmod(F.xxhash64(F.lit(to.seed + 3), "draw"), F.lit(to.per_shard)).cast("int"))
    return rows.drop("part", "of_range", "in_group", "low", "high", "own_shard")


def numbered(docs: DataFrame, to: Layout) -> DataFrame:
    """surveyed(docs) with copy: null but for equal records in great numbers, which are counted and dealt out anew."""
    rows = surveyed(docs, to.seed)
    if to.repeated.isEmpty():
        return rows.withColumn("copy", F.lit(None).cast("long"))
    often = F.broadcast(to.repeated)
    once = rows.join(often, "draw", "left_anti").withColumn("copy", F.lit(None).cast("long"))
    counted = rows.join(often, "draw", "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("n"))
    return once.unionByName(counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"))


def bucket_starts(survey: DataFrame, to: Layout) -> DataFrame:
    """bucket and before, the rows of its shard in earlier buckets."""
    often = F.broadcast(to.repeated)
    one = F.lit(None).cast("long")
    rows = survey.join(often, "draw", "left_anti").withColumn("copy", one)
    more = survey.join(often, "draw", "left_semi").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("n", F.lit(1).cast("long"))
    counts = scattered(rows.unionByName(more), to).groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))


def shuffled(docs: DataFrame, to: Layout) -> DataFrame:
    """bucket, turn, record and size of docs(record): turn is the record's place in its bucket after Fisher-Yates."""
    rows = scattered(numbered(docs, to), to).select("bucket", F.struct("draw", "tie", "size", "record").alias("row"))
    order = lambda a, b: F.when(a["draw"] < b["draw"], -1).when(a["draw"] > b["draw"], 1).when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0)
    # a partition is one bucket, so the generator, which is seeded by seed and partition, starts with it
    per = rows.repartitionById(to.n_shards * to.per_shard, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list("row"), order).alias("rows"))
    per = per.select("bucket", F.posexplode(F.shuffle("rows", to.seed)).alias("turn", "row"))
    return per.select("bucket", "turn", F.col("row.record").alias("record"), F.col("row.size").alias("size"))


def records(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text and any others) as rows of one struct, `record`, so that its columns may have any names."""
    typed = {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}
    return docs.select(F.struct(*[typed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]).alias("record"))


def write_shards(docs: DataFrame, out: str, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes docs(doc_id, text and any others) as record (all columns, whatever their names), size, slot and shard to Parquet
    folders out/shard=k.

    Shards are of nearly equal size (bytes of text plus 1 a row), equal texts are in one shard unless they exceed its room,
    slots are gapless from 0; an empty table writes no rows. Null ids and texts, and repeated rows, are rows like any other.
    """
    docs = records(docs)
    to, survey = layout(docs, n_shards, seed, bucket_bytes)
    starts = written(bucket_starts(survey, to), "starts")  # one row a bucket, MOST_BUCKETS at most
    rows = shuffled(docs, to).join(F.broadcast(starts), "bucket")
    rows = rows.select("record", "size", (F.col("before") + F.col("turn")).cast("long").alias("slot"), F.floor(F.col("bucket") / to.per_shard).cast("int").alias("shard"))
    rows.write.mode("error").partitionBy("shard").parquet(out)
    discard(survey, starts, to.repeated)


def read_shards(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """record (of the schema of the docs written), size, slot and shard of all rows."""
    return spark.read.schema(StructType().add("record", schema).add("size", "long").add("slot", "long").add("shard", "integer")).parquet(out)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of documents, read back from the shards.

    Rows with null ids or texts, and repeated rows, are rows like any other; all other columns go into the shards, whatever their
    number and names.
    """
    out, docs = scratch(spark, "shards"), table(spark, sf_dir, "documents")
    write_shards(docs, out)
    return read_shards(spark, out, records(docs).schema["record"].dataType).select(
        "record.doc_id",
        "size",
        F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
