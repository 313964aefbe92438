"""A vector index: inverted lists of a trained coarse quantizer, as a partitioned table.

build() fits centroids to a bounded sample, and writes every vector to the partition of its nearest centroid. A search sends
each query to the lists of its nearest centroids: other partitions aren't read. Lists and their queries are cut into tiles,
so that a task holds a bounded matrix of each whatever a list's size, multiplies them and keeps the best. Scores are exact; only
what lies in lists that weren't probed is missed. How many lists are probed is calibrated on the sample; all of them is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.sources.scratch import stored

#: Rows, and numbers in all, that centroids are fitted to and probes calibrated on.
FIT_ROWS, FIT_NUMBERS = 50_000, 16_000_000
#: Lists at most; their table of centroids is broadcast.
MOST_LISTS = 4096
ROUNDS = 12
#: Queries and neighbours that probes are calibrated by, and the share of neighbours to be found there.
TRIAL_QUERIES, TRIAL_NEIGHBOURS, TRIAL_RECALL = 256, 10, 0.97
#: Vectors of a list, and queries of it, that one task compares.
TILE_VECTORS, TILE_QUERIES = 1 << 14, 1 << 12


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column without nulls, in doubles of unit length; zero rows stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def fitted(x: np.ndarray, n_lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means; a list that is left empty takes a vector far from its own."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), n_lists, replace=False)]
    for _ in range(ROUNDS):
        near, score = nearest(x, centroids, 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near[:, 0], x)
        size = np.linalg.norm(sums, axis=1)
        far = np.argsort(score[:, 0], kind="stable")[: int((size == 0).sum())]
        sums[size == 0] = x[far]
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centroids of each row, and their cosines, a block of rows at a time."""
    near, score = np.zeros((len(x), n), dtype=np.int64), np.zeros((len(x), n))
    for lo in range(0, len(x), 4096):
        all_scores = x[lo : lo + 4096] @ centroids.T
        part = np.argpartition(-all_scores, n - 1, axis=1)[:, :n]
        got = np.take_along_axis(all_scores, part, axis=1)
        order = np.argsort(-got, axis=1, kind="stable")
        near[lo : lo + 4096], score[lo : lo + 4096] = np.take_along_axis(part, order, axis=1), np.take_along_axis(got, order, axis=1)
    return near, score


def calibrated(x: np.ndarray, centroids: np.ndarray) -> int:
    """The least number of lists in which the trial's neighbours are found; all but itself of a sampled vector."""
    asked = x[: min(TRIAL_QUERIES, len(x))]
    k = min(TRIAL_NEIGHBOURS, len(x) - 1)
    if k < 1:
        return len(centroids)
    found = np.argpartition(-(asked @ x.T), k, axis=1)[:, : k + 1]
    home = nearest(x, centroids, 1)[0][:, 0]
    order, _ = nearest(asked, centroids, len(centroids))
    turn = np.argsort(order, axis=1)  # of each list, when it is probed
    need = np.sort(np.take_along_axis(turn, home[found], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(TRIAL_RECALL * len(need))) - 1)]) + 1


class VectorIndex:
    """The index in one folder: lists/list=n, centroids and the calibrated number of probes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, n_lists: int | None = None) -> None:
        """Indexes vectors(vec_id, embedding): every row but those without a direction (null, empty, zero) or vec_id.

        ValueError if vectors differ in length. n_lists is by default the root of their number. An empty table gives an empty index.
        """
        rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
        rows = rows.where("vec_id is not null and exists(embedding, x -> x <> 0) and not exists(embedding, x -> x is null)")
        n, least, dim = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if least != dim:
            raise ValueError(f"vectors have from {least} to {dim} numbers")
        if not n:
            centroids, probes = np.zeros((0, 0)), 0
        else:
            most = max(1, min(FIT_ROWS, FIT_NUMBERS // dim))
            drawn = rows.select(F.xxhash64(F.lit(11), "vec_id").alias("draw"), "embedding").orderBy("draw").limit(most).select("embedding").toArrow()
            x = matrix(drawn["embedding"])
            x = x[np.random.default_rng(3).permutation(len(x))]
            centroids = fitted(x, min(len(x), n_lists or min(MOST_LISTS, max(1, round(n**0.5)))))
            probes = calibrated(x, centroids)
        flat = pa.array(centroids.astype(np.float32).ravel())
        table = pa.table({"list": pa.array(np.arange(len(centroids)), type=pa.int32()), "centroid": pa.ListArray.from_arrays(pa.array(np.arange(len(centroids) + 1) * centroids.shape[1], type=pa.int32()), flat), "probes": pa.array([probes] * len(centroids), type=pa.int32())})
        self.spark.createDataFrame(table, "list int, centroid array<float>, probes int").coalesce(1).write.mode("error").parquet(f"{self.path}/centroids")
        shared = self.spark.sparkContext.broadcast(centroids.astype(np.float32).astype(np.float64))
        schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, embedding array<float>, list int"

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near, _ = nearest(matrix(batch.column(1)), shared.value, 1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0].astype(np.int32))], names=["vec_id", "embedding", "list"])

        # rebalanced by list: small lists share tasks, large ones are split
        rows.mapInArrow(place, schema).hint("rebalance", F.col("list")).write.mode("error").partitionBy("list").parquet(f"{self.path}/lists")

    def centroids(self) -> tuple[np.ndarray, int]:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
        return np.array([r.centroid for r in rows], dtype=np.float64), rows[0].probes if rows else 0

    def lists(self) -> DataFrame:
        """vec_id, embedding and list of all vectors."""
        return self.spark.read.parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, rank, vec_id, score (cosine, of six digits) of the k nearest vectors of each of queries(query_id, q).

        probes is by default the calibrated number; that of all lists gives the exact result. Equal scores are in the order of
        vec_id. A query without a direction finds nothing.
        """
        centroids, usual = self.centroids()
        probes = min(len(centroids), usual if probes is None else max(1, probes))
        kinds = [queries.schema["query_id"].dataType.simpleString(), "bigint"]
        if not probes:
            return self.spark.createDataFrame([], f"query_id {kinds[0]}, rank int, vec_id {kinds[1]}, score double")
        shared = self.spark.sparkContext.broadcast(centroids)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near, _ = nearest(matrix(batch.column(1)), shared.value, probes)
                    rows = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                    yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(near.ravel().astype(np.int32))], names=["query_id", "q", "list"])

        asked = queries.select("query_id", F.col("q").cast("array<float>").alias("q")).where(f"exists(q, x -> x <> 0) and not exists(q, x -> x is null) and size(q) = {centroids.shape[1]}")
        asked = stored(asked.mapInArrow(send, f"query_id {kinds[0]}, q array<float>, list int"), "asked")
        per_list = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS at most
        vectors = self.lists().where(F.col("list").isin(sorted(per_list)))  # other partitions aren't read
        kinds[1] = vectors.schema["vec_id"].dataType.simpleString()
        sizes = {r.list: r.n for r in vectors.groupBy("list").agg(F.count("*").alias("n")).collect()}
        cuts = self.spark.createDataFrame([(i, -(-sizes[i] // TILE_VECTORS), -(-per_list[i] // TILE_QUERIES)) for i in sorted(sizes)], "list int, tiles int, turns int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = vectors.join(F.broadcast(cuts), "list").select("vec_id", "embedding", F.col("list").alias("in_list"), F.pmod(F.xxhash64("vec_id"), "tiles").cast("int").alias("in_tile"), every("turns").alias("in_turn"))
        right = asked.join(F.broadcast(cuts), "list").select("query_id", "q", "list", every("tiles").alias("tile"), F.pmod(F.xxhash64("query_id"), "turns").cast("int").alias("turn"))

        def compare(vectors: pa.Table, queries: pa.Table) -> pa.Table:
            found = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
            x = matrix(vectors["embedding"]) if len(vectors) else None
            for lo in range(0, len(queries) if len(vectors) else 0, 256):
                scores = np.round(matrix(queries["q"].slice(lo, 256)) @ x.T, 6)
                # all that reach the k-th best, ties too
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -2.0)
                at, row = np.nonzero(scores >= least[:, None])
                found.append((at + lo, row, scores[at, row]))
            at, row, score = (np.concatenate(p) for p in zip(*found, strict=True))
            return pa.table({"query_id": queries["query_id"].take(pa.array(at)), "vec_id": vectors["vec_id"].take(pa.array(row)), "score": pa.array(score)})

        scored = left.groupBy("in_list", "in_tile", "in_turn").cogroup(right.groupBy("list", "tile", "turn")).applyInArrow(compare, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
