"""A chunk store: chunks of documents, their inverted index and statistics, replaced by document, in one snapshot table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import retrieval
from attestor.sources.snapshots import SnapshotTable
from attestor.sources.vectors import VectorIndex

#: The store's parts: chunks; blocks of postings; statistics of documents.
PARTS = {
    "chunks": "doc_id string, idx int, text string, parent string, chunk_id string, embedding array<float>",
    "postings": f"doc_id string, {retrieval.KINDS['postings']}",
    "documents": f"doc_id string, {retrieval.KINDS['documents']}",
}


class ChunkStore:
    """Chunks of documents in a folder. A write replaces the chunks of the documents written, and what follows from them.

    A write appends files and never changes one: it costs as much as the documents written. It is there as a whole or not at
    all, for all parts. Postings, document frequencies and mean lengths are those of a document, so a write of some documents
    leaves those of all others as they are, and they equal what a rebuild would give.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, SnapshotTable(spark, path, PARTS)

    def read(self, version: int | None = None) -> DataFrame:
        """All chunks; none if nothing was ever written."""
        return self.table.read("chunks", version)

    def upsert(self, chunks: DataFrame) -> int | None:
        """Replaces all chunks of the documents in chunks(doc_id, idx, text, parent, chunk_id and perhaps embedding); nothing if it is empty.

        The chunks are made and written once, and indexed from there. Gives the new version.
        """
        vector = F.col("embedding").cast("array<float>") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
        rows = chunks.select("doc_id", "idx", "text", "parent", "chunk_id", vector.alias("embedding"))
        index = {kind: lambda written, kind=kind: retrieval.index_rows(written("chunks"), kind) for kind in ("postings", "documents")}
        return self.table.commit({"chunks": rows, **index}, "chunks")

    def delete(self, doc_ids: DataFrame) -> int:
        """Ends the chunks of doc_ids(doc_id)."""
        return self.table.commit(ended=doc_ids.select("doc_id"))

    def of_document(self, doc_id: str) -> DataFrame:
        """Chunks of one document: statistics and Bloom filters skip what doesn't hold it."""
        return self.read().where(F.col("doc_id") == doc_id)

    def index(self, docs: DataFrame, version: int | None = None) -> retrieval.Index:
        """The stored inverted index of the documents of docs(doc_id): nothing is split or counted again."""
        ids = docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        part = lambda name: self.table.read(name, version).join(ids, "doc_id", "left_semi")
        return retrieval.Index(part("postings"), part("documents"), rows=part("chunks").select("doc_id", "idx", "text", "parent", "embedding"))

    def build_vectors(self, n_lists: int | None = None) -> None:
        """Indexes the embeddings of the latest version, for searches of it that needn't be exact."""
        version = self.table.versions()[-1]
        VectorIndex(self.spark, f"{self.table.path}/vectors/{version:08d}").build(self.read(version).select(F.col("chunk_id").alias("vec_id"), "embedding"), n_lists)

    def search(self, vector: Sequence[float], top_k: int = 4, doc_id: str | None = None, exact: bool = True, probes: int | None = None, digits: int | None = None) -> DataFrame:
        """doc_id, idx, text, parent, score of the top_k stored chunks by cosine with vector, of one document if doc_id is given.

        An exact search scans all chunks, or the document's; each task keeps its own best top_k. Equal scores are in the order
        of document and place; chunks without an embedding aren't found. Scores have 6 digits; with `digits` they are rounded
        once more before they are ordered, so that more of them are equal. exact=False reads only the lists nearest to vector of
        an index that build_vectors() has made of this version; without one, for one document or with digits, the search is exact.
        """
        version = (self.table.versions() or [0])[-1]
        path = f"{self.table.path}/vectors/{version:08d}"
        if not exact and doc_id is None and digits is None and self.table.exists(f"{path}/lists"):
            asked = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, q array<float>")
            near = VectorIndex(self.spark, path).search(asked, top_k, probes).select(F.col("vec_id").alias("chunk_id"), "score")
            rows = self.read(version).join(F.broadcast(near), "chunk_id")  # top_k rows
            return rows.select("doc_id", "idx", "text", "parent", "score").orderBy(F.desc("score"), "doc_id", "idx").limit(top_k)
        rows = self.read() if doc_id is None else self.of_document(doc_id)
        asked = F.array(*[F.lit(float(x)) for x in vector])
        score = retrieval.rounded(retrieval.cosine(F.col("embedding"), asked), 6)
        if digits is not None:
            score = retrieval.rounded(score, digits)
        return rows.where("embedding is not null").select("doc_id", "idx", "text", "parent", score.alias("score")).orderBy(F.desc("score"), "doc_id", "idx").limit(top_k)

    def missing(self, docs: DataFrame) -> DataFrame:
        """Rows of docs(doc_id, ...) whose chunks aren't stored yet; ids that name the content make this a cache."""
        return docs.join(self.table.read("documents").select("doc_id"), "doc_id", "left_anti")

    def documents(self) -> DataFrame:
        return self.table.read("documents").select("doc_id")

    def count(self) -> int:
        return self.table.read("documents").agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0]
