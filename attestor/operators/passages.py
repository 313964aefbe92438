"""Relations of sentences, chunks and claims. All are made within the row, so none needs a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions.rows import exploded, once


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, sentence of each kept sentence of docs(key, text)."""
    return exploded(docs, [key], T.sentences(F.col("text")), "sentence", "pos")


def paragraphs(docs: DataFrame, size: int = T.PARAGRAPH_SENTENCES) -> DataFrame:
    """doc_id, para_id, parent of each paragraph."""
    found = once(docs, ["doc_id"], found=T.sentences(F.col("text")))
    return exploded(found, ["doc_id"], T.paragraphs(F.col("found"), size), "group", "para_id").select("doc_id", "para_id", F.array_join("group", " ").alias("parent"))


def chunks(docs: DataFrame, window: int = T.WINDOW, overlap: int = T.OVERLAP, size: int = T.PARAGRAPH_SENTENCES) -> DataFrame:
    """doc_id, idx, text, parent, chunk_id of each chunk of docs(doc_id, text)."""
    found = once(docs, ["doc_id"], found=T.sentences(F.col("text")))
    rows = exploded(found, ["doc_id"], T.chunks(F.col("found"), window, overlap, size), "chunk", "idx")
    return rows.select("doc_id", "idx", "chunk.text", "chunk.parent", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("idx").cast("string")).alias("chunk_id"))


def chunk_lists(docs: DataFrame) -> DataFrame:
    """doc_id, chunks (text and parent, by position) of the rows of docs(doc_id, text) that have any."""
    found = once(docs, ["doc_id"], found=T.sentences(F.col("text")))
    return once(found, ["doc_id"], chunks=T.chunks(F.col("found"))).where(F.size("chunks") > 0)


def claims(responses: DataFrame, limit: int | None = T.CLAIM_LIMIT) -> DataFrame:
    """response_id, doc_id, claim_no, claim of the claims of responses(response_id, doc_id, text)."""
    return exploded(responses, ["response_id", "doc_id"], T.claims(F.col("text"), limit), "claim", "claim_no").select("response_id", "doc_id", "claim_no", "claim")


def responses(conversations: DataFrame) -> DataFrame:
    """The assistant's turns of conversations, each paired with the document of the conversation's number."""
    said = conversations.where(F.col("role") == "assistant")
    return said.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response_id"), F.col("conv_id").alias("doc_id"), "text")


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, text of pages(doc_id, page, text) that have lines to keep."""
    out = pages.select("doc_id", "page", F.array_join(T.page_lines(F.col("text")), " ").alias("text"))
    return out.where("text <> ''")


def page_texts(pages: DataFrame) -> DataFrame:
    """doc_id and the joined text of its cleaned pages, in page order."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    return cleaned_pages(pages).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
