"""Chunk rows, ids and batch numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.text import chunk_array, chunk_count
from vectide.operators.ordering import rank_documents


def chunk_text(
    documents: DataFrame,
    text: str = "text",
    size: int = 1000,
    overlap: int = 20,
    drop_overlap_tail: bool = False,
) -> DataFrame:
    """One row per chunk: the document's columns, ``chunk`` from 1, ``text``."""
    others = [c for c in documents.columns if c != text]
    # The outer form keeps the optimizer from adding a "not empty" filter that cuts the chunks a second time.
    parts = F.posexplode_outer(chunk_array(F.col(text), size, overlap, drop_overlap_tail))
    exploded = documents.select(*others, parts.alias("_pos", "text")).where(F.col("_pos").isNotNull())
    return exploded.select(*others, (F.col("_pos") + 1).alias("chunk"), "text")


def content_id(key: Column, chunk: Column) -> Column:
    """Id that depends only on document and position: safe to deliver twice."""
    return F.sha2(F.concat_ws(":", key.cast("string"), chunk.cast("string")), 256)


def with_content_ids(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.withColumn("id", content_id(F.col(key), F.col("chunk")))


def dense_starts(documents: DataFrame, key: str, text: str = "text", size: int = 1000, overlap: int = 20) -> DataFrame:
    """First dense chunk id of each document, in key order, from 0."""
    counts = documents.select(key, chunk_count(F.col(text), size, overlap).alias("n_chunks"))
    return rank_documents(counts, key, "n_chunks")


def with_dense_ids(chunks: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Consecutive ids over all chunks, as strings.

    Joins one narrow row per document to its chunks; chunks are never sorted.
    """
    joined = chunks.join(starts.select(key, "first_id"), key)
    return joined.withColumn("id", (F.col("first_id") + F.col("chunk") - 1).cast("string")).drop("first_id")


def batch_rows(chunks: DataFrame, batch_size: int = 500, id_col: str = "id") -> DataFrame:
    """Batch number of each row of a densely numbered table."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    number = F.floor(F.col(id_col).cast("bigint") / F.lit(batch_size)).cast("bigint")
    return chunks.withColumn("batch_id", number)
