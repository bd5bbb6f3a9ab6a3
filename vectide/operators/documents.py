"""Document-level operators: assembly, limits, quarantine and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.text import clean_text, date_prefix, digest_of, size_as_string
from vectide.operators.ordering import first_ranked, rank_documents
from vectide.session import materialize

# Why a document did not become chunks.
NO_TEXT = "no_text"
NO_METADATA = "no_metadata"
QUARANTINED = "quarantined"
EXTRACT_FAILED = "extract_failed"
EMPTIED = "empty_after_cleaning"


def assemble_pages(pages: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """One row per document: page texts joined in page order, nothing between them.

    A document's pages end up in one row by definition of the result, so the
    group is as large as the text asked for and no larger.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda p: p["t"]), "")
    return pages.groupBy(key).agg(joined.alias(text))


def limit_documents(documents: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """First ``n`` documents by key; ``None`` and ``0`` mean all of them.

    Keys are ranked in parallel with their numbers of rows; at most one key
    has rows on both sides of the limit, and of its rows those with the least
    hashes are taken. Rows without a key come last and only fill up.
    """
    if not n:
        return documents
    counts = documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_documents(counts, key, "_n").where(F.col("first_id") < n)
    ranked = materialize(ranked.select(F.col(key).alias("_key"), "first_id", "_n"), "ranked")
    whole = ranked.where(F.col("first_id") + F.col("_n") <= n)
    chosen = documents.join(whole, documents[key] == F.col("_key"), "left_semi")
    edge = ranked.where(F.col("first_id") + F.col("_n") > n).first()
    order = [F.xxhash64(*documents.columns)]
    if edge is not None:
        at_edge = documents.where(F.col(key) == F.lit(edge["_key"]))
        return chosen.unionByName(first_ranked(at_edge, [key], order, n - edge["first_id"]))
    left = n - (ranked.agg(F.sum("_n")).first()[0] or 0)
    return chosen.unionByName(first_ranked(documents.where(F.col(key).isNull()), [key], order, left)) if left else chosen


def split_empty(documents: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with text, and rejects for those whose raw text has length zero."""
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    return documents.where(~empty), reject(documents.where(empty), key, NO_TEXT)


def emptied(documents: DataFrame, key: str, newline: str = "", text: str = "text") -> DataFrame:
    """Rejects for documents with text of which cleaning leaves nothing.

    Only spaces, line breaks, tabs, marks such as ``(cid:7)`` and what hyphens
    break them into can go, so only texts of those characters are cleaned here.
    """
    can_vanish = F.col(text).rlike(r"\A[ \n\t\-(cid:)\p{Nd}]+\z")
    nothing = documents.where(can_vanish).where(F.length(clean_text(F.col(text), newline)) == 0)
    return reject(nothing, key, EMPTIED)


def reject(documents: DataFrame, key: str, reason: str | Column) -> DataFrame:
    reason = reason if isinstance(reason, Column) else F.lit(reason)
    return documents.select(F.col(key), reason.alias("reason"))


def remove_quarantined(documents: DataFrame, quarantine: DataFrame, key: str) -> DataFrame:
    """Documents that are not on the quarantine list; no source file is touched."""
    return documents.join(quarantine.select(key).distinct(), key, "left_anti")


def first_sidecar_rows(sidecar: DataFrame, position: str = "pos", free: tuple[str, ...] = ()) -> DataFrame:
    """First sidecar row of each digest in file order.

    The rank filter is pushed below the shuffle (``WindowGroupLimit``), so a
    digest that repeats a billion times sends one row per task.
    """
    return first_ranked(sidecar, ["digest"], [F.col(position).asc(), F.xxhash64("file_size", "date", *[f"`{c}`" for c in free]).asc()])


def attach_metadata(
    documents: DataFrame,
    sidecar: DataFrame,
    key: str,
    filename: str = "filename",
    directory: str = "data",
    strict: bool = False,
    position: str = "pos",
    unique: bool = False,
    free: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Add ``size`` and ``created_at``; documents without a sidecar row are rejected.

    The sidecar's columns in ``free`` become ``extra``, one JSON text of those
    that are not null.

    No broadcast is forced: Spark broadcasts the sidecar only while its
    measured size allows it and otherwise shuffles, splitting skewed digests.
    The first rows are written before the join, because Spark splits a skewed
    key only between two plain shuffles; ``unique`` says that the sidecar has
    one row per digest already. The rejects come from a second, narrow plan
    that never reads the text.
    """
    first = sidecar if unique else materialize(first_sidecar_rows(sidecar, position, free), "sidecar")
    described = first.select(
        F.col("digest").alias("_digest"),
        size_as_string(F.col("file_size")).alias("size"),
        date_prefix(F.col("date")).alias("created_at"),
        *([F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in free])).alias("extra")] if free else []),
    )
    keyed = documents.withColumn("_digest", digest_of(F.col(filename), directory, strict))
    kept = keyed.join(described, "_digest", "inner").withColumnRenamed("_digest", "digest")
    missing = keyed.select(key, "_digest").join(described.select("_digest"), "_digest", "left_anti")
    return kept, reject(missing, key, NO_METADATA)


def chunk_report(chunks: DataFrame, by: str) -> DataFrame:
    """Chunk and character counts per group, for ingest reports."""
    return chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.length("text").cast("bigint")).alias("n_chars"),
        F.max("chunk").cast("bigint").alias("longest_document"),
    )


