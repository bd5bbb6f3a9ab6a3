"""Corpus to records: quarantine, metadata, cleaning, chunks, ids and vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.text import clean_text
from vectide.operators.chunking import chunk_text, dense_starts, with_content_ids
from vectide.operators.documents import attach_metadata, emptied, limit_documents, split_empty
from vectide.operators.embedding import Encoder, embed, hash_encoder_factory
from vectide.operators.layouts import DEFAULT_NAMESPACE, EXTRA, MAX_TEXT, METADATA, to_records
from vectide.session import materialize
from vectide.sources.collections import Collection, fan_out, fan_out_clear


@dataclass(frozen=True)
class IngestOptions:
    key: str = "doc_id"
    filename: str = "filename"
    directory: str = "data"
    size: int = 1000
    overlap: int = 20
    newline: str = ""
    drop_overlap_tail: bool = False
    limit: int | None = None
    ids: str = "content"
    """``content`` ids depend on document and position; ``dense`` ids count from ``first_id``."""
    first_id: int = 0
    namespace: str = DEFAULT_NAMESPACE
    """Where tables with namespaces are loaded."""
    dim: int = 64
    encoder_factory: Callable[[], Encoder] | None = None
    encoders: int | None = None
    max_text: int = MAX_TEXT
    unique_sidecar: bool = False
    """The sidecar has one row per digest already."""
    free: tuple[str, ...] = ()
    """Columns of the sidecar that are kept as free metadata, in tables that hold such."""


def checked_free(names: tuple[str, ...]) -> tuple[str, ...]:
    """The names, unless one of them is a fixed field, which a filter could not tell from a free one."""
    if clash := sorted(set(names) & set(METADATA.names)):
        raise ValueError(f"{clash[0]!r} is a fixed field and cannot be a free one")
    return tuple(names)


def prepare_documents(documents: DataFrame, sidecar: DataFrame, options: IngestOptions) -> tuple[DataFrame, DataFrame]:
    """Cleaned documents with metadata, and rejects ``key, reason``."""
    chosen = limit_documents(documents, options.key, options.limit)
    with_text, empty = split_empty(chosen, options.key)
    described, missing = attach_metadata(
        with_text, sidecar, options.key, options.filename, options.directory, unique=options.unique_sidecar,
        free=checked_free(options.free),
    )
    ready = described.select(
        options.key, options.filename, "size", "created_at", *([EXTRA] if options.free else []),
        clean_text(F.col("text"), options.newline).alias("text"),
    )
    vanished = emptied(described, options.key, options.newline)
    return ready, empty.unionByName(missing).unionByName(vanished)


def number_chunks(ready: DataFrame, options: IngestOptions) -> DataFrame:
    """Chunks with ids.

    Content ids need nothing but the row. Dense ids need all counts first, so
    the cleaned documents are written once instead of being cleaned twice.
    """
    if options.ids == "content":
        chunks = chunk_text(ready, "text", options.size, options.overlap, options.drop_overlap_tail)
        return with_content_ids(chunks, options.key)
    if options.ids != "dense" or options.drop_overlap_tail:
        raise ValueError("ids must be 'content', or 'dense' with every tail chunk kept")
    cleaned = materialize(ready, "cleaned")
    starts = dense_starts(cleaned, options.key, "text", options.size, options.overlap)
    numbered = cleaned.join(starts.select(options.key, "first_id"), options.key)
    chunks = chunk_text(numbered, "text", options.size, options.overlap)
    return chunks.withColumn("id", (F.col("first_id") + F.col("chunk") - 1 + options.first_id).cast("string")).drop("first_id")


def embed_chunks(chunks: DataFrame, options: IngestOptions) -> DataFrame:
    factory = options.encoder_factory or hash_encoder_factory(options.dim)
    return embed(chunks, "text", factory, options.dim, num_partitions=options.encoders)


def build_records(
    documents: DataFrame, sidecar: DataFrame, options: IngestOptions = IngestOptions()
) -> tuple[DataFrame, DataFrame]:
    """Records ready for any layout, and rejects ``key, reason``.

    Chunks no longer than the limit of the tables need no further check: the
    encoder's dimension is verified while it runs.
    """
    if options.size > options.max_text:
        raise ValueError("a chunk may not be longer than the tables allow")
    ready, rejects = prepare_documents(documents, sidecar, options)
    records = to_records(embed_chunks(number_chunks(ready, options), options), options.filename)
    return records, rejects


def ingest_run(
    documents: DataFrame,
    sidecar: DataFrame,
    collections: list[Collection],
    options: IngestOptions = IngestOptions(),
    clear: bool = True,
) -> DataFrame:
    """Load a corpus into every collection; returns the rejects ``key, reason, layout, id``.

    ``layout`` and ``id`` are those of a chunk that a table refused; they are
    null for a document of which nothing was loaded. Chunks longer than the
    tables allow are refused by each of them, whatever ``max_text`` says.

    ``clear`` empties what is loaded: whole tables, and of tables with
    namespaces ``options.namespace`` alone. Without it dense ids go on after
    the greatest one in use in any of the tables.

    A corpus whose keys are unique, which is checked on the key column alone,
    gives unique ids and goes into an emptied table in one write. Otherwise
    the rows are upserted.
    """
    for collection in collections:
        if (dim := collection.properties()["dim"]) != options.dim:
            raise ValueError(f"vectors of {options.dim} elements for a table of {dim}")
        if options.free:
            collection.require_free_metadata()
    if clear:
        fan_out_clear(collections, options.namespace)
    elif options.ids == "dense":
        options = replace(options, first_id=max([options.first_id, *(c.next_id(options.namespace) for c in collections)]))
    records, rejects = build_records(documents, sidecar, options)
    repeated = documents.groupBy(options.key).count().where(F.col("count") > 1).limit(1).count()
    refused = materialize(fan_out(records, collections, options.namespace, unique=not repeated), "refused")
    # A file name stands for one document, or for copies of one that fare alike.
    keys = documents.select(options.key, F.col(options.filename).alias("filename")).distinct()
    chunks = refused.join(keys, "filename").select(options.key, "reason", "layout", "id")
    nothing = [F.lit(None).cast("string").alias(name) for name in ("layout", "id")]
    return rejects.select(options.key, "reason", *nothing).unionByName(chunks)
