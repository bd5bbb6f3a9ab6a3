"""Metadata for a stream of documents where the sidecar is a stream too: rows of either may come first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectide.functions.text import digest_of
from vectide.operators.documents import NO_METADATA
from vectide.plans.ingest import IngestOptions
from vectide.session import materialize
from vectide.sources.collections import Collection
from vectide.streaming.ingest import load_batch, write_batches


def attach_late_metadata(
    documents: DataFrame,
    sidecar: DataFrame,
    key: str,
    filename: str = "filename",
    directory: str = "data",
    strict: bool = False,
    position: str = "pos",
    arrived: str = "arrived",
    within: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """``key, digest, file_size, date, reason`` for each document, once its time is over.

    Both sides have a time ``arrived``. A sidecar row belongs to a document if
    it came at most ``within`` before or after it; of several the first in file
    order counts, in whichever batch it came. A document that none belongs to
    is rejected with its reason. Rows may be ``delay`` behind the latest of
    their side before they are dropped as late. A document's row comes out when the
    time of both sides has passed its own by ``within`` and ``delay``.

    Only keys, digests and the sidecar's fields are kept as state, no texts.
    Rows of one key, digest and time count as one document; rows with no time
    never come out. To end a stream, give each side a row of a time far ahead
    (its digest not null, as Spark drops others before it looks at their time);
    that row itself waits for later ones.
    """
    docs = documents.select(
        F.col(key).alias("_key"), digest_of(F.col(filename), directory, strict).alias("digest"), F.col(arrived).alias("_arrived")
    ).withWatermark("_arrived", delay)
    notes = sidecar.select(
        F.col("digest").alias("_digest"), F.col(position).alias("_pos"), "file_size", "date", F.col(arrived).alias("_noted")
    ).withWatermark("_noted", delay)
    span = F.expr(f"interval {within}")
    near = F.col("_noted").between(F.col("_arrived") - span, F.col("_arrived") + span)
    joined = docs.join(notes, (F.col("digest") == F.col("_digest")) & near, "left_outer")
    # The same order as in batch.
    first = F.min(F.when(F.col("_digest").isNotNull(), F.struct("_pos", F.xxhash64("file_size", "date").alias("tie"), "file_size", "date")))
    described = joined.groupBy("_arrived", "_key", "digest").agg(first.alias("_first"))
    return described.select(
        F.col("_key").alias(key), "digest", "_first.file_size", "_first.date",
        F.when(F.col("_first").isNull(), NO_METADATA).alias("reason"))


def stream_ingest_late(
    described: DataFrame,
    texts: Callable[[], DataFrame],
    collections: Collection | list[Collection],
    checkpoint: str,
    options: IngestOptions = IngestOptions(),
    dead_letters: str | None = None,
) -> StreamingQuery:
    """Load the documents that :func:`attach_late_metadata` describes; those without metadata go to ``dead_letters``.

    ``texts`` gives the documents (key, file name, text) as they are stored when
    a batch is loaded; only those of the batch are joined with it.
    """
    load = load_batch(collections, checkpoint, replace(options, unique_sidecar=True), dead_letters)

    def write(batch: DataFrame, number: int) -> None:
        kept = materialize(batch, "described")
        wanted = kept.where(F.col("reason").isNull())
        documents = texts().join(wanted.select(options.key), options.key, "left_semi")
        sidecar = wanted.select("digest", "file_size", "date").dropDuplicates(["digest"])
        load(documents, sidecar, number, kept.where(F.col("reason").isNotNull()).select(options.key, "reason"))

    return write_batches(described, write, checkpoint, dead_letters, options.key)
