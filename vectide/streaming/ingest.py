"""Documents as a file stream: micro-batches into vector tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vectide.operators.documents import first_sidecar_rows, reject
from vectide.operators.layouts import LAYOUTS, to_namespaced_layout
from vectide.plans.ingest import IngestOptions, build_records
from vectide.session import materialize
from vectide.sources.collections import Collection
from vectide.sources.documents import DOCUMENTS

DEAD_LETTERS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("batch", T.LongType()),
])
#: First dense id and number of ids of a batch.
IDS = "first bigint, n bigint"

#: Errors that say that a query or a function is wrong, whatever the data.
CODE_FAULTS = (AnalysisException, AttributeError, ImportError, NameError, TypeError)


def stream_documents(
    spark: SparkSession, path: str, files_per_batch: int = 1, schema: T.StructType = DOCUMENTS
) -> DataFrame:
    """Parquet files of documents as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _record(rejects: DataFrame, dead_letters: str, number: int) -> None:
    rejects.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{dead_letters}/batch={number}")


def write_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    dead_letters: str | None = None,
    key: str = "doc_id",
) -> StreamingQuery:
    """Feed every micro-batch to ``write``; available input is drained, then the query ends.

    With ``dead_letters``, a batch that fails on its data is recorded there,
    key by key with its error, and the stream goes on; without it the stream
    fails. Faults of the code (``CODE_FAULTS``) always fail the stream. Both
    outputs are keyed by batch number, so a batch that is delivered again
    replaces itself.
    """

    def handle(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
        except CODE_FAULTS:
            raise
        except Exception as failure:  # noqa: BLE001 - the batch is recorded and the stream goes on
            if dead_letters is None:
                raise
            reason = f"{type(failure).__name__}: {failure}"
            _record(reject(batch, key, reason), dead_letters, number)

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ingest(
    stream: DataFrame,
    sidecar: DataFrame,
    collections: Collection | list[Collection],
    checkpoint: str,
    options: IngestOptions = IngestOptions(),
    dead_letters: str | None = None,
) -> StreamingQuery:
    """Clean, chunk, embed and upsert each micro-batch of documents into one table or several.

    Content ids depend on document and position only. Tables with integer ids
    need dense ones: each batch goes on after the last, from a start that is
    written beside the checkpoint before the batch is loaded, so that a batch
    delivered again gets the same ids. Rejected documents go to
    ``dead_letters`` with their reason.
    """
    load = load_batch(collections, checkpoint, replace(options, unique_sidecar=True), dead_letters)
    if not options.unique_sidecar:
        # Reduced once here instead of in every batch.
        sidecar = materialize(first_sidecar_rows(sidecar), "sidecar")
    return write_batches(stream, lambda batch, number: load(batch, sidecar, number), checkpoint, dead_letters, options.key)


def load_batch(
    collections: Collection | list[Collection], checkpoint: str, options: IngestOptions, dead_letters: str | None
) -> Callable[..., None]:
    """``load(documents, sidecar, number, rejects=None)``: one numbered batch into all tables.

    ``rejects`` (key, reason) are recorded beside those of the load.
    """
    tables = [collections] if isinstance(collections, Collection) else list(collections)
    layouts = [table.layout for table in tables]
    if any(table.properties()["dim"] != options.dim for table in tables):
        raise ValueError(f"not all tables hold vectors of {options.dim} elements")
    if options.ids == "content" and set(layouts) != {"namespaced"}:
        raise ValueError("tables with integer ids need ids='dense'")
    offsets = _first_batches(tables, checkpoint)
    ids = f"{checkpoint}/ids"

    def load(batch: DataFrame, sidecar: DataFrame, number: int, refused: DataFrame | None = None) -> None:
        chosen = options
        if options.ids == "dense":
            chosen = replace(options, first_id=_first_id(tables, ids, number, options.namespace))
        records, rejects = build_records(batch, sidecar, chosen)
        if len(tables) > 1 or options.ids == "dense":
            records = materialize(records, "batch")
        if options.ids == "dense":
            _write_row(tables[0].spark, (chosen.first_id, records.count()), IDS, f"{ids}/batch={number}")
        if dead_letters is not None:
            _record(rejects if refused is None else rejects.unionByName(refused), dead_letters, number)
        # Last, so that a batch recorded as failed was not loaded.
        for table, layout, offset in zip(tables, layouts, offsets):
            rows = to_namespaced_layout(records, options.namespace) if layout == "namespaced" else LAYOUTS[layout](records)
            table.upsert(rows, batch=offset + number)

    return load


def _rows(spark: SparkSession, schema: str, path: str) -> list[Row]:
    """The rows of a small table of settings; none while it is not there."""
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _write_row(spark: SparkSession, row: tuple, schema: str, path: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(path)


def _first_id(tables: list[Collection], path: str, number: int, namespace: str) -> int:
    """First dense id of a batch: as written for it, else after all earlier ones, else after what the tables hold."""
    spark = tables[0].spark
    own = _rows(spark, IDS, f"{path}/batch={number}")
    if own:
        return own[0]["first"]
    before = _rows(spark, IDS, f"{path}/batch={number - 1}")
    if before:
        return before[0]["first"] + before[0]["n"]
    # The first batch, or one after a batch that failed on its data.
    earlier = _end_of_ids(spark, path)
    return max(earlier, *(table.next_id(namespace) for table in tables))


def _end_of_ids(spark: SparkSession, path: str) -> int:
    """End of all ids given out so far by the stream."""
    try:
        given = spark.read.schema(IDS).parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return given.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0


def _first_batches(tables: list[Collection], checkpoint: str) -> list[int]:
    """Each table's batch number of the stream's batch 0, kept beside its checkpoint.

    Fixed on the first start, so that a restarted stream repeats the numbers it
    used and a new stream never reuses numbers that were cleared or folded.
    """
    spark, path = tables[0].spark, f"{checkpoint}/collection"
    known = _rows(spark, "first array<bigint>", path)
    if known:
        return known[0]["first"]
    first = [table.last_batch() + 1 for table in tables]
    _write_row(spark, (first,), "first array<bigint>", path)
    return first
