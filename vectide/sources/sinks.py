"""JSON output and delivery of batches to a caller's sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIVERIES = T.StructType([
    T.StructField("task", T.LongType()),
    T.StructField("batch", T.LongType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("first_id", T.StringType()),
    T.StructField("error", T.StringType()),
])


def write_json(records: DataFrame, path: str) -> None:
    """All records as JSON lines, one file per task; nulls are written."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def dump_results(results: DataFrame, path: str) -> None:
    """Each row as a JSON text line."""
    results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def deliver_batches(
    records: DataFrame, sink_factory: Callable[[], Callable[[pa.Table], None]], batch_size: int = 500
) -> DataFrame:
    """Send rows to an external sink in batches and report on each batch.

    Every task opens its own sink and cuts its own rows, so delivery scales
    with the tasks and nothing passes through the driver. A batch that fails is
    reported and skipped. Delivery is at least once: a repeated task sends its
    batches again, so the sink should write by key.
    """
    schema = DELIVERIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        sink = sink_factory()
        waiting: list[pa.RecordBatch] = []
        count = number = 0

        def send(rows: pa.Table) -> pa.RecordBatch:
            error = None
            try:
                sink(rows)
            except Exception as failure:  # noqa: BLE001 - a bad batch must not stop the others
                error = f"{type(failure).__name__}: {failure}"
            values = [[task], [number], [rows.num_rows], [str(rows.column("id")[0].as_py())], [error]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], schema.names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            waiting.append(batch)
            count += batch.num_rows
            while count >= batch_size:
                rows = pa.Table.from_batches(waiting)
                yield send(rows.slice(0, batch_size))
                number += 1
                waiting = rows.slice(batch_size).to_batches()
                count -= batch_size
        if count:
            yield send(pa.Table.from_batches(waiting))

    return records.mapInArrow(run, schema)
