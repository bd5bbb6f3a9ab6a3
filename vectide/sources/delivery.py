"""Rows to an external store as a data source with commits: what a task sends counts once its write commits.

Tasks stage their rows, in batches of a given size, under a token of their own;
the commit publishes the tokens of the tasks that ended well, under the number
of the batch. So a task that was killed and repeated counts once, a job that
fails publishes nothing, and a batch that is delivered again changes nothing.
It works for batch writes and for streams.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

BATCH_ROWS = 500


class Sink(Protocol):
    """An external store; it must survive pickling, because tasks get copies of it."""

    def stage(self, token: str, number: int, rows: pa.Table) -> None:
        """Keep the rows of a task's batch out of sight."""

    def publish(self, batch: str, tokens: list[str]) -> None:
        """Show the staged rows of these tasks, all at once; nothing if the batch was published before."""

    def discard(self, tokens: list[str]) -> None:
        """Forget staged rows."""


@dataclass(frozen=True)
class FolderSink:
    """Parquet files in a folder that all executors share; a list for each batch says which ones count."""

    path: str

    def _folder(self, *parts: str) -> tuple[fs.FileSystem, str]:
        path = self.path
        if path.startswith("file:/") and not path.startswith("file:///"):
            path = "file://" + path[len("file:"):]
        system, root = fs.FileSystem.from_uri(path)
        return system, posixpath.join(root, *parts)

    def stage(self, token: str, number: int, rows: pa.Table) -> None:
        system, folder = self._folder("staged", token)
        system.create_dir(folder, recursive=True)
        pq.write_table(rows, f"{folder}/{number:08d}.parquet", filesystem=system)

    def publish(self, batch: str, tokens: list[str]) -> None:
        if batch in self.published():
            self.discard(tokens)
            return
        system, folder = self._folder("published")
        system.create_dir(folder, recursive=True)
        # Under another name first, so that a reader sees the whole list or none.
        begun = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(begun) as out:
            out.write(json.dumps(tokens).encode())
        system.move(begun, f"{folder}/{batch}.json")

    def discard(self, tokens: list[str]) -> None:
        for token in tokens:
            system, folder = self._folder("staged", token)
            if system.get_file_info(folder).type == fs.FileType.Directory:
                system.delete_dir(folder)

    def published(self) -> dict[str, list[str]]:
        """Batches and the tokens of their tasks; one entry a task that sent rows."""
        system, folder = self._folder("published")
        lists = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found = {}
        for file in lists:
            if file.extension == "json":
                with system.open_input_stream(file.path) as given:
                    found[file.base_name[: -len(".json")]] = json.loads(given.read())
        return found

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The rows of all published batches."""
        tokens = [token for own in self.published().values() for token in own]
        if not tokens:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/staged/{token}" for token in tokens])


@dataclass
class Staged(WriterCommitMessage):
    """What a task tells the driver: its token, however many rows it sent."""

    token: str | None


class _Writer:
    def __init__(self, sink: Sink, size: int, schema: T.StructType, batch: str) -> None:
        self.sink, self.size, self.names, self.batch = sink, size, schema.names, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Stage the rows in batches of ``size``, the last one shorter; one batch is held in memory."""
        token = uuid.uuid4().hex
        waiting: list[pa.RecordBatch] = []
        count = number = 0
        try:
            for batch in iterator:
                waiting.append(batch)
                count += batch.num_rows
                while count >= self.size:
                    rows = pa.Table.from_batches(waiting)
                    self.sink.stage(token, number, rows.slice(0, self.size))
                    waiting = rows.slice(self.size).to_batches()
                    count -= self.size
                    number += 1
            if count:
                self.sink.stage(token, number, pa.Table.from_batches(waiting))
                number += 1
        except BaseException:
            # A failed task gives no message, so that no one else knows its token.
            self.sink.discard([token])
            raise
        return Staged(token if number else None)

    def _tokens(self, messages: list[Staged | None]) -> list[str]:
        return [message.token for message in messages if message is not None and message.token is not None]


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self.sink.publish(self.batch, self._tokens(messages))

    def abort(self, messages) -> None:
        self.sink.discard(self._tokens(messages))


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId) -> None:  # noqa: N803 - Spark's name
        self.sink.publish(f"{self.batch}-{batchId}", self._tokens(messages))

    def abort(self, messages, batchId) -> None:  # noqa: N803 - Spark's name
        self.sink.discard(self._tokens(messages))


def register_sink(spark: SparkSession, name: str, sink: Sink) -> str:
    """Make ``df.write.format(name)`` and ``df.writeStream.format(name)`` deliver to ``sink``.

    Options: ``batch``, the number or name under which a write counts (of a
    stream: what its batch numbers follow), and ``rows``, the size of a batch.
    Both writers need mode ``append``; a task repeated by Spark is harmless.
    """

    class Delivery(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def _given(self) -> tuple[str, int]:
            batch, size = self.options.get("batch"), int(self.options.get("rows", BATCH_ROWS))
            if not batch or "/" in batch or batch.startswith("."):
                raise PySparkValueError("a delivery needs the option batch, a plain name")
            if size < 1:
                raise PySparkValueError("rows must be positive")
            return batch, size

        def writer(self, schema: T.StructType, overwrite: bool) -> BatchWriter:
            if overwrite:
                raise PySparkValueError("what was delivered cannot be overwritten")
            batch, size = self._given()
            return BatchWriter(sink, size, schema, batch)

        def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:  # noqa: N802 - Spark's name
            batch, size = self._given()
            return StreamWriter(sink, size, schema, batch)

    spark.dataSource.register(Delivery)
    return name
