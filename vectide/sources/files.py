"""Document files as a data source: one row for every listed file, read or not.

Spark's own file sources skip files of zero bytes and fail a job at a file they
can't open. This one lists on the driver, reads in the tasks, and says of each
file what is wrong with it, so that no document goes missing without a reason.
It works in batch and as a stream, on any file system that Arrow reads.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vectide.operators.documents import reject

SOURCE = "document_files"
SCHEMA = "path string, filename string, size bigint, content binary, reason string"
# Why a file gives no document.
EMPTY_FILE = "empty_file"
UNREADABLE = "unreadable"
NOT_TEXT = "not_utf8"
#: Files and bytes that a task reads.
FILES_PER_TASK, BYTES_PER_TASK = 1_000, 64 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True, order=True)
class Listed:
    """A file as it was listed; the order in which a stream delivers."""

    modified: int
    path: str
    size: int


def listed(path: str, glob: str) -> list[Listed]:
    """All files below a folder, or that one file. Hidden ones are left out, as Spark does."""
    system, root = _opened(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(
        Listed(file.mtime_ns or 0, file.path, file.size or 0) for file in found
        if file.type == fs.FileType.File and fnmatch.fnmatch(file.base_name, glob) and not file.base_name.startswith(("_", ".")))


@dataclass
class Files(InputPartition):
    folder: str
    files: list[tuple[str, int]]


def _partitions(folder: str, files: list[Listed]) -> list[Files]:
    """Files by size, as many to a task as its bounds allow. A folder without files gives one empty part."""
    parts, size = [Files(folder, [])], 0
    for file in files:
        if parts[-1].files and (size + file.size > BYTES_PER_TASK or len(parts[-1].files) >= FILES_PER_TASK):
            parts.append(Files(folder, []))
            size = 0
        parts[-1].files.append((file.path, file.size))
        size += file.size
    return parts


def _read(partition: Files) -> Iterator[tuple]:
    system, _ = _opened(partition.folder)
    for path, size in partition.files:
        content, reason = None, EMPTY_FILE
        if size:
            try:
                with system.open_input_stream(path) as stream:
                    content, reason = stream.read(), None
            except OSError as failure:
                reason = f"{UNREADABLE}: {type(failure).__name__}"
        yield path, path.rpartition("/")[2], size, content, reason


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return _partitions(self.options["path"], listed(self.options["path"], self.options.get("glob", "*")))

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(partition)


class _StreamReader(DataSourceStreamReader):
    """The offset is the last file listed, by time of change and path; a batch takes all that is new."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def _listed(self) -> list[Listed]:
        return listed(self.options["path"], self.options.get("glob", "*"))

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._listed()
        return {"modified": files[-1].modified, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = ((offset["modified"], offset["path"]) for offset in (start, end))
        return _partitions(self.options["path"], [file for file in self._listed() if first < (file.modified, file.path) <= last])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class DocumentFiles(DataSource):
    """Options: ``path`` and ``glob`` (all files unless given)."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader({k.lower(): v for k, v in self.options.items()})


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, filename, size, content, reason`` of every file; a reason stands where there is no content."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(SOURCE).option("glob", glob).load(path)


def stream_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The same as a stream: each file once, in order of its time of change and path.

    A file that arrives with an older time of change than one already
    delivered is not seen; write files where they are read, or move them there
    with their time of change renewed.
    """
    spark.dataSource.register(DocumentFiles)
    return spark.readStream.format(SOURCE).option("glob", glob).load(path)


def text_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents ``filename, text``, and rejects ``filename, reason`` for all other files."""
    text = F.col("content").cast("string")
    judged = files.withColumn("reason", F.coalesce("reason", F.when(~F.is_valid_utf8(text), F.lit(NOT_TEXT))))
    kept = judged.where(F.col("reason").isNull()).select("filename", F.col("content").cast("string").alias("text"))
    return kept, reject(judged.where(F.col("reason").isNotNull()), "filename", F.col("reason"))


def write_files(documents: DataFrame, path: str) -> DataFrame:
    """Write each of ``filename, content`` as a file below ``path``; returns ``files, bytes`` of each task.

    A file appears under its name only when it is whole, and a repeated task
    replaces its files by the same ones, so a redelivery changes nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(path)
        system.create_dir(root, recursive=True)
        files = size = 0
        for batch in batches:
            for name, content in zip(*(column.to_pylist() for column in batch.columns)):
                content = content or b""
                with system.open_output_stream(f"{root}/.{name}.part") as stream:
                    stream.write(content)
                system.move(f"{root}/.{name}.part", f"{root}/{name}")
                files, size = files + 1, size + len(content)
        yield pa.RecordBatch.from_arrays([pa.array([files]), pa.array([size])], names=["files", "bytes"])

    return documents.select("filename", "content").mapInArrow(run, "files bigint, bytes bigint")
