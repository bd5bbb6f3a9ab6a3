"""Reading documents, pages and sidecars, each with a declared schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.operators.documents import EXTRACT_FAILED, reject
from vectide.operators.ordering import spread

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
SIDECAR = T.StructType([
    T.StructField("digest", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("date", T.StringType()),
])
PAGES = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])


def read_documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENTS) -> DataFrame:
    """Extracted documents kept as parquet, spread over the cores if they are few files."""
    return spread(spark.read.schema(schema).parquet(path), schema.names[0])


def scan_text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per text file: ``filename, text``; never keyed by listing order.

    Spark's file listing skips files of zero bytes, so those give no row.
    """
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per binary file of at least one byte: ``filename, content``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("_metadata.file_name").alias("filename"), "content")


def extract_pages(
    files: DataFrame, extractor: Callable[[bytes], list[str]]
) -> tuple[DataFrame, DataFrame]:
    """Page rows from binary files, and rejects for files the extractor failed on.

    ``extractor`` turns the bytes of one file into its page texts. An error
    concerns its file only and never fails the job. Both results come from one
    plan; write or persist the first if the second is also needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("filename"))
            contents = batch.column(batch.schema.get_field_index("content"))
            for name, content in zip(names, contents):
                try:
                    texts = extractor(content.as_py())
                    error = None
                except Exception as failure:  # noqa: BLE001 - any parser error is a reject
                    texts, error = [""], f"{type(failure).__name__}: {failure}"
                texts = texts or [""]
                size = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.as_py()] * size, pa.string()),
                        pa.array(range(1, size + 1), pa.int32()),
                        pa.array(texts, pa.string()),
                        pa.array([error] * size, pa.string()),
                    ],
                    ["filename", "page_no", "text", "error"],
                )

    pages = files.mapInArrow(run, PAGES)
    failed = reject(pages.where(F.col("error").isNotNull()), "filename", EXTRACT_FAILED)
    return pages.where(F.col("error").isNull()).drop("error"), failed


def pdf_extractor() -> Callable[[bytes], list[str]]:
    """Extractor for PDF files; needs the optional ``pypdf`` on the executors."""

    def extract(content: bytes) -> list[str]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as missing:
            raise RuntimeError("install pypdf on the executors to read PDF files") from missing
        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]

    return extract


def read_sidecar(spark: SparkSession, path: str, schema: T.StructType = SIDECAR, line_breaks: bool = False) -> DataFrame:
    """Metadata CSV with a header, plus ``pos``: file order, so that "first" is defined.

    With ``line_breaks`` quoted fields may hold some; a file is then read by
    one task, so a large sidecar should come in several files.

    Position is file path, then offset of the split, then line in the split.
    Only a byte position is available without a global sort, and it suffices.
    """
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    rows = (reader.option("multiLine", True) if line_breaks else reader).csv(path)
    return rows.withColumn(
        "pos",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ),
    )
