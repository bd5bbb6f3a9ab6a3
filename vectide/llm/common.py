"""Small helpers the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space. ``bytes.split()`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, with null as the empty one."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that clash with no column of the caller."""
    used = {name.lower() for name in taken}
    found = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(quoted(doc_id).cast("string").cast("binary")) % divisor


def give_back() -> None:
    """Return freed memory to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow`` that gives back a task's memory when it ends: its Python worker waits for other tasks beside those that work."""
    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_groups(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The same for ``applyInPandas``, behind every group."""
    @wraps(run)
    def tidied(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(rows)
        finally:
            give_back()

    return tidied


#: Largest table of bits that is sent to the tasks.
FILTER_BYTES = 32 << 20
_BLOCK = 20


def key_filter(keys: DataFrame, most_bytes: int = FILTER_BYTES) -> np.ndarray:
    """Bits of the cells that the one long column of ``keys`` (hashes, without null) falls into.

    At least 16 cells a key, counted first, as long as ``most_bytes`` allow;
    beyond that more keys pass by chance. Built by block, so that the driver
    gets the table and no key.
    """
    [name] = keys.columns
    size = 1 << _BLOCK
    wanted = 16 * keys.count()
    while size < wanted and size < 8 * most_bytes:
        size *= 2
    cell = F.pmod(quoted(name), F.lit(size))
    blocks = keys.select(F.shiftright(cell, _BLOCK).cast("int").alias("block"), (cell % (1 << _BLOCK)).cast("int").alias("cell")).distinct()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _BLOCK, bool)
        bits[rows["cell"].to_numpy()] = True
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    table = np.zeros(size // 8, np.uint8)
    for row in blocks.groupBy("block").applyInPandas(merge, "block int, bits binary").toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        table[row["block"] * len(part): (row["block"] + 1) * len(part)] = part
    return table


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be among those of :func:`key_filter`; none of them is missed."""
    cell = keys.astype(np.int64) % (8 * len(table))
    return (table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
