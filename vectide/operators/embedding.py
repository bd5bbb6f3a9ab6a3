"""Embedding: a slot for any vectorised encoder, and the built-in one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions.vectors import hash_vector

Encoder = Callable[[pa.Array], np.ndarray]
"""Turns an Arrow array of texts into a matrix with one row per text."""
#: Text that an encoder is given at once; a longer text comes alone.
ENCODED_BYTES = 4 << 20
#: Longer tokens are hashed again wherever they come.
REMEMBERED_LENGTH = 64


class HashEncoder:
    """Feature-hashing encoder of lower-case texts; gives the same vectors as ``hash_vector``.

    Splits and numbers the tokens in Arrow and hashes each distinct token once
    per task. The token memory is emptied when full and holds no very long ones.
    """

    def __init__(self, dim: int = 64, remembered_tokens: int = 200_000):
        self.dim = dim
        self.remembered_tokens = remembered_tokens
        self._codes: dict[str, int] = {"": -1}

    def _code(self, token: str) -> int:
        code = self._codes.get(token)
        if code is None:
            if len(self._codes) >= self.remembered_tokens:
                self._codes = {"": -1}
            code = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % (2 * self.dim)
            if len(token) <= REMEMBERED_LENGTH:
                self._codes[token] = code
        return code

    def __call__(self, texts: pa.Array) -> np.ndarray:
        tokens = pc.split_pattern_regex(texts, pattern=r"[^\p{L}\p{N}_]+")
        distinct = tokens.flatten().dictionary_encode()
        code_of = np.array([self._code(t) for t in distinct.dictionary.to_pylist()], dtype=np.int64)
        codes = code_of[distinct.indices.to_numpy()]
        rows = np.repeat(np.arange(len(texts)), pc.list_value_length(tokens).to_numpy())
        rows, codes = rows[codes >= 0], codes[codes >= 0]
        weights = np.where(codes < self.dim, 1.0, -1.0)
        cells = rows * self.dim + codes % self.dim
        # Without any token bincount returns integers.
        sums = np.bincount(cells, weights, minlength=len(texts) * self.dim).astype(np.float64)
        sums = sums.reshape(len(texts), self.dim)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)


def list_encoder(encode: Callable[[list[str]], np.ndarray]) -> Encoder:
    """Encoder from a model's own ``encode(list of texts)``."""
    return lambda texts: np.asarray(encode(texts.to_pylist()))


def float_lists(matrix: np.ndarray) -> pa.Array:
    """Arrow ``list<float>`` column from a matrix, without Python lists."""
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel()))


def in_pieces(batch: pa.RecordBatch, col: str, most: int = ENCODED_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of at most ``most`` bytes of text or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0).to_numpy().astype(np.int64))
    start, before = 0, 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start, before = end, ends[end - 1]


def embed(
    df: DataFrame,
    col: str,
    encoder_factory: Callable[[], Encoder],
    dim: int = 768,
    output: str = "values",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add a vector column by running an encoder over Arrow batches.

    The factory runs once per task, so a model is loaded once. It is given many
    texts at once, but no more than ``ENCODED_BYTES`` of them, so that a task's
    memory depends neither on the table nor on the texts' lengths. ``num_partitions`` sets how many encoders may run side by side;
    the default keeps the input's partitioning and adds no shuffle. A null text
    is encoded as an empty one. A factory may carry ``prepare``, an expression
    that the JVM applies to the text the encoder is given.
    """
    prepare = getattr(encoder_factory, "prepare", None)
    if num_partitions:
        df = df.repartition(num_partitions)
    kept = [c for c in df.columns if c != output]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(output, T.ArrayType(T.FloatType()))])

    given = "_prepared" if prepare else col
    if prepare:
        df = df.withColumn(given, prepare(F.col(col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_factory()
        for piece in (piece for batch in batches for piece in in_pieces(batch, given)):
            texts = pc.fill_null(piece.column(piece.schema.get_field_index(given)), "")
            matrix = np.asarray(encoder(texts))
            if matrix.shape != (len(texts), dim):
                raise ValueError(f"encoder returned {matrix.shape}, expected {(len(texts), dim)}")
            columns = [piece.column(piece.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, float_lists(matrix)], [*kept, output])

    return df.mapInArrow(run, schema)


def embed_hash(df: DataFrame, col: str = "text", dim: int = 64, output: str = "values") -> DataFrame:
    """Built-in encoder as a column expression: no Python, no shuffle."""
    return df.withColumn(output, hash_vector(F.col(col), dim))


def hash_encoder_factory(dim: int = 64) -> Callable[[], Encoder]:
    """Lower case comes from the JVM in both forms: libraries differ in a few letters, such as a final sigma."""
    def factory() -> HashEncoder:
        return HashEncoder(dim)

    factory.prepare = F.lower
    return factory
