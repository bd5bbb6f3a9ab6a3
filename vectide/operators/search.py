"""Batch similarity search: exact, int8 and clustered."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions.vectors import cosine, inner_product, max_abs, normalize, quantize_int8, round_score
from vectide.operators.ordering import first_ranked
from vectide.operators.topk import SearchBounds, top_k
from vectide.session import materialize


def _searched(vectors: DataFrame, where: Column | None, namespace: str | None) -> DataFrame:
    """Filters come before scoring and reach the scan; a namespace prunes its partitions."""
    if namespace is not None:
        vectors = vectors.where(F.col("namespace") == namespace)
    return vectors.where(where) if where is not None else vectors


def vector_dim(df: DataFrame, col: str) -> int:
    """Length of the vectors of a column, read from one row; 0 for an empty table.

    Whoever uses it passes the column through :func:`same_length` as well.
    """
    first = df.where(F.col(col).isNotNull()).select(F.size(col)).first()
    return first[0] if first else 0


def same_length(df: DataFrame, col: str, dim: int) -> DataFrame:
    """The rows, whose job fails at a vector of another length instead of passing it over. A ``dim`` of 0: no vectors."""
    if not dim:
        return df
    message = F.concat(F.lit("a vector of "), F.size(col).cast("string"), F.lit(f" elements among those of {dim}"))
    fits = F.col(col).isNull() | (F.size(col) == dim)
    return df.withColumn(col, F.when(fits, F.col(col)).otherwise(F.raise_error(message)))


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    where: Column | None = None,
    namespace: str | None = None,
    method: str = "exact",
    dim: int | None = None,
    oversample: int = 4,
    bounds: SearchBounds = SearchBounds(),
) -> DataFrame:
    """Best ``k`` of ``vectors(id, values, ...)`` for each of ``queries(query_id, vector)``.

    ``exact`` ships the queries when they fit and shuffles blocks otherwise;
    ``block`` always shuffles; ``int8`` searches codes and rescores. Clustered
    search needs an index, see :func:`build_cells` and :func:`knn_cells`.
    Vectors whose cosine is undefined (length zero) are never hits. The stored
    vectors set the length, unless ``dim`` does; one of another length fails
    the search. A query of another length has no hits and changes no others.
    """
    found = _searched(vectors, where, namespace)
    dim = dim or vector_dim(found, "values")
    if method in ("exact", "block"):
        found = same_length(found, "values", dim)
        return top_k(found, queries, k, metric, dim, blocks=method == "block", bounds=bounds)
    if method == "int8":
        return knn_int8(found, queries, k, metric, dim, oversample, bounds)
    raise ValueError(f"unknown method {method!r}")


def peak_value(vectors: DataFrame, metric: str) -> float:
    """Largest absolute element, one number for the whole table."""
    values = normalize(F.col("values")) if metric == "cosine" else F.col("values")
    return float(vectors.agg(F.max(max_abs(values))).first()[0] or 0.0)


def with_codes(vectors: DataFrame, peak: float, metric: str, col: str = "values", output: str = "q8") -> DataFrame:
    """Add int8 codes; for cosine the unit-length vector is what gets quantised."""
    values = normalize(F.col(col)) if metric == "cosine" else F.col(col)
    return vectors.withColumn(output, quantize_int8(values, peak))


def rescore(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    """Float scores for candidate pairs; undefined scores drop out."""
    measure = cosine if metric == "cosine" else inner_product
    pairs = candidates.select("query_id", "id").distinct()
    return (
        vectors.select("id", "values")
        .join(pairs, "id")
        .join(queries.select("query_id", "vector"), "query_id")
        .select("query_id", "id", round_score(measure(F.col("values"), F.col("vector"))).alias("score"))
        .where(F.col("score").isNotNull())
    )


def knn_int8(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    dim: int | None = None,
    oversample: int = 4,
    bounds: SearchBounds = SearchBounds(),
    peak: float | None = None,
) -> DataFrame:
    """Search int8 codes for ``oversample * k`` candidates, then rescore those on floats.

    A table that stores ``q8`` (see :func:`with_codes`) is searched on it, and
    the scan then reads a quarter of the bytes; pass the ``peak`` it was built with.
    """
    dim = dim or vector_dim(vectors, "values")
    vectors = same_length(vectors, "values", dim)
    queries = queries.where(F.size("vector") == dim)
    if peak is None:
        peak = peak_value(vectors, metric)
        vectors = with_codes(vectors, peak, metric)
    elif "q8" not in vectors.columns:
        vectors = with_codes(vectors, peak, metric)
    coded_queries = with_codes(queries, peak, metric, "vector", "q8").select("query_id", F.col("q8").alias("vector"))
    coded = vectors.select("id", F.col("q8").alias("values"))
    candidates = top_k(coded, coded_queries, oversample * k, "ip", dim, bounds=bounds)
    scored = rescore(candidates, vectors, queries, metric)
    best = first_ranked(scored, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k, rank="rank")
    return best.select("query_id", "rank", "id", "score")


@dataclass(frozen=True)
class Cells:
    """Centres of a clustered index."""

    centres: np.ndarray
    metric: str

    def nearest(self, df: DataFrame, col: str, n: int, output: str) -> DataFrame:
        """Add the ``n`` nearest cells of each vector, nearest first."""
        centres, metric = self.centres, self.metric

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def cells_of(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            matrix = np.stack(values.to_numpy()).astype(np.float64)
            if metric == "cosine":
                lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                matrix = matrix / np.where(lengths > 0, lengths, 1.0)
            # Squared distance without the term that is equal for all centres.
            distance = (centres * centres).sum(axis=1) - 2 * matrix @ centres.T
            return pd.Series(list(np.argsort(distance, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return df.withColumn(output, cells_of(F.col(col)))


def train_cells(vectors: DataFrame, cells: int = 16, metric: str = "cosine", seed: int = 7,
                iterations: int = 20, fraction: float = 1.0) -> Cells:
    """Fit the centres. ``fraction`` trains on fewer rows; every row is still indexed."""
    values = normalize(F.col("values")) if metric == "cosine" else F.col("values")
    rows = vectors.sample(fraction=fraction, seed=seed) if fraction < 1 else vectors
    # Random starting centres: the parallel start re-clusters its sketch on the driver.
    model = KMeans(k=cells, seed=seed, maxIter=iterations, initMode="random").fit(
        rows.select(array_to_vector(values).alias("features"))
    )
    return Cells(np.array(model.clusterCenters()), metric)


def assign_cells(vectors: DataFrame, index: Cells) -> DataFrame:
    """Put each vector into its nearest cell; all rows are kept."""
    return index.nearest(vectors, "values", 1, "_near").withColumn("cell", F.get("_near", F.lit(0))).drop("_near")


def spread_cells(vectors: DataFrame) -> DataFrame:
    """Partition for writing by cell; AQE splits a large cell and joins small ones."""
    return vectors.hint("rebalance", "cell")


def knn_cells(
    indexed: DataFrame,
    queries: DataFrame,
    index: Cells,
    k: int = 5,
    metric: str = "cosine",
    probes: int = 4,
    dim: int | None = None,
    bounds: SearchBounds = SearchBounds(),
    blocks: bool = False,
) -> DataFrame:
    """Search only the ``probes`` nearest cells of each query.

    With all cells probed the answer equals exact search. On a table stored by
    cell, unprobed cells are pruned at the scan.
    """
    dim = dim or len(index.centres[0])
    indexed = same_length(indexed, "values", dim)
    asked = queries.select("query_id", "vector").where(F.size("vector") == dim)
    nearest = index.nearest(asked, "vector", probes, "_cells")
    # Written once: the probes are counted, listed and searched.
    probed = materialize(nearest.select("query_id", "vector", F.col("_cells").alias("cell")), "probes")
    if probes < len(index.centres):
        # At most one row per cell of the index.
        wanted = [r[0] for r in probed.select(F.explode("cell")).distinct().collect()]
        indexed = indexed.where(F.col("cell").isin(wanted))
    return top_k(indexed, probed, k, metric, dim, cell="cell", blocks=blocks, bounds=bounds)
