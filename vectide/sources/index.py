"""Deferred search index: built in one job after loading.

Loading writes plain rows and nothing else. The build then assigns cells and
int8 codes and stores the rows by cell::

    rows/cell=<n>/   id, values, q8, what the code leaves away, distance to the centre, length
    centres/         one row per cell, with what bounds the scores of its rows
    properties/      one row: metric, dim, peak
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.operators.certified import (
    CellBounds, CertifiedHits, cell_bounds, distance_columns, knn_bounded_codes, knn_certified, probes_for_recall, with_code_error,
)
from vectide.operators.search import (
    Cells, assign_cells, knn_cells, knn_int8, peak_value, same_length, spread_cells, train_cells, vector_dim, with_codes,
)
from vectide.operators.topk import SearchBounds

PROPERTIES = "metric string, dim int, peak double"
CENTRES = "cell int, centre array<double>, radius double, greatest_norm double, count long"


@dataclass(frozen=True)
class VectorIndex:
    path: str
    rows: DataFrame
    cells: Cells
    dim: int
    peak: float
    limits: CellBounds

    def search_certified(self, queries: DataFrame, k: int = 5, probes: int = 1, bounds: SearchBounds = SearchBounds()) -> CertifiedHits:
        """The exact hits, from as few cells as the bounds of the cells allow, and what was read for them."""
        return knn_certified(self.rows, queries, self.limits, k, probes, dim=self.dim, search_bounds=bounds)

    def search_to_recall(self, queries: DataFrame, recall: float = 0.9, k: int = 5, bounds: SearchBounds = SearchBounds()) -> CertifiedHits:
        """Hits from as many cells as a sample of the queries needs for this share of the exact hits."""
        probes = probes_for_recall(self.rows, queries, self.limits, recall, k, search_bounds=bounds)
        return knn_certified(self.rows, queries, self.limits, k, probes, probes, dim=self.dim, search_bounds=bounds)

    def search_bounded_codes(self, queries: DataFrame, k: int = 5, bounds: SearchBounds = SearchBounds()) -> DataFrame:
        """The exact hits: stored codes rule out by their errors, floats decide the rest."""
        return knn_bounded_codes(self.rows, queries, self.peak, k, self.cells.metric, self.dim, search_bounds=bounds)

    def search(self, queries: DataFrame, k: int = 5, probes: int = 4, bounds: SearchBounds = SearchBounds()) -> DataFrame:
        """Hits from the nearest cells only; the other cells are not read."""
        return knn_cells(self.rows, queries, self.cells, k, self.cells.metric, probes, self.dim, bounds)

    def search_codes(self, queries: DataFrame, k: int = 5, oversample: int = 4,
                     bounds: SearchBounds = SearchBounds()) -> DataFrame:
        """Hits from the stored codes, rescored on the floats of the candidates."""
        return knn_int8(self.rows, queries, k, self.cells.metric, self.dim, oversample, bounds, self.peak)


def build_index(vectors: DataFrame, path: str, cells: int = 16, metric: str = "cosine", seed: int = 7,
                iterations: int = 20, fraction: float = 1.0) -> VectorIndex:
    """Build the index of ``vectors(id, values)`` below ``path``."""
    spark = vectors.sparkSession
    stored = vectors.select("id", "values").where(F.col("values").isNotNull())
    dim = vector_dim(stored, "values")
    stored = same_length(stored, "values", dim)
    index = train_cells(stored, cells, metric, seed, iterations, fraction)
    peak = peak_value(stored, metric)
    placed = distance_columns(assign_cells(stored, index), index)
    rows = spread_cells(with_code_error(with_codes(placed, peak, metric), peak, metric))
    rows.write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/rows")
    # One row per cell and one row of settings: the model, not the data.
    limits = cell_bounds(spark.read.schema("cell_distance double, cell_norm double, cell int").parquet(f"{path}/rows"), index)
    columns = zip(index.centres.tolist(), limits.radius.tolist(), limits.greatest_norm.tolist(), limits.counts.tolist())
    centres = [(i, *row) for i, row in enumerate(columns)]
    spark.createDataFrame(centres, CENTRES).coalesce(1).write.parquet(f"{path}/centres")
    spark.createDataFrame([(metric, dim, peak)], PROPERTIES).coalesce(1).write.parquet(f"{path}/properties")
    return open_index(spark, path, stored.schema["id"].dataType)


def open_index(spark: SparkSession, path: str, id_type: T.DataType = T.LongType()) -> VectorIndex:
    settings = spark.read.schema(PROPERTIES).parquet(f"{path}/properties").first()
    centres = spark.read.schema(CENTRES).parquet(f"{path}/centres").orderBy("cell").collect()
    schema = T.StructType([
        T.StructField("id", id_type),
        T.StructField("values", T.ArrayType(T.FloatType())),
        T.StructField("q8", T.ArrayType(T.ByteType())),
        T.StructField("q8_error", T.DoubleType()),
        T.StructField("cell", T.IntegerType()),
    ])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    cells = Cells(np.array([c["centre"] for c in centres]), settings["metric"])
    limits = CellBounds(cells, *(np.array([c[name] for c in centres]) for name in ("radius", "greatest_norm", "count")))
    return VectorIndex(path, rows, cells, settings["dim"], settings["peak"], limits)
