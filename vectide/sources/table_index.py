"""A search index that belongs to a vector table and keeps up with it.

It lies below the table's folder::

    index/properties/        one row per build or refresh; the latest counts
    index/<name>/cells-<n>/  centres with radius, greatest norm and count
    index/<name>/rows/cell=<c>/  keys, values, codes, distance to the centre, batch

A stored row counts as long as no change of the table with a greater batch
number replaces its key or clears its namespace. What came after the last
refresh, by upsert or append, is searched exactly and merged, so every search
gives the exact hits at any time. ``refresh`` puts new rows into the cells that
are there and splits only cells that have outgrown the others. A table that was
cleared or compacted since then is searched without the index until it is
refreshed, which keeps the centres.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.operators.certified import CellBounds, best_of, cell_bounds, distance_columns, knn_bounded_codes, knn_certified, with_code_error
from vectide.operators.layouts import KEYS, SCHEMAS, VECTOR_COLUMN, searchable
from vectide.operators.ordering import first_ranked
from vectide.operators.search import Cells, assign_cells, peak_value, spread_cells, train_cells, with_codes
from vectide.operators.topk import SearchBounds, top_k
from vectide.sources.collections import CLEAR, PUT, Collection, _read_if_present

PROPERTIES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("name", T.StringType()), T.StructField("snapshot", T.StringType()),
    T.StructField("batch", T.LongType()), T.StructField("version", T.LongType()), T.StructField("peak", T.DoubleType()),
    T.StructField("files", T.ArrayType(T.StringType())),
])
CENTRES = "cell int, centre array<double>, radius double, greatest_norm double, count long"
#: A cell with so many times the mean number of rows is split.
OUTGROWN = 4.0


@dataclass(frozen=True)
class TableIndex:
    table: Collection
    state: dict
    bounds: CellBounds

    @property
    def _folder(self) -> str:
        return f"{self.table.path}/index/{self.state['name']}"

    def _keys(self) -> list[str]:
        return KEYS[self.table.layout]

    def _schema(self) -> T.StructType:
        layout = SCHEMAS[self.table.layout]
        return T.StructType([
            *(layout[name] for name in self._keys()),
            T.StructField("values", T.ArrayType(T.FloatType())), T.StructField("q8", T.ArrayType(T.ByteType())),
            T.StructField("q8_error", T.DoubleType()), T.StructField("cell_distance", T.DoubleType()), T.StructField("cell_norm", T.DoubleType()),
            T.StructField("batch", T.LongType()), T.StructField("cell", T.IntegerType()),
        ])

    # -- what the index holds ---------------------------------------------------

    def _stored(self) -> DataFrame:
        rows = _read_if_present(self.table.spark, self._schema(), f"{self._folder}/rows")
        if rows is None:
            return self.table.spark.createDataFrame([], self._schema())
        retired = [int(c) for c in np.flatnonzero(self.bounds.counts < 0)]
        return rows.where(~F.col("cell").isin(retired)) if retired else rows

    def current(self) -> bool:
        """Whether the table still has the snapshot that the index was made from."""
        return self.table.properties()["snapshot"] == self.state["snapshot"]

    def _changes(self) -> DataFrame | None:
        """All changes on disk, those that a fold has taken in as well."""
        found = self.table.properties()
        return self.table._changes({**found, "folded": -1})

    def rows(self) -> DataFrame:
        """Indexed rows that still count."""
        rows = self._stored()
        if not self.current():
            return rows.where(F.lit(False))
        changes = self._changes()
        if changes is None:
            return rows
        keys = self._keys()
        newest = changes.where(F.col("op") == PUT).groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.max("batch").alias("_batch"))
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in keys])
        rows = rows.join(newest, same & (F.col("_batch") > F.col("batch")), "left_anti")
        if "namespace" in keys:
            cleared = changes.where(F.col("op") == CLEAR).groupBy(F.col("namespace").alias("_cleared")).agg(F.max("batch").alias("_batch"))
            rows = rows.join(cleared, (F.col("namespace") == F.col("_cleared")) & (F.col("_batch") > F.col("batch")), "left_anti")
        return rows

    def newer(self) -> DataFrame:
        """Rows of the table that the index does not hold, as ``id, values`` with their keys."""
        layout = self.table.layout
        if not self.current():
            return searchable(self.table.read(), layout).select(*self._keys(), "values")
        found = self.table.properties()
        # Appended files are read by name; the others are not looked at.
        stored = self.table._stored(found)
        files = sorted(set(stored.inputFiles()) - set(self.state["files"])) if stored is not None else []
        schema = SCHEMAS[layout]
        parts = [self.table.spark.createDataFrame([], schema)]
        if files:
            parts.append(self.table.spark.read.schema(schema).option("basePath", self.table._snapshot(found["snapshot"])).parquet(*files))
        changes = self._changes()
        if changes is not None:
            puts = changes.where((F.col("op") == PUT) & (F.col("batch") > self.state["batch"])).drop("op")
            if "namespace" in schema.names:
                cleared = changes.where(F.col("op") == CLEAR).groupBy("namespace").agg(F.max("batch").alias("_cleared"))
                puts = puts.join(cleared, "namespace", "left").where(F.col("batch") > F.coalesce("_cleared", F.lit(-1))).drop("_cleared")
            # The same order as in Collection.read, so that both keep the same row of a key.
            newest = first_ranked(puts, KEYS[layout], [F.col("batch").desc(), F.xxhash64(VECTOR_COLUMN[layout]).desc()])
            parts.append(newest.select(*schema.names))
        return searchable(reduce(DataFrame.unionByName, [p.select(*schema.names) for p in parts]), layout).select(*self._keys(), "values")

    # -- search --------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int = 5, method: str = "ivf", namespace: str | None = None, probes: int = 1,
               most_probes: int | None = None, bounds: SearchBounds = SearchBounds()) -> DataFrame:
        """Hits ``query_id, rank, id, score``, equal to those of an exact search unless ``most_probes`` ends it early."""
        found = self.table.properties()
        rows, newer = (part if namespace is None else part.where(F.col("namespace") == namespace) for part in (self.rows(), self.newer()))
        if method == "ivf":
            return knn_certified(rows, queries, self.bounds, k, probes, most_probes, newer, found["dim"], bounds).hits
        if method != "int8":
            raise ValueError(f"unknown method {method!r}")
        coded = knn_bounded_codes(rows, queries, self.state["peak"], k, found["metric"], found["dim"], search_bounds=bounds)
        return best_of([coded, top_k(newer, queries, k, found["metric"], found["dim"], bounds=bounds)], k)

    # -- keeping up ----------------------------------------------------------------

    def _add(self, rows: DataFrame, batch: int, cells: Cells) -> None:
        metric = cells.metric
        assigned = distance_columns(assign_cells(rows.where(F.col("values").isNotNull()), cells), cells)
        coded = with_code_error(with_codes(assigned, self.state["peak"], metric), self.state["peak"], metric)
        self._write(coded.withColumn("batch", F.lit(batch).cast("bigint")))

    def _write(self, rows: DataFrame) -> None:
        spread_cells(rows.select(*self._schema().names)).write.mode("append").partitionBy("cell").parquet(f"{self._folder}/rows")

    def _settled(self, batch: int, cells: Cells, retired: list[int]) -> "TableIndex":
        """The index with bounds that cover all its rows, written down as its latest state."""
        found = self.table.properties()
        stored = self.table._stored(found)
        version = self.state["version"] + 1
        counts = np.zeros(len(cells.centres), np.int64)
        counts[retired] = -1
        own = replace(self, bounds=CellBounds(cells, np.zeros(0), np.zeros(0), counts))
        bounds = cell_bounds(own._stored(), cells)
        bounds.counts[retired] = -1
        state = {**self.state, "seq": self.state["seq"] + 1, "snapshot": found["snapshot"], "batch": batch, "version": version,
                 "files": sorted(stored.inputFiles()) if stored is not None else []}
        spark = self.table.spark
        centres = [(i, [float(x) for x in c], float(bounds.radius[i]), float(bounds.greatest_norm[i]), int(bounds.counts[i])) for i, c in enumerate(cells.centres)]
        spark.createDataFrame(centres, CENTRES).coalesce(1).write.parquet(f"{self._folder}/cells-{version}")
        spark.createDataFrame([tuple(state[f.name] for f in PROPERTIES)], PROPERTIES).coalesce(1).write.mode("append").parquet(f"{self.table.path}/index/properties")
        return TableIndex(self.table, state, bounds)

    def refresh(self, outgrown: float = OUTGROWN) -> "TableIndex":
        """Index what is new, into the cells that are there; split cells that have outgrown the others.

        After a clear or a fold the rows are assigned anew; the centres stay.
        """
        own, batch = self, self.table.last_batch()
        if not self.current():
            own = replace(self, state={**self.state, "name": uuid.uuid4().hex, "version": 0})
            own = replace(own, bounds=replace(self.bounds, counts=np.zeros(len(self.bounds.counts), np.int64)))
        own._add(own.newer(), batch, own.bounds.cells)
        own = own._settled(batch, own.bounds.cells, [int(c) for c in np.flatnonzero(own.bounds.counts < 0)])
        live = own.bounds.counts[own.bounds.counts >= 0]
        large = np.flatnonzero(own.bounds.counts > outgrown * max(1.0, live.mean() if len(live) else 1.0))
        return own._split([int(c) for c in large]) if len(large) else own

    def _split(self, large: list[int]) -> "TableIndex":
        """Give the rows of each large cell two centres of their own; other cells are not read."""
        cells, centres = self.bounds.cells, list(self.bounds.cells.centres)
        for cell in large:
            rows = self._stored().where(F.col("cell") == cell)
            halves = train_cells(rows, 2, cells.metric)
            moved = assign_cells(rows.drop("cell", "cell_distance", "cell_norm"), halves).withColumn("cell", F.col("cell") + len(centres))
            centres += list(halves.centres)
            self._write(distance_columns(moved, Cells(np.array(centres), cells.metric)))
        retired = [*np.flatnonzero(self.bounds.counts < 0).tolist(), *large]
        return self._settled(self.state["batch"], Cells(np.array(centres), cells.metric), retired)


def build_table_index(table: Collection, cells: int = 16, seed: int = 7, iterations: int = 20, fraction: float = 1.0) -> TableIndex:
    """Train centres on the table's rows (a ``fraction`` of them) and index all of them."""
    found = table.properties()
    rows = searchable(table.read(), found["layout"]).where(F.col("values").isNotNull())
    trained = train_cells(rows, cells, found["metric"], seed, iterations, fraction)
    state = {"seq": 0, "name": uuid.uuid4().hex, "snapshot": found["snapshot"], "batch": table.last_batch(), "version": 0,
             "peak": peak_value(rows, found["metric"]), "files": []}
    own = TableIndex(table, state, CellBounds(trained, np.zeros(0), np.zeros(0), np.zeros(len(trained.centres), np.int64)))
    own._add(rows.select(*KEYS[found["layout"]], "values"), state["batch"], trained)
    return own._settled(state["batch"], trained, [])


def open_table_index(table: Collection) -> TableIndex | None:
    """The table's index in its latest state, or ``None``."""
    states = _read_if_present(table.spark, PROPERTIES, f"{table.path}/index/properties")
    latest = states.orderBy(F.col("seq").desc()).first() if states is not None else None
    if latest is None:
        return None
    state = latest.asDict()
    rows = table.spark.read.schema(CENTRES).parquet(f"{table.path}/index/{state['name']}/cells-{state['version']}").orderBy("cell").collect()
    column = lambda name, kind: np.array([row[name] for row in rows], kind)
    cells = Cells(column("centre", np.float64), table.properties()["metric"])
    return TableIndex(table, state, CellBounds(cells, column("radius", np.float64), column("greatest_norm", np.float64), column("count", np.int64)))
