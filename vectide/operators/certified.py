"""Search that reads part of the data and still proves that its answer is the exact one.

Clustered: every cell has a centre, a radius and a greatest norm. By the
triangle inequality no vector of a cell scores higher against a query than the
centre does plus the query's length times the radius. A query reads its cells
by that bound, the most promising ones first, in growing steps, until no unread
cell can reach its k-th score.

Coded: an int8 code stands for a vector up to a known error. Codes give a lower
and an upper bound of each score; whatever can't reach the k-th greatest lower
bound is out, and only the rest is scored on floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vectide.functions.vectors import INT8_MAX, SCORE_DIGITS, norm, normalize
from vectide.operators.ordering import first_ranked
from vectide.operators.search import Cells, rescore, same_length, vector_dim
from vectide.operators.topk import SearchBounds, bounded_table, list_matrix, scorable, top_k
from vectide.session import materialize

#: What rounding a score, and summing in another order, can add to it.
SLACK = 2 * 10.0 ** -SCORE_DIGITS
#: Largest table of centres that is sent to the tasks.
CENTRE_BYTES = 64 << 20


@dataclass(frozen=True)
class CellBounds:
    """Cells with what limits the scores of their vectors. A cell without vectors has a negative radius."""

    cells: Cells
    radius: np.ndarray
    greatest_norm: np.ndarray
    counts: np.ndarray

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """Greatest score that any vector of each cell can have against each query (scaled to length one for cosine)."""
        lengths = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        near = queries @ self.cells.centres.T + lengths * self.radius
        most = np.minimum(near, lengths * self.greatest_norm) + SLACK + 1e-9 * lengths * self.greatest_norm
        return np.where(self.radius < 0, -np.inf, most)


def distance_columns(vectors: DataFrame, cells: Cells, cell: str = "cell", col: str = "values") -> DataFrame:
    """Add ``cell_distance`` and ``cell_norm`` of the vector that is scored; null for one that never is (length zero under cosine)."""
    metric = cells.metric
    centres = vectors.sparkSession.sparkContext.broadcast(checked_centres(cells))

    @F.pandas_udf(T.DoubleType())
    def distance(values, own):
        import pandas as pd

        if not len(values):
            return pd.Series([], dtype=float)
        matrix = np.stack(values.to_numpy()).astype(np.float64)
        if metric == "cosine":
            lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            matrix = matrix / np.where(lengths > 0, lengths, np.nan)
        return pd.Series(np.sqrt(((matrix - centres.value[own.to_numpy()]) ** 2).sum(axis=1)))

    length = F.lit(1.0) if metric == "cosine" else norm(F.col(col))
    found = vectors.withColumn("cell_distance", F.nanvl(distance(F.col(col), F.col(cell)), F.lit(None).cast("double")))
    return found.withColumn("cell_norm", F.when(F.col("cell_distance").isNotNull(), length))


def checked_centres(cells: Cells) -> np.ndarray:
    """The centres, if they are few enough to go to every task."""
    if cells.centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"{cells.centres.nbytes} bytes of centres; {CENTRE_BYTES} at most go to a task, use fewer cells")
    return cells.centres


def cell_bounds(indexed: DataFrame, cells: Cells, cell: str = "cell") -> CellBounds:
    """Bounds of all cells from the columns of :func:`distance_columns`: one row a cell comes to the driver."""
    radius, greatest, counts = np.full(len(cells.centres), -1.0), np.zeros(len(cells.centres)), np.zeros(len(cells.centres), np.int64)
    stats = indexed.groupBy(cell).agg(F.max("cell_distance").alias("r"), F.max("cell_norm").alias("n"), F.count(F.lit(1)).alias("c"))
    for row in stats.collect():
        if row["r"] is not None:
            radius[row[cell]], greatest[row[cell]] = row["r"], row["n"]
        counts[row[cell]] = row["c"]
    return CellBounds(cells, radius, greatest, counts)


def reading_order(queries: DataFrame, bounds: CellBounds) -> DataFrame:
    """``query_id, vector, cells, uppers``: cells that hold vectors, by the greatest score they can give."""
    metric = bounds.cells.metric
    checked_centres(bounds.cells)
    schema = T.StructType([queries.schema["query_id"], queries.schema["vector"], T.StructField("cells", T.ArrayType(T.IntegerType())),
                           T.StructField("uppers", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)
    # Plain values: broadcasts do not carry classes of this package to the executors.
    sent = queries.sparkSession.sparkContext.broadcast((bounds.cells.centres, bounds.radius, bounds.greatest_norm, bounds.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, *rest = sent.value
        own = CellBounds(Cells(centres, metric), *rest)
        held = int((own.radius >= 0).sum())
        for batch in batches:
            kept, matrix = scorable(list_matrix(batch.column(1)), metric)
            uppers = own.upper(matrix) if len(kept) else np.zeros((0, len(centres)))
            order = np.argsort(-uppers, axis=1, kind="stable")[:, :held].astype(np.int32)
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(list(order), arrow.field(2).type),
                 pa.array(list(np.take_along_axis(uppers, order, 1)), arrow.field(3).type)], schema=arrow)

    return queries.select("query_id", "vector").mapInArrow(run, schema)


def best_of(parts: list[DataFrame], k: int) -> DataFrame:
    found = reduce(DataFrame.unionByName, [part.select("query_id", "id", "score") for part in parts])
    best = first_ranked(found, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k, rank="rank")
    return best.select("query_id", "rank", "id", "score")


@dataclass(frozen=True)
class CertifiedHits:
    """Hits ``query_id, rank, id, score`` and what was read for them: ``query_id, cells_read, vectors_read``."""

    hits: DataFrame
    read: DataFrame
    stored: int

    def share_read(self) -> float:
        """Share of all pairs of query and vector that were scored."""
        total = self.read.agg(F.sum("vectors_read"), F.count(F.lit(1))).first()
        return (total[0] or 0) / (self.stored * total[1]) if self.stored and total[1] else 0.0


def knn_certified(indexed: DataFrame, queries: DataFrame, bounds: CellBounds, k: int = 5, probes: int = 1, most_probes: int | None = None,
                  also: DataFrame | None = None, dim: int | None = None, search_bounds: SearchBounds = SearchBounds()) -> CertifiedHits:
    """Exact hits of ``indexed(id, values, cell)``, from as few cells as the bounds allow.

    The first round reads ``probes`` cells a query, each further one twice as
    many as the one before, so there are at most about log2(cells) rounds.
    ``most_probes`` ends the search early and so makes it approximate.
    ``also`` are vectors that no cell holds; they are all scored.
    """
    metric, centres = bounds.cells.metric, bounds.cells.centres
    dim = dim or len(centres[0])
    asked = queries.select("query_id", "vector").where(F.size("vector") == dim)
    state = materialize(reading_order(asked, bounds).withColumn("done", F.lit(0)), "reading-order")
    best = best_of([top_k(also, asked, k, metric, dim, bounds=search_bounds)] if also is not None
                 else [_no_hits(indexed, asked)], k)
    best = materialize(best, "best")
    step, limit = probes, len(centres) if most_probes is None else most_probes
    while True:
        reached = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
        open_ = F.size(F.filter("uppers", lambda u: u >= F.coalesce(F.col("_least"), F.lit(float("-inf")))))
        until = F.least(open_, F.col("done") + step, F.lit(limit))
        state = state.join(reached, "query_id", "left").withColumn("until", F.greatest("done", until)).drop("_least")
        state = materialize(state, "reading")
        probed = state.where("until > done").select("query_id", "vector", F.slice("cells", F.col("done") + 1, F.col("until") - F.col("done")).alias("cell"))
        # At most one row per cell of the index.
        wanted = [row[0] for row in probed.select(F.explode("cell")).distinct().collect()]
        if not wanted:
            break
        rows = indexed.where(F.col("cell").isin(wanted))
        found = top_k(rows, probed, k, metric, dim, cell="cell", bounds=search_bounds)
        best = materialize(best_of([best, found], k), "best")
        state = state.drop("done").withColumnRenamed("until", "done")
        step *= 2
    sizes = F.array(*[F.lit(int(n)) for n in bounds.counts])
    read = state.select("query_id", F.col("done").alias("cells_read"), F.aggregate(
        F.slice("cells", 1, F.col("done")), F.lit(0).cast("bigint"), lambda total, c: total + F.element_at(sizes, c + 1)).alias("vectors_read"))
    return CertifiedHits(best, read, int(np.maximum(bounds.counts, 0).sum()))


def _no_hits(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    spark = vectors.sparkSession
    schema = T.StructType([queries.schema["query_id"], vectors.schema["id"], T.StructField("score", T.DoubleType())])
    return spark.createDataFrame([], schema)


def probes_for_recall(indexed: DataFrame, queries: DataFrame, bounds: CellBounds, target: float, k: int = 5, sample: int = 256,
                      search_bounds: SearchBounds = SearchBounds()) -> int:
    """Cells a query has to read so that ``target`` of the exact hits are found, measured on ``sample`` queries with the least hashes."""
    drawn = queries.select("query_id", "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    drawn = materialize(drawn, "calibration")
    exact = knn_certified(indexed, drawn, bounds, k, search_bounds=search_bounds).hits
    order = reading_order(drawn, bounds).select("query_id", F.posexplode("cells").alias("place", "cell"))
    placed = exact.join(indexed.select("id", "cell"), "id").join(order, ["query_id", "cell"])
    places = dict(placed.groupBy("place").count().collect())  # at most one row a cell
    total, found = sum(places.values()), 0
    for place in sorted(places):
        found += places[place]
        if found >= target * total:
            return place + 1
    return len(bounds.counts)


# -- codes -------------------------------------------------------------------


def with_code_error(vectors: DataFrame, peak: float, metric: str, col: str = "values", code: str = "q8", output: str = "q8_error") -> DataFrame:
    """Add the length of what the int8 codes leave away."""
    values = normalize(F.col(col)) if metric == "cosine" else F.col(col)
    apart = F.zip_with(values, F.col(code), lambda x, c: x.cast("double") - c.cast("double") * F.lit(peak / INT8_MAX))
    return vectors.withColumn(output, norm(apart))


class _Candidates:
    """Running lower bounds of the best k of each query, and whatever can still reach them."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.lower = np.full((queries, k), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, lower: np.ndarray, upper: np.ndarray, ids: np.ndarray) -> None:
        merged = np.concatenate([self.lower, lower], axis=1)
        self.lower = np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k:]
        q, v = np.nonzero(upper >= self.lower.min(axis=1)[:, None])
        self.held.append((q, ids[v], lower[q, v], upper[q, v]))
        self.waiting += len(q)
        if self.waiting > 4 * self.lower.size + 100_000:
            self.prune()

    def prune(self) -> None:
        q, ids, lower, upper = (np.concatenate(c) for c in zip(*self.held))
        kept = upper >= self.lower.min(axis=1)[q]
        self.held = [(q[kept], ids[kept], lower[kept], upper[kept])]
        self.waiting = int(kept.sum())


def code_candidates(vectors: DataFrame, queries: pa.Table, k: int, metric: str, peak: float, schema: T.StructType) -> DataFrame:
    """``query_id, id, lower, upper`` of all pairs that may be among a task's best k, from the codes alone."""
    arrow = to_arrow_schema(schema)
    kept, matrix = scorable(list_matrix(queries.column(1)), metric)
    keys = queries.column(0).to_numpy()[kept]
    sent = vectors.sparkSession.sparkContext.broadcast((keys, matrix))
    dim = matrix.shape[1] if len(matrix) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix = sent.value
        narrow, lengths = matrix.astype(np.float32), np.sqrt((matrix * matrix).sum(axis=1))
        best = _Candidates(len(keys), k)
        rounding = 4 * dim * np.finfo(np.float32).eps  # of products and sums in single precision
        for batch in batches:
            if not batch.num_rows or not len(keys):
                continue
            codes = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            error, ids = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            step = max(1, 2_000_000 // len(keys))
            for at in range(0, len(ids), step):
                own = codes[at:at + step].astype(np.float32)
                size = np.sqrt((own * own).sum(axis=1)) * (peak / INT8_MAX)
                scores = (narrow @ own.T).astype(np.float64) * (peak / INT8_MAX)
                apart = lengths[:, None] * (error[at:at + step] + rounding * (size + error[at:at + step]))[None, :] + SLACK
                best.offer(scores - apart, scores + apart, ids[at:at + step])
        if best.held:
            best.prune()
            q, ids, lower, upper = best.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys[q], arrow.field(0).type), pa.array(ids, arrow.field(1).type),
                                              pa.array(lower), pa.array(upper)], schema=arrow)

    return vectors.mapInArrow(run, schema)


def knn_bounded_codes(vectors: DataFrame, queries: DataFrame, peak: float, k: int = 5, metric: str = "cosine", dim: int | None = None,
                      where: Column | None = None, search_bounds: SearchBounds = SearchBounds()) -> DataFrame:
    """Exact hits of ``vectors(id, values, q8, q8_error)``: codes rule out, floats decide among the few that are left.

    A table of queries that can't go to every task is searched on the floats.
    """
    found = vectors if where is None else vectors.where(where)
    dim = dim or vector_dim(found, "values")
    found = same_length(found, "values", dim).where(F.col("values").isNotNull())
    asked = queries.select("query_id", "vector").where(F.size("vector") == dim)
    table = bounded_table(asked, min(search_bounds.broadcast_bytes // (8 * max(1, dim)), search_bounds.many_queries))
    if table is None or not dim:
        return top_k(found, asked, k, metric, max(1, dim), bounds=search_bounds)
    schema = T.StructType([asked.schema["query_id"], found.schema["id"], T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])
    coded = vectors.where(F.size("q8") == dim) if where is None else vectors.where(where).where(F.size("q8") == dim)
    possible = materialize(code_candidates(coded.select("id", "q8", "q8_error"), table, k, metric, peak, schema), "possible")
    lows = first_ranked(possible, ["query_id"], [F.col("lower").desc(), F.col("id").asc()], k, rank="_rank")
    least = lows.groupBy("query_id").agg(F.min("lower").alias("_least"), F.count(F.lit(1)).alias("_n"))
    floor = least.select("query_id", F.when(F.col("_n") == k, F.col("_least")).otherwise(F.lit(float("-inf"))).alias("_floor"))
    left = materialize(possible.join(floor, "query_id").where(F.col("upper") >= F.col("_floor")).select("query_id", "id"), "left")
    scored = rescore(left, found, asked, metric)
    return best_of([scored], k)
