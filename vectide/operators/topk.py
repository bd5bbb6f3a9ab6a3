"""Exact top-k scoring inside Arrow batches.

Scoring every query against every vector is the work itself, but the pairs
never become rows: each task keeps the best k per query in memory and emits
only those. ``first_ranked`` then merges the survivors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vectide.functions.vectors import SCORE_DIGITS
from vectide.operators.ordering import first_ranked
from vectide.session import materialize

# Scores held at once while a batch is compared (4 MB), and the queries they are of.
SCORES_AT_ONCE = 1_000_000
QUERIES_AT_ONCE = 1_024
# Pairs scored in double precision at once, and new hits that may wait to be merged.
PAIRS_AT_ONCE = 50_000
WAITING_HITS = 2_000_000
ROUNDING_SLACK = 10.0 ** -SCORE_DIGITS
# Products of lengths up to here stay within single precision.
SINGLE_MOST = 1e30


@dataclass(frozen=True)
class SearchBounds:
    """Sizes that decide how queries reach the vectors."""

    broadcast_bytes: int = 64 << 20
    """Largest table of queries, or else of vectors, shipped whole to every task."""
    many_queries: int = 8_192
    """With more queries than this, fewer vectors than queries are shipped instead."""
    state_rows: int = 4_000_000
    """Largest number of kept hits (queries x k) per task."""
    block_vectors: int = 20_000
    """Vectors per block, the least share of them that is dealt out when both sides are shuffled."""
    block_queries: int = 4_096
    """Queries per block, likewise."""
    tile_bytes: int = 32 << 20
    """Vectors, or else queries, of as many blocks as one task holds at once when both sides are shuffled."""


def list_matrix(column: pa.Array | pa.ChunkedArray, narrow: bool = False) -> np.ndarray:
    """Matrix of a list column whose lists all have the same length; ``narrow`` keeps single precision where that is exact."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.result_type(flat.dtype, np.float32) if narrow else np.float64, copy=False)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def scorable(matrix: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows that have a score, and those rows, ready for a product.

    For cosine they are scaled to length one; a row of length zero has none,
    and neither does a row with an element that is not finite.
    """
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.isfinite(lengths) & ((lengths > 0) | (metric != "cosine"))
    kept = np.nonzero(usable)[0]
    if len(kept) < len(matrix):
        matrix, lengths = matrix[kept], lengths[kept]
    return kept, matrix / lengths[:, None] if metric == "cosine" else matrix


class BestHits:
    """Running best ``k`` hits of each query: higher score first, then lower id.

    New hits wait until there are as many as kept ones, so that merging costs
    little however many queries there are.
    """

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.ids: np.ndarray | None = None
        self._waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting_rows = 0

    def offer(self, rows: np.ndarray, vectors: "Rows", ids: np.ndarray, queries: "Rows") -> None:
        """Score the queries at positions ``rows`` against a batch of vectors.

        Single precision rules out whatever can't be a hit, by its greatest
        error; the few pairs that are left are scored in double precision.
        """
        step = max(1, SCORES_AT_ONCE // max(1, min(len(rows), QUERIES_AT_ONCE)))
        single = queries.longest() * vectors.longest() <= SINGLE_MOST
        asked = [(slice(at, at + QUERIES_AT_ONCE), queries[at:at + QUERIES_AT_ONCE]) for at in range(0, len(rows), QUERIES_AT_ONCE)]
        for start in range(0, len(ids), step):
            stored = vectors[start:start + step]
            scaled = stored.scaled(single).T
            for here, own in asked:
                self._score(rows[here], stored, scaled, ids[start:start + step], own, single)
            if self._waiting_rows >= len(self.query):
                self.merge()

    def _score(self, rows, vectors, scaled, ids, queries, single) -> None:
        scores = queries.scaled(single) @ scaled
        least = self.floor[rows]
        if len(ids) > self.k and np.isneginf(least).any():
            kth = len(ids) - self.k
            least = np.maximum(least, np.partition(scores, kth, axis=1)[:, kth])
        # The slack keeps every score that rounds to the least one or more:
        # between equal scores the id decides. Only survivors are rounded.
        precision = np.finfo(scores.dtype).eps * (len(scaled) + 4)
        slack = ROUNDING_SLACK + 2 * precision * queries.lengths * vectors.longest()
        bound = least - slack
        if single:
            bound = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
        at, hit = np.divmod(np.flatnonzero(scores >= bound[:, None]), scores.shape[1])
        for some in range(0, len(at), PAIRS_AT_ONCE):
            q, v = at[some:some + PAIRS_AT_ONCE], hit[some:some + PAIRS_AT_ONCE]
            exact = np.round(queries.pairs(q, vectors, v), SCORE_DIGITS)
            good = exact >= self.floor[rows[q]]
            self._waiting.append((rows[q[good]], exact[good], ids[v[good]]))
            self._waiting_rows += int(good.sum())
            if self._waiting_rows >= max(WAITING_HITS, len(self.query)):
                self.merge()

    def merge(self) -> None:
        if not self._waiting:
            return
        kept = [] if self.ids is None else [(self.query, self.score, self.ids)]
        query, score, ids = (np.concatenate(part) for part in zip(*kept, *self._waiting))
        self._waiting, self._waiting_rows = [], 0
        tie = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((tie, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        self.query, self.score, self.ids = query[best], score[best], ids[best]
        full = place[best] == self.k - 1
        self.floor[self.query[full]] = self.score[full]


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def hit_schema(vectors: DataFrame, queries: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", vectors.schema[id_col].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _record(best: BestHits, query_ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    best.merge()
    ids = best.ids if best.ids is not None else []
    names = schema.names
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query_ids[best.query], type=schema.field(names[0]).type),
            pa.array(ids, type=schema.field(names[1]).type),
            pa.array(best.score, type=pa.float64()),
        ],
        schema=schema,
    )


@dataclass(frozen=True)
class Rows:
    """Vectors as they are stored, with their lengths, and what scales a score of theirs under cosine."""

    matrix: np.ndarray
    lengths: np.ndarray
    scale: np.ndarray | None

    def __getitem__(self, rows) -> "Rows":
        return Rows(self.matrix[rows], self.lengths[rows], None if self.scale is None else self.scale[rows])

    def longest(self) -> float:
        return float(self.lengths.max(initial=0.0))

    def scaled(self, single: bool) -> np.ndarray:
        """What is multiplied: rows of length one under cosine."""
        matrix = self.matrix if self.scale is None else self.matrix * self.scale[:, None]
        return matrix.astype(np.float32 if single else np.float64, copy=False)

    def pairs(self, rows: np.ndarray, other: "Rows", others: np.ndarray) -> np.ndarray:
        """Scores of rows of both in double precision."""
        scores = np.einsum("ij,ij->i", self.matrix[rows].astype(np.float64), other.matrix[others].astype(np.float64))
        return scores if self.scale is None else scores * self.scale[rows] * other.scale[others]


@dataclass(frozen=True)
class Side:
    """Vectors or queries in memory: keys, scorable rows, and their positions by cell."""

    keys: np.ndarray
    rows: Rows
    by_cell: dict

    def values(self) -> tuple:
        return self.keys, (self.rows.matrix, self.rows.lengths, self.rows.scale), self.by_cell

    @staticmethod
    def of_values(keys: np.ndarray, rows: tuple, by_cell: dict) -> "Side":
        return Side(keys, Rows(*rows), by_cell)

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table, metric: str, cell: bool) -> "Side":
        """From columns key, vector and, if cells are used, cell, in this order.

        A vector that is not finite has no score, nor under cosine one of
        length zero.
        """
        matrix = list_matrix(batch.column(1), narrow=True)
        lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))
        kept = np.nonzero(np.isfinite(lengths) & ((lengths > 0) | (metric != "cosine")))[0]
        if len(kept) < len(matrix):
            matrix, lengths = matrix[kept], lengths[kept]
        rows = Rows(matrix, np.ones(len(kept)), 1 / lengths) if metric == "cosine" else Rows(matrix, lengths, None)
        keys = _ids(batch.column(0))[kept]
        if not cell:
            return Side(keys, rows, {None: np.arange(len(keys))})
        cells = _ids(batch.column(2))[kept]
        return Side(keys, rows, {c: np.nonzero(cells == c)[0] for c in np.unique(cells)})


def _search_cells(best: BestHits, rows: np.ndarray, queries: Side, vectors: Side) -> None:
    for c, here in vectors.by_cell.items():
        asked = queries.by_cell.get(c)
        if asked is not None and len(asked) and len(here):
            best.offer(rows[asked], vectors.rows[here], vectors.keys[here], queries.rows[asked])


def _at_vectors(vectors: DataFrame, queries: pa.Table, schema: T.StructType, k: int, metric: str,
                cell: bool) -> DataFrame:
    """Ship the (bounded) queries; vectors stay where they are, so no key can be hot."""
    arrow_schema = to_arrow_schema(schema)
    side = Side.of(queries, metric, cell)
    query_ids, rows = np.unique(side.keys, return_inverse=True)
    # Plain values: broadcasts do not carry classes of this package to the executors.
    shipped = vectors.sparkSession.sparkContext.broadcast((query_ids, rows, side.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, rows, values = shipped.value
        queries, best = Side.of_values(*values), BestHits(len(query_ids), k)
        for batch in batches:
            if batch.num_rows:
                _search_cells(best, rows, queries, Side.of(batch, metric, cell))
        yield _record(best, query_ids, arrow_schema)

    return vectors.mapInArrow(run, schema)


def _at_queries(queries: DataFrame, vectors: pa.Table, schema: T.StructType, k: int, metric: str,
                cell: bool) -> DataFrame:
    """Ship the (bounded) vectors; any number of queries stays where it is."""
    arrow_schema = to_arrow_schema(schema)
    shipped = queries.sparkSession.sparkContext.broadcast(Side.of(vectors, metric, cell).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Side.of_values(*shipped.value)
        for batch in batches:
            if batch.num_rows:
                yield _hits_of(Side.of(batch, metric, cell), vectors, k, arrow_schema)

    return queries.mapInArrow(run, schema)


def _hits_of(queries: Side, vectors: Side, k: int, schema: pa.Schema) -> pa.RecordBatch:
    query_ids, rows = np.unique(queries.keys, return_inverse=True)
    best = BestHits(len(query_ids), k)
    _search_cells(best, rows, queries, vectors)
    return _record(best, query_ids, schema)


def _in_blocks(vectors: DataFrame, queries: DataFrame, schema: T.StructType, k: int, metric: str, dim: int,
               cell: str | None, bounds: SearchBounds) -> DataFrame:
    """Shuffle both sides into tiles of bounded size; the way beyond a broadcast."""
    arrow_schema = to_arrow_schema(schema)
    left, right, tile = dealt_tiles(vectors, queries, dim, cell, bounds)

    def score(stored: pa.Table, asked: pa.Table) -> pa.Table:
        if stored.num_rows == 0 or asked.num_rows == 0:
            return arrow_schema.empty_table()
        sides = [Side.of(table, metric, cell=False) for table in (asked, stored)]
        return pa.Table.from_batches([_hits_of(*sides, k, arrow_schema)])

    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(score, schema)


def dealt_tiles(vectors: DataFrame, queries: DataFrame, dim: int, cell: str | None,
                bounds: SearchBounds) -> tuple[DataFrame, DataFrame, list[str]]:
    """Vectors and queries, a row for each tile they are in, and the columns of a tile.

    The blocks of vectors and of queries of a cell are a grid, which is cut
    into tiles: as many blocks of either side as ``tile_bytes`` allow, or fewer
    so that every core has some tiles. A task meets all blocks of its tile, so
    a row is sent once for each tile across, not for each block. Rows are dealt
    out at random rather than by id, so copies of one row spread too, and the
    draw is written down so that a repeated task sees the same one.
    """
    spark = vectors.sparkSession
    if cell is None:
        cell = "_cell"
        vectors, queries = (df.withColumn(cell, F.lit(0)) for df in (vectors, queries))
    stored, asked = (materialize(df.withColumn("_draw", F.rand()), label) for df, label in ((vectors, "drawn-v"), (queries, "drawn-q")))
    asked = _each_cell(asked, cell)
    counts = [df.groupBy(cell).agg(F.count(F.lit(1)).alias(name)) for df, name in ((stored, "_v"), (asked, "_q"))]
    # One row per cell that both sides use.
    met = materialize(counts[0].join(counts[1], cell), "met")
    pairs = met.agg(F.sum(F.col("_v").cast("double") * F.col("_q"))).first()[0] or 1.0
    rows = max(1, bounds.tile_bytes // (8 * max(1, dim)))
    wanted = F.lit(3.0 * spark.sparkContext.defaultParallelism / pairs) * F.col("_v") * F.col("_q")

    def tiles(own: str, other: str, block: int) -> Column:
        """Shares of one side of a cell: near squares, since each row goes to all tiles across."""
        least = F.ceil(F.col(own) / F.lit(max(rows, block)))
        square = F.ceil(F.sqrt(wanted * F.col(own) / F.col(other)))
        return F.greatest(least, F.least(square, F.ceil(F.col(own) / F.lit(block)))).cast("int")

    grid = met.select(cell, tiles("_v", "_q", bounds.block_vectors).alias("_nv"), tiles("_q", "_v", bounds.block_queries).alias("_nq"))

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        share = F.floor(F.col("_draw") * F.col(f"_n{own}")).cast("int").alias(f"_{own}")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)).alias(f"_{other}")
        return df.join(grid, cell).select(*[c for c in df.columns if c != "_draw"], share, copies)

    return deal(stored, "v", "q"), deal(asked, "q", "v"), [cell, "_v", "_q"]


def _each_cell(queries: DataFrame, cell: str | None) -> DataFrame:
    """A row for each cell of a query that names several."""
    several = cell is not None and isinstance(queries.schema[cell].dataType, T.ArrayType)
    return queries.withColumn(cell, F.explode(cell)) if several else queries


def bounded_table(df: DataFrame, most: int) -> pa.Table | None:
    """The rows if there are at most ``most``, else ``None``.

    The check takes bare markers and stops as soon as it has seen one too many,
    so a large table is neither scanned nor shuffled for it.
    """
    seen = len(df.select(F.lit(1).alias("seen")).take(most + 1))
    return df.toArrow() if seen <= most else None


def _local_hits(vectors: DataFrame, queries: DataFrame, schema: T.StructType, k: int, metric: str, dim: int,
                cell: str | None, bounds: SearchBounds) -> DataFrame:
    """Hits that only need merging: ship the side that provably fits, else shuffle blocks."""
    shippable = bounds.broadcast_bytes // (8 * max(1, dim))
    several, queries = queries, _each_cell(queries, cell)
    asked = bounded_table(queries, min(shippable, bounds.state_rows // k))
    if asked is not None and asked.num_rows <= bounds.many_queries:
        return _at_vectors(vectors, asked, schema, k, metric, bool(cell))
    most = shippable if asked is None else min(shippable, asked.num_rows)
    stored = bounded_table(vectors, most)
    if stored is not None:
        return _at_queries(queries, stored, schema, k, metric, bool(cell))
    if asked is not None:
        return _at_vectors(vectors, asked, schema, k, metric, bool(cell))
    return _in_blocks(vectors, several, schema, k, metric, dim, cell, bounds)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    dim: int,
    cell: str | None = None,
    blocks: bool = False,
    bounds: SearchBounds = SearchBounds(),
) -> DataFrame:
    """Best ``k`` vectors of each query: ``query_id, rank, id, score``.

    ``vectors`` holds ``id, values`` and ``queries`` holds ``query_id, vector``;
    with ``cell`` both also hold that column and meet only within it. A query's
    may be an array of cells, each of which it is searched in.
    """
    if metric not in ("cosine", "ip"):
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        raise ValueError("k must be positive")
    cells = [cell] if cell else []
    stored = vectors.select("id", "values", *cells).where(F.size("values") == dim)
    asked = queries.select("query_id", "vector", *cells).where(F.size("vector") == dim)
    schema = hit_schema(stored, asked, "id")
    if blocks:
        local = _in_blocks(stored, asked, schema, k, metric, dim, cell, bounds)
    else:
        local = _local_hits(stored, asked, schema, k, metric, dim, cell, bounds)
    best = first_ranked(local, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k, rank="rank")
    return best.select("query_id", "rank", "id", "score")
