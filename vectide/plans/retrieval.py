"""Queries as text or vectors to shaped hits."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.operators.embedding import Encoder, embed, hash_encoder_factory
from vectide.operators.evaluation import replicate_workload
from vectide.operators.hits import hydrate_hits, shape_hits
from vectide.operators.layouts import DEFAULT_NAMESPACE, EXTRA
from vectide.operators.search import knn
from vectide.session import materialize
from vectide.sources.collections import Collection
from vectide.sources.table_index import open_table_index
from vectide.sources.sinks import dump_results


def encode_queries(
    prompts: DataFrame, dim: int = 64, encoder_factory: Callable[[], Encoder] | None = None
) -> DataFrame:
    """``query_id, text`` to ``query_id, vector``."""
    factory = encoder_factory or hash_encoder_factory(dim)
    return embed(prompts.select("query_id", "text"), "text", factory, dim, output="vector").select("query_id", "vector")


def search(
    stored: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    where: Column | None = None,
    namespace: str | None = None,
    include_metadata: bool = True,
    include_text: bool = True,
    include_vectors: bool = False,
    method: str = "exact",
    dim: int | None = None,
) -> DataFrame:
    """Shaped hits of pre-encoded queries on ``id, values, metadata, text`` rows.

    Scoring reads ids and vectors only; metadata and text are fetched for the
    hits, and only if asked for.
    """
    hits = knn(stored, queries, k, metric, where, namespace, method, dim)
    found = stored if namespace is None else stored.where(F.col("namespace") == namespace)
    return shaped(hits, found if where is None else found.where(where), include_metadata, include_text, include_vectors)


def shaped(hits: DataFrame, stored: DataFrame, include_metadata: bool = True, include_text: bool = True, include_vectors: bool = False) -> DataFrame:
    """Bare hits with metadata, text and vectors of ``stored``, as far as they are asked for."""
    wanted = [
        name
        for name, used in (
            ("metadata", include_metadata), (EXTRA, include_metadata and EXTRA in stored.columns),
            ("text", include_text), ("values", include_vectors),
        )
        if used
    ]
    hydrated = hydrate_hits(hits, stored, wanted) if wanted else hits
    for name, used in (("metadata", include_metadata), ("text", include_text)):
        if not used:
            hydrated = hydrated.withColumn(name, F.lit(None).cast(stored.schema[name].dataType))
    return shape_hits(hydrated, text="text", include_metadata=include_metadata, include_text=include_text,
                      vector="values" if include_vectors else None)


def text_search(
    stored: DataFrame,
    prompts: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    dim: int = 64,
    encoder_factory: Callable[[], Encoder] | None = None,
    **options,
) -> DataFrame:
    """Encode the prompts once with the encoder of the table, then search."""
    encoded = materialize(encode_queries(prompts, dim, encoder_factory), "queries")
    return search(stored, encoded, k, metric, dim=dim, **options)


def query(
    collection: Collection,
    asked: DataFrame,
    top_k: int = 5,
    include_metadata: bool = True,
    include_text: bool = True,
    include_vectors: bool = False,
    postprocess: bool = True,
    pre_vectorized: bool = False,
    namespace: str | None = None,
    where: Column | Mapping | None = None,
    encoder_factory: Callable[[], Encoder] | None = None,
    method: str = "exact",
) -> DataFrame:
    """Query a vector table with its own metric and dimension.

    ``ivf`` and ``int8`` go through the table's own index, if it has one, with
    the same hits as ``exact``. Conditions on columns that the index does not
    hold (``where``) are always searched exactly; they are a predicate on the
    table's rows or a filter description for :meth:`Collection.condition`.

    ``asked`` holds ``query_id, text``, or ``query_id, vector`` when it is
    ``pre_vectorized``. Without ``postprocess`` the hits are bare:
    ``query_id, rank, id, score``. A namespaced table is searched in one
    namespace, by default the default one.
    """
    found = collection.properties()
    rows, metric, dim = collection.search_rows(), found["metric"], found["dim"]
    if isinstance(where, Mapping):
        where = collection.condition(where)
    if "namespace" in rows.columns and namespace is None:
        namespace = DEFAULT_NAMESPACE
    vectors = asked if pre_vectorized else materialize(encode_queries(asked, dim, encoder_factory), "queries")
    index = open_table_index(collection) if method != "exact" and where is None else None
    hits = index.search(vectors, top_k, method, namespace) if index else None
    if not postprocess:
        return hits if hits is not None else knn(rows, vectors, top_k, metric, where, namespace, dim=dim)
    if hits is not None:
        found = rows if namespace is None else rows.where(F.col("namespace") == namespace)
        return shaped(hits, found, include_metadata, include_text, include_vectors)
    return search(rows, vectors, top_k, metric, where, namespace, include_metadata, include_text, include_vectors, dim=dim)


def quality_run(stored: DataFrame, prompts: DataFrame, path: str, k: int = 5, **options) -> None:
    """Shaped hits of every prompt, written as JSON for inspection."""
    dump_results(text_search(stored, prompts, k, **options), path)


def workload_run(
    stored: DataFrame, queries: DataFrame, iterations: int = 100, k: int = 5, metric: str = "cosine",
    dim: int | None = None,
) -> DataFrame:
    """Search every pre-encoded query once per iteration, as one job."""
    requests = replicate_workload(queries.select("query_id", "vector"), iterations)
    hits = knn(stored, requests.select(F.col("request_id").alias("query_id"), "vector"), k, metric, dim=dim)
    return hits.select(
        F.floor(F.col("query_id") / F.lit(iterations)).cast("bigint").alias("query_id"),
        F.pmod(F.col("query_id"), F.lit(iterations)).cast("bigint").alias("iteration"),
        "rank", "id", "score",
    )
