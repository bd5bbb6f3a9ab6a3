"""Searches that read part of the data must give what an exact search gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import certified, search
from vectide.operators.hits import recall
from vectide.plans.retrieval import query
from vectide.session import scratch_path
from vectide.sources.collections import open_collection
from vectide.sources.table_index import build_table_index, open_table_index

DIM = 12


def clustered(rows, seed, groups=10, spread=0.05):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(groups, DIM))
    return (centres[random.integers(groups, size=rows)] + spread * random.normal(size=(rows, DIM))).astype(np.float32)


def frame(spark, matrix, names=("id", "values"), first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{names[0]} long, {names[1]} array<float>")


@pytest.fixture(scope="module")
def tables(spark):
    matrix = np.concatenate([clustered(1500, 1), np.zeros((3, DIM), np.float32), clustered(40, 1)[:40]])
    return frame(spark, matrix).cache(), frame(spark, clustered(60, 2), ("query_id", "vector")).cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_certified_hits_are_exact(tables, metric):
    vectors, queries = tables
    cells = search.train_cells(vectors, 12, metric)
    indexed = certified.distance_columns(search.assign_cells(vectors, cells), cells).cache()
    bounds = certified.cell_bounds(indexed, cells)
    exact = search.knn(vectors, queries, 5, metric)
    found = certified.knn_certified(indexed, queries, bounds, 5)
    assert same(found.hits, exact)
    assert found.share_read() < 0.7  # clustered vectors: most cells are never read
    few = certified.knn_certified(indexed, queries, bounds, 5, most_probes=1)
    assert few.share_read() < 0.3 and recall(few.hits, exact) <= 1.0
    probes = certified.probes_for_recall(indexed, queries, bounds, 0.9)
    assert recall(certified.knn_certified(indexed, queries, bounds, 5, probes, probes).hits, exact) >= 0.9


def test_more_hits_wanted_than_there_are_and_no_rows(spark, tables):
    vectors, queries = tables
    cells = search.train_cells(vectors, 4, "cosine")
    few = vectors.where("id < 3")
    indexed = certified.distance_columns(search.assign_cells(few, cells), cells)
    bounds = certified.cell_bounds(indexed, cells)
    assert same(certified.knn_certified(indexed, queries, bounds, 9).hits, search.knn(few, queries, 9))
    none = indexed.where("id < 0")
    assert certified.knn_certified(none, queries, certified.cell_bounds(none, cells), 5).hits.isEmpty()
    assert certified.knn_certified(indexed, queries.where("query_id < 0"), bounds, 5).hits.isEmpty()


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_codes_with_error_bounds_are_exact(tables, metric):
    vectors, queries = tables
    for scale in (1.0, 50.0):
        scaled = vectors.withColumn("values", F.transform("values", lambda x: (x * F.lit(scale)).cast("float")))
        peak = search.peak_value(scaled, metric)
        coded = certified.with_code_error(search.with_codes(scaled, peak, metric), peak, metric)
        assert same(certified.knn_bounded_codes(coded, queries, peak, 5, metric), search.knn(scaled, queries, 5, metric))
        bounds = search.SearchBounds(many_queries=1)
        assert same(certified.knn_bounded_codes(coded, queries, peak, 5, metric, search_bounds=bounds), search.knn(scaled, queries, 5, metric))


def test_few_candidates_are_left(tables):
    vectors, queries = tables
    peak = search.peak_value(vectors, "ip")
    coded = certified.with_code_error(search.with_codes(vectors, peak, "ip"), peak, "ip")
    asked = queries.toArrow()
    schema = search.top_k.__globals__["hit_schema"](vectors, queries, "id")
    from pyspark.sql import types as T
    schema = T.StructType([schema["query_id"], schema["id"], T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])
    left = certified.code_candidates(coded.select("id", "q8", "q8_error").coalesce(1), asked, 5, "ip", peak, schema)
    assert left.count() < 60 * 1543 / 10


def records(spark, matrix, first=0, namespace="development"):
    rows = frame(spark, matrix, first=first)
    metadata = F.struct(F.lit("f").alias("filename"), F.lit("1").alias("size"), F.lit("2024-01-01").alias("created_at"), F.lit(1).alias("chunk"),
                        F.concat(F.lit("t"), F.col("id")).alias("text"))
    return rows.select(F.col("id").cast("string").alias("id"), "values", metadata.alias("metadata"), F.lit(namespace).alias("namespace"))


def check(table, queries, namespace="development", methods=("ivf",)):
    exact = query(table, queries, pre_vectorized=True, postprocess=False, namespace=namespace).cache()
    for method in methods:
        assert same(query(table, queries, pre_vectorized=True, postprocess=False, namespace=namespace, method=method), exact), method
    return exact


def test_index_of_a_table_follows_its_changes(spark, tables):
    queries = tables[1].limit(20).cache()
    table = open_collection(spark, scratch_path(spark, "table")).create("namespaced", dim=DIM)
    table.load(records(spark, clustered(600, 3)))
    assert open_table_index(table) is None
    build_table_index(table, cells=6)
    table.upsert(records(spark, clustered(80, 4), first=550))  # replaces 50, adds 30
    table.upsert(records(spark, clustered(20, 5), first=0, namespace="other"))
    check(table, queries, methods=("ivf", "int8"))
    index = open_table_index(table).refresh()
    assert index.newer().isEmpty() and index.rows().count() == table.read().count() == 650
    check(table, queries, "other")
    table.clear_namespace("development")
    table.upsert(records(spark, clustered(30, 6)))
    check(table, queries, methods=("int8",))
    table.compact()
    assert not open_table_index(table).current()
    check(table, queries)
    index = open_table_index(table).refresh()
    assert index.current() and index.newer().isEmpty() and index.rows().count() == 50
    table.append(records(spark, clustered(25, 7), first=5000))
    assert open_table_index(table).newer().count() == 25
    check(table, queries)
    table.clear()
    assert check(table, queries).isEmpty()
    shaped = query(table, queries, pre_vectorized=True, method="ivf")
    assert shaped.columns == query(table, queries, pre_vectorized=True).columns


def test_only_outgrown_cells_are_split(spark, tables):
    queries = tables[1].limit(20).cache()
    table = open_collection(spark, scratch_path(spark, "table")).create("namespaced", dim=DIM)
    table.load(records(spark, clustered(300, 3, groups=6)))
    built = build_table_index(table, cells=6)
    table.upsert(records(spark, clustered(2000, 3, groups=1), first=1000))
    index = open_table_index(table).refresh(outgrown=3.0)
    split = np.flatnonzero(index.bounds.counts < 0)
    assert len(split) == 1 and len(index.bounds.counts) == len(built.bounds.counts) + 2
    assert index.rows().count() == 2300 and index.bounds.counts[index.bounds.counts >= 0].sum() == 2300
    check(table, queries)
