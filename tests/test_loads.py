"""Loads keep what is there, and nothing of another length gets in or goes missing."""

import pytest
from pyspark.sql import functions as F

from vectide.operators import layouts
from vectide.operators.embedding import embed, embed_hash, hash_encoder_factory
from vectide.operators.search import knn
from vectide.plans import inputs
from vectide.session import scratch_path
from vectide.sources.collections import open_collection
from vectide.sources.documents import DOCUMENTS
from vectide.streaming.ingest import stream_documents, write_batches


def test_a_query_of_another_length_changes_no_other_hits(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "id long, values array<float>")
    queries = spark.createDataFrame([(0, [1.0]), (1, [1.0, 0.1, 0.0]), (2, [0.0, 1.0, 0.2])], "query_id long, vector array<float>")
    for method in ("exact", "block", "int8"):
        found = knn(vectors, queries.coalesce(1), 1, "ip", method=method).collect()
        assert sorted((r["query_id"], r["id"]) for r in found) == [(1, 1), (2, 2)]


def test_vectors_of_mixed_length_fail_the_search(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, values array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vector array<float>")
    for method in ("exact", "block", "int8"):
        with pytest.raises(Exception, match="a vector of 1 elements among those of 2"):
            knn(vectors, queries, 1, "ip", method=method).collect()


def test_vectors_that_a_filter_takes_out_may_have_another_length(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0])], "id long, values array<float>").repartition(2)
    queries = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vector array<float>")
    for method in ("exact", "block", "int8"):
        assert [r["id"] for r in knn(vectors, queries, 5, "ip", where=F.col("id") != 2, method=method).orderBy("rank").collect()] == [1, 3]


@pytest.mark.parametrize("layout", layouts.SCHEMAS)
def test_writes_refuse_vectors_of_another_length(spark, sf_dir, layout):
    table = open_collection(spark, scratch_path(spark, layout)).create(layout, dim=10)
    rows = layouts.LAYOUTS[layout](inputs.vector_records(spark, sf_dir))
    for write in (table.append, table.upsert, table.load):
        with pytest.raises(Exception, match="wrong_dimension"):
            write(rows)
    assert table.read().count() == 0


def test_faults_of_the_code_fail_the_stream(spark, sf_dir):
    arriving = scratch_path(spark, "arriving")
    inputs.table(spark, sf_dir, "documents").limit(5).write.parquet(arriving)
    with pytest.raises(Exception, match="no_such_column"):
        write_batches(
            stream_documents(spark, arriving, schema=DOCUMENTS), lambda batch, n: batch.select("no_such_column").count(),
            scratch_path(spark, "checkpoint"), scratch_path(spark, "dead"),
        ).awaitTermination()


def test_both_encoders_agree_on_letters_that_libraries_lower_differently(spark):
    rows = spark.createDataFrame([("ΟΔΟΣ ΣΟΦΟΣ",), ("İSTANBUL Straße",), (None,)], "text string")
    ours = embed(rows, "text", hash_encoder_factory(64), 64)
    assert ours.columns == ["text", "values"]
    other = embed_hash(rows.withColumn("text", F.coalesce("text", F.lit(""))), dim=64)
    assert [r["values"] for r in ours.collect()] == [r["values"] for r in other.collect()]
