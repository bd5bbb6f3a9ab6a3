"""Physical plans: what must and must not be in them."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from vectide.functions import text as tx
from vectide.operators import documents as docs
from vectide.operators.chunking import chunk_text
from vectide.operators.embedding import embed_hash
from vectide.operators.search import knn
from vectide.plans.ingest import IngestOptions, build_records
from vectide.plans import inputs
from vectide.session import scratch_path
from vectide.sources.collections import open_collection

NESTED_LOOPS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_text_work_stays_in_the_jvm_and_shuffles_nothing(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))
    shown = plan(embed_hash(chunk_text(documents)))
    assert "Python" not in shown and "InPandas" not in shown and "MapInArrow" not in shown
    assert "Exchange" not in shown


def test_search_prunes_before_the_shuffle(spark, sf_dir):
    shown = plan(knn(inputs.vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir), where=F.col("label") == 3))
    assert shown.count("WindowGroupLimit") >= 2
    assert not any(n in shown for n in NESTED_LOOPS)
    assert "EqualTo(label,3)" in shown
    assert "struct<vec_id:bigint,embedding:array<float>,label:int>" in shown
    assert shown.count("Exchange") <= 3


def test_blocks_need_no_nested_loops(spark, sf_dir):
    shown = plan(knn(inputs.vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir), method="block"))
    assert "FlatMapCoGroupsInArrow" in shown and not any(n in shown for n in NESTED_LOOPS)


def test_namespace_prunes_partitions(spark, sf_dir):
    collection = open_collection(spark, scratch_path(spark, "pruned")).create("namespaced", dim=64)
    collection.upsert(inputs.vector_records(spark, sf_dir))
    collection.compact()
    shown = plan(collection.search_rows().where(F.col("namespace") == "label3").select("id", "values"))
    assert "PartitionFilters: [isnotnull(namespace" in shown and "label3" in shown
    # Text and metadata are not read for scoring.
    assert "filename" not in shown


def test_rejects_do_not_read_the_text(spark, sf_dir):
    named = inputs.table(spark, sf_dir, "documents").withColumn("filename", F.concat("doc_id", F.lit(".pdf")))
    _, missing = docs.attach_metadata(named, inputs.sidecar(spark, sf_dir), "doc_id")
    assert "text" not in plan(missing)


def test_content_ids_need_no_shuffle_of_the_text(spark, sf_dir):
    named = inputs.table(spark, sf_dir, "documents").withColumn("filename", F.concat("doc_id", F.lit(".pdf")))
    records, _ = build_records(named, inputs.sidecar(spark, sf_dir), IngestOptions(dim=64))
    shown = plan(records)
    assert "SortMergeJoin" not in shown and "hashpartitioning" not in shown


def test_hot_digest_is_split(spark):
    """A digest that holds half of the documents does not end up in one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings if spark.conf.get(k, None) is not None}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        documents = spark.range(0, 20_000, 1, 16).select(
            F.col("id").alias("doc_id"),
            F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("filename"),
            F.repeat(F.sha2(F.col("id").cast("string"), 256), 5).alias("text"),
        )
        sidecar = spark.range(0, 20_000).select(
            F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"),
            F.col("id").alias("file_size"), F.lit("2024-01-01").alias("date"), F.col("id").alias("pos"),
        )
        kept, _ = docs.attach_metadata(documents, sidecar, "doc_id")
        assert len(kept.collect()) == 20_000
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            if key in before:
                spark.conf.set(key, before[key])
            else:
                spark.conf.unset(key)


def test_hot_digest_in_the_sidecar_is_reduced_before_the_shuffle(spark):
    sidecar = spark.range(0, 1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"),
        F.col("id").alias("file_size"), F.lit("2024").alias("date"), (-F.col("id")).alias("pos"),
    )
    first = docs.first_sidecar_rows(sidecar)
    assert first.where("digest = 'hot'").collect()[0]["pos"] == -999
    assert plan(first).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("n", [0, None, 3, 10_000])
def test_limits(spark, sf_dir, n):
    documents = inputs.table(spark, sf_dir, "documents")
    expected = sorted(r[0] for r in documents.select("doc_id").collect())[: n or None]
    assert sorted(r[0] for r in docs.limit_documents(documents, "doc_id", n).select("doc_id").collect()) == expected


def test_limit_counts_rows_of_repeated_keys(spark):
    rows = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate([2, 1, 1, None, 1, 3, 2])], "doc_id long, text string")
    for n in range(1, 9):
        found = [r[0] for r in docs.limit_documents(rows, "doc_id", n).collect()]
        assert sorted(found, key=lambda k: (k is None, k)) == [1, 1, 1, 2, 2, 3, None][:n]


def test_rows_of_a_namespace_do_not_meet_in_one_task(spark):
    """Reading a table whose changes are too many to broadcast: no join by the namespace alone."""
    collection = open_collection(spark, scratch_path(spark, "namespaces")).create("namespaced", dim=2)
    rows = spark.range(20).selectExpr(
        "cast(id as string) as id", "array(1.0f, 2.0f) as values",
        "named_struct('filename', 'f', 'size', '1', 'created_at', 'd', 'chunk', 1, 'text', 't') as metadata", "if(id < 15, 'a', 'b') as namespace")
    collection.upsert(rows)
    collection.clear_namespace("b")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = collection.read()
        shown = plan(found)
        assert found.count() == 15
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not re.search(r"SortMergeJoin \[namespace#\d+\]", shown)
