"""Ingest in batch and as a stream, retrieval plans and reports."""

import datetime

import pytest
from pyspark.sql import functions as F

from vectide.functions.text import clean_text
from vectide.operators import evaluation
from vectide.plans import inputs, registered
from vectide.plans.ingest import IngestOptions, build_records, ingest_run
from vectide.plans.retrieval import query, search, text_search, workload_run
from vectide.session import scratch_path
from vectide.sources.collections import open_collection
from vectide.sources.documents import DOCUMENTS
from vectide.streaming.ingest import stream_documents, stream_ingest, write_batches


@pytest.fixture
def named(spark, sf_dir):
    return inputs.extracted_documents(spark, sf_dir).withColumn("filename", F.concat("doc_id", F.lit(".pdf")))


def test_every_document_is_accounted_for(spark, sf_dir, named):
    records, rejects = build_records(named, inputs.sidecar(spark, sf_dir), IngestOptions(dim=64))
    chunked = records.select(F.regexp_extract("metadata.filename", r"^\d+", 0).cast("bigint").alias("doc_id")).distinct()
    rejected = rejects.select("doc_id")
    emptied = named.where((F.length("text") > 0) & (clean_text(F.col("text")) == "")).select("doc_id")
    assert chunked.intersect(rejected).count() == 0
    # Cleaning may empty a document that is rejected for another reason as well.
    assert named.select("doc_id").subtract(chunked).subtract(rejected).subtract(emptied).count() == 0
    assert records.select("id").distinct().count() == records.count()


def test_ingest_twice_gives_the_same_table(spark, sf_dir, named):
    sidecar = inputs.sidecar(spark, sf_dir)
    tables = [open_collection(spark, scratch_path(spark, n)).create(n, dim=64) for n in ("typed", "namespaced")]
    options = IngestOptions(dim=64, ids="dense")
    ingest_run(named, sidecar, tables, options)
    first = [t.read().toPandas().astype(str).sort_values("id").reset_index(drop=True) for t in tables]
    rejects = ingest_run(named, sidecar, tables, options)
    second = [t.read().toPandas().astype(str).sort_values("id").reset_index(drop=True) for t in tables]
    assert all(a.equals(b) for a, b in zip(first, second))
    assert rejects.count() > 0
    ids = sorted(int(i) for i in first[0]["id"])
    assert ids == list(range(len(ids)))


def test_repeated_documents_are_loaded_once(spark, sf_dir):
    named = inputs.named_documents(spark, sf_dir)
    tables = [open_collection(spark, scratch_path(spark, "repeated")).create("namespaced", dim=64) for _ in range(2)]
    ingest_run(named, inputs.sidecar(spark, sf_dir), tables[:1], IngestOptions(dim=64))
    ingest_run(named.unionByName(named), inputs.sidecar(spark, sf_dir), tables[1:], IngestOptions(dim=64))
    once, twice = (t.read().select("id", "values") for t in tables)
    assert twice.count() == once.count() > 0
    assert twice.exceptAll(once).count() == 0


def test_options(spark, sf_dir, named):
    sidecar = inputs.sidecar(spark, sf_dir)
    with pytest.raises(ValueError):
        build_records(named, sidecar, IngestOptions(dim=64, ids="random"))
    with pytest.raises(ValueError):
        build_records(named, sidecar, IngestOptions(dim=64, size=6000))
    few, rejects = build_records(named, sidecar, IngestOptions(dim=64, limit=20))
    documents = few.select("metadata.filename").distinct().count() + rejects.count()
    assert documents == 20


def test_stream_equals_batch_and_restarts(spark, sf_dir):
    arriving, checkpoint, dead = (scratch_path(spark, n) for n in ("arriving", "checkpoint", "dead"))
    documents, sidecar = inputs.table(spark, sf_dir, "documents"), inputs.sidecar(spark, sf_dir)
    documents.repartition(3, "source").write.parquet(arriving)
    collection = open_collection(spark, scratch_path(spark, "streamed")).create("namespaced", dim=64)
    # Batch numbers that were cleared before must not swallow the stream's batches.
    old, _ = build_records(inputs.named_documents(spark, sf_dir), sidecar, IngestOptions(dim=64, limit=5))
    collection.upsert(old.withColumn("namespace", F.lit("development")), batch=50)
    collection.clear()

    def run():
        stream = stream_documents(spark, arriving, 1, DOCUMENTS).withColumn("filename", F.concat("doc_id", F.lit(".pdf")))
        stream_ingest(stream, sidecar, collection, checkpoint, IngestOptions(dim=64), dead).awaitTermination()
        return collection.read().select("id", "values", "metadata.text").toPandas().sort_values("id").reset_index(drop=True)

    first = run()
    records, rejects = build_records(inputs.named_documents(spark, sf_dir), sidecar, IngestOptions(dim=64))
    batch = records.select("id", "values", "metadata.text").toPandas().sort_values("id").reset_index(drop=True)
    assert first.astype(str).equals(batch.astype(str))
    assert run().astype(str).equals(first.astype(str))
    recorded = spark.read.schema("doc_id bigint, reason string").parquet(dead).select("doc_id", "reason")
    assert sorted(map(tuple, recorded.collect())) == sorted(map(tuple, rejects.collect()))
    # A new file brings its rows, a compaction between runs changes nothing.
    collection.compact()
    documents.limit(10).withColumn("doc_id", F.col("doc_id")).write.mode("append").parquet(arriving)
    assert run().astype(str).equals(first.astype(str))


def test_a_failing_stream_without_dead_letters_fails(spark, sf_dir):
    arriving = scratch_path(spark, "arriving")
    inputs.table(spark, sf_dir, "documents").write.parquet(arriving)

    def write(batch, number):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        write_batches(stream_documents(spark, arriving), write, scratch_path(spark, "checkpoint")).awaitTermination()


def test_search_switches(spark, sf_dir):
    collection = open_collection(spark, scratch_path(spark, "table")).create("namespaced", dim=64)
    collection.upsert(inputs.vector_records(spark, sf_dir))
    queries = inputs.vector_queries(spark, sf_dir).where("query_id < 4")
    rows = collection.search_rows()
    full = search(rows, queries, namespace="label3", include_vectors=True).collect()
    assert {r["metadata"]["filename"] for r in full} == {"set3"} and len(full) == 20
    assert all(r["text"].startswith("first ") and len(r["values"]) == 64 for r in full)
    assert "created_at" not in full[0]["metadata"].asDict() and "text" not in full[0]["metadata"].asDict()
    bare = search(rows, queries, include_metadata=False, include_text=False).collect()
    assert all(r["metadata"] is None and r["text"] is None for r in bare)
    assert search(rows, queries, method="int8").count() == 20
    typed = open_collection(spark, scratch_path(spark, "typed")).create("typed", dim=64)
    from vectide.operators.layouts import to_typed_layout
    typed.append(to_typed_layout(inputs.vector_records(spark, sf_dir)))
    assert all('"chunk"' in r["metadata"] for r in search(typed.search_rows(), queries, metric="ip").collect())


def test_query_uses_the_tables_own_settings(spark, sf_dir):
    queries = inputs.vector_queries(spark, sf_dir).where("query_id < 4")
    table = open_collection(spark, scratch_path(spark, "asked")).create("namespaced", dim=64)
    table.load(inputs.vector_records(spark, sf_dir))
    assert query(table, queries, pre_vectorized=True).count() == 0
    bare = query(table, queries, 2, pre_vectorized=True, postprocess=False, namespace="label1")
    assert bare.columns == ["query_id", "rank", "id", "score"] and bare.count() == 8
    shaped = query(table, queries, 2, pre_vectorized=True, namespace="label1", where=F.col("id") != "0")
    assert shaped.select("query_id", "rank", "id", "score").exceptAll(bare).count() == 0
    prompts = inputs.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    assert query(table, prompts, 1, namespace="label2").count() == 40


def test_text_search_finds_the_text_itself(spark):
    rows = spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(["red fox jumps", "blue whale sings", "green frog sits"])], "id string, text string"
    )
    from vectide.operators.embedding import embed_hash
    stored = embed_hash(rows, dim=64).withColumn("metadata", F.struct(F.lit("x").alias("filename")))
    prompts = spark.createDataFrame([(1, "the blue whale"), (2, "...")], "query_id bigint, text string")
    found = text_search(stored, prompts, k=1).collect()
    # A prompt without words has no direction and finds nothing.
    assert [(r["query_id"], r["id"]) for r in found] == [(1, "1")]


def test_workload_repeats_every_query(spark, sf_dir):
    vectors, queries = inputs.vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir).where("query_id < 8")
    found = workload_run(vectors, queries, iterations=30, k=2).toPandas()
    assert len(found) == 8 * 30 * 2
    assert (found.groupby(["query_id", "rank"])["id"].nunique() == 1).all()
    with pytest.raises(ValueError):
        evaluation.replicate_workload(queries, 0)


def test_latency_summary(spark):
    start = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [("a", "p", start, 2.0), ("a", "p", start + datetime.timedelta(seconds=1), 4.0), ("b", "p", start, 0.5)],
        "database string, phase string, started timestamp, seconds double",
    )
    rows = {r["database"]: r for r in evaluation.latency_summary(log, ["database"]).collect()}
    assert (rows["a"]["n_requests"], rows["a"]["mean_request"], rows["a"]["mean_wall"]) == (2, 3.0, 2.5)
    assert (rows["a"]["total_request"], rows["a"]["total_wall"]) == (6.0, 5.0)
    report = {r["metric"]: (r["a"], r["b"]) for r in evaluation.compare_report(
        evaluation.latency_summary(log, ["database"]), ["a", "b"]).collect()}
    assert report["total_wall"] == (5.0, 0.5) and len(report) == 4


def test_benchmark_summary(spark, sf_dir):
    from vectide.plans.benchmark import benchmark_run, benchmark_summary

    collection = open_collection(spark, scratch_path(spark, "measured")).create("namespaced", dim=64)
    collection.load(inputs.vector_records(spark, sf_dir))
    prompts = inputs.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    path = scratch_path(spark, "results")
    summary = benchmark_summary(benchmark_run({"only": collection}, prompts, path, iterations=3)).first().asDict()
    assert summary["database"] == "only" and len(summary) == 8
    assert 0 < summary["workload_mean"] < summary["workload_total"] <= summary["total"]
    assert spark.read.text(f"{path}/only-results").count() == 40 * 5


def test_arriving_files_grow_with_the_splits_of_the_scan(spark, sf_dir, tmp_path):
    """One source holds all documents: they still arrive in four files, or in as many as the scan has splits."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.lit("one"))
    for folder, files in (("few", 1), ("many", 9)):
        given.repartition(files).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a split for each file
        try:
            path, half = registered._document_files(spark, f"{tmp_path}/{folder}")
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        arrived = spark.read.schema(given.schema).parquet(path).groupBy(F.input_file_name()).count().toPandas()["count"]
        assert len(arrived) == max(files, 4) and half == -(-len(arrived) // 2)
        assert arrived.sum() == given.count() and arrived.max() < given.count() / 2
