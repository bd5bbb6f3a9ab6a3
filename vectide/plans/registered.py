"""One query per operator, each over the given tables as a whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions import numbers, text, vectors as vec
from vectide.operators import chunking, documents as docs, embedding, evaluation, hits, layouts, search
from vectide.plans import benchmark, inputs
from vectide.plans.inputs import DIM, table
from vectide.plans.ingest import IngestOptions, build_records, ingest_run
from vectide.plans.retrieval import encode_queries, quality_run, query, text_search, workload_run
from vectide.plans.retrieval import search as shaped_search
from vectide.session import materialize, scratch_path
from vectide.sources import files, index, sinks
from vectide.sources.collections import Collection, fan_out, fan_out_clear, open_collection
from vectide.sources.delivery import FolderSink, register_sink
from vectide.sources.documents import DOCUMENTS
from vectide.sources.documents import read_sidecar as read_sidecar_files
from vectide.sources.index import VectorIndex
from vectide.sources.table_index import build_table_index
from vectide.streaming.late import attach_late_metadata
from vectide.streaming.ingest import DEAD_LETTERS, stream_documents, stream_ingest, write_batches

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

ITERATIONS = 5


def registered(query: Query) -> Query:
    REGISTERED[query.__name__] = query
    return query


def _big(*columns: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def _text_query(name: str, function: Callable[[Column], Column]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        noisy = inputs.noisy_documents(spark, sf_dir)
        return noisy.select("doc_id", function(F.col("text")).alias("text"))

    REGISTERED[name] = query


# -- text --------------------------------------------------------------------

_text_query("collapse_spaces", text.collapse_spaces)
_text_query("strip_newlines_tabs", text.strip_newlines_tabs)
_text_query("fix_dot_comma", text.fix_dot_comma)
_text_query("join_hyphenated", text.join_hyphenated)
_text_query("strip_cid", text.strip_cid)
_text_query("clean_text", text.clean_text)


@registered
def strip_lead_space(spark, sf_dir):
    indented = inputs.documents(spark, sf_dir).select(
        "doc_id", F.concat(F.when(F.col("lang") == "en", "  ").when(F.col("lang") == "fr", " ").otherwise(""), "text").alias("text")
    )
    return indented.select("doc_id", text.strip_lead_space(F.col("text")).alias("text"))


@registered
def clean_web_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.clean_text(F.col("html")).alias("text"))


@registered
def chunk_text(spark, sf_dir):
    chunks = chunking.chunk_text(inputs.documents(spark, sf_dir).select("doc_id", "text"))
    return chunks.select("doc_id", *_big("chunk"), "text")


@registered
def chunk_stats(spark, sf_dir):
    chunks = chunking.chunk_text(inputs.documents(spark, sf_dir).select("lang", "text"), size=300, overlap=50)
    return docs.chunk_report(chunks, "lang")


@registered
def digest_of(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("data\\"), "source", F.lit("-"), "doc_id", F.lit(".pdf")).alias("filename")
    )
    return named.select(
        "doc_id",
        text.digest_of(F.col("filename")).alias("digest"),
        text.digest_of(F.col("filename"), strict=True).alias("strict_digest"),
    )


# -- documents ---------------------------------------------------------------

@registered
def assemble_pages(spark, sf_dir):
    return docs.assemble_pages(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


@registered
def limit_documents(spark, sf_dir):
    return docs.limit_documents(table(spark, sf_dir, "documents"), "doc_id", 50).select("doc_id", "lang", "n_chars")


@registered
def split_empty(spark, sf_dir):
    return docs.split_empty(inputs.extracted_documents(spark, sf_dir), "doc_id")[1]


@registered
def keep_with_text(spark, sf_dir):
    return docs.split_empty(inputs.extracted_documents(spark, sf_dir), "doc_id")[0].select("doc_id", "lang", "text")


@registered
def remove_quarantined(spark, sf_dir):
    quarantine = docs.split_empty(inputs.extracted_documents(spark, sf_dir), "doc_id")[1]
    return docs.remove_quarantined(table(spark, sf_dir, "documents"), quarantine, "doc_id").select("doc_id", "text")


@registered
def first_match(spark, sf_dir):
    return docs.first_sidecar_rows(inputs.sidecar(spark, sf_dir)).select("digest", "file_size", "pos")


@registered
def read_document_files(spark, sf_dir):
    """One file a document, some empty and some no text: each comes back as a document or with a reason."""
    path = scratch_path(spark, "files")
    graded = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    content = F.when(F.col("quality") == 0, F.lit(b"")).when(F.col("toxic") == 1, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-8")))
    files.write_files(graded.select(
        F.concat("doc_id", F.lit(".txt")).alias("filename"), content.otherwise(F.encode("text", "UTF-8")).alias("content")), path).collect()
    found, rejects = files.text_documents(files.read_files(spark, path))
    return found.select("filename", "text", F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select("filename", F.lit(None).cast("string").alias("text"), "reason"))


@registered
def read_sidecar(spark, sf_dir):
    """The sidecar as CSV files with quotes, commas and line breaks in a field: first rows by file order."""
    path = scratch_path(spark, "sidecar")
    noted = inputs.sidecar(spark, sf_dir).withColumn("date", F.concat("date", F.lit(' "a",\nb')))
    ordered = noted.repartitionByRange(4, "pos").sortWithinPartitions("pos").select("digest", "file_size", "date")
    ordered.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return docs.first_sidecar_rows(read_sidecar_files(spark, path, line_breaks=True)).select("digest", "file_size", "date")


@registered
def attach_metadata(spark, sf_dir):
    kept, _ = docs.attach_metadata(inputs.named_documents(spark, sf_dir), inputs.sidecar(spark, sf_dir), "doc_id")
    return kept.select("doc_id", "digest", "size", "created_at", "text")


@registered
def missing_metadata(spark, sf_dir):
    return docs.attach_metadata(inputs.named_documents(spark, sf_dir), inputs.sidecar(spark, sf_dir), "doc_id")[1]


@registered
def ingest_report(spark, sf_dir):
    return evaluation.ingest_report(table(spark, sf_dir, "documents"), "source")


# -- ids and batches ---------------------------------------------------------

def _dense_chunks(spark, sf_dir) -> DataFrame:
    documents = inputs.documents(spark, sf_dir).select("doc_id", "text")
    return chunking.with_dense_ids(
        chunking.chunk_text(documents), chunking.dense_starts(documents, "doc_id"), "doc_id"
    )


@registered
def assign_dense_ids(spark, sf_dir):
    return _dense_chunks(spark, sf_dir).select("id", "doc_id", *_big("chunk"))


@registered
def content_ids(spark, sf_dir):
    chunks = chunking.chunk_text(inputs.documents(spark, sf_dir).select("doc_id", "text"))
    return chunking.with_content_ids(chunks, "doc_id").select("id", "doc_id", *_big("chunk"))


@registered
def batch_rows(spark, sf_dir):
    batched = chunking.batch_rows(_dense_chunks(spark, sf_dir), 500)
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.col("id").cast("bigint")).alias("first_id")
    )


# -- embedding ---------------------------------------------------------------

def _elements(df: DataFrame, key: str, col: str) -> DataFrame:
    # The outer form keeps the optimizer from adding a "not empty" filter that embeds a second time.
    elements = df.select(key, F.posexplode_outer(col).alias("pos", "x")).where(F.col("pos").isNotNull())
    return elements.select(key, *_big("pos"), F.round(F.col("x").cast("double"), vec.ELEMENT_DIGITS).alias("x"))


@registered
def embed_hash(spark, sf_dir):
    embedded = embedding.embed_hash(inputs.documents(spark, sf_dir).select("doc_id", "text"), dim=DIM)
    return _elements(embedded, "doc_id", "values")


@registered
def embed_udf(spark, sf_dir):
    documents = inputs.documents(spark, sf_dir).select("doc_id", "text")
    embedded = embedding.embed(documents, "text", embedding.hash_encoder_factory(DIM), DIM)
    return _elements(embedded, "doc_id", "values")


# -- layouts -----------------------------------------------------------------

def _records(spark, sf_dir, ids: str = "dense") -> DataFrame:
    options = IngestOptions(ids=ids, dim=DIM)
    return build_records(inputs.named_documents(spark, sf_dir), inputs.sidecar(spark, sf_dir), options)[0]


def _vector_sum(col: str) -> Column:
    total = F.aggregate(F.col(col), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.round(total, 4).alias("vector_sum")


def _flat_typed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", _vector_sum("embedding"),
        F.get_json_object("metadata", "$.filename").alias("filename"),
        F.get_json_object("metadata", "$.size").alias("size"),
        F.get_json_object("metadata", "$.created_at").alias("created_at"),
        F.get_json_object("metadata", "$.chunk").cast("bigint").alias("chunk"),
        "text",
    )


def _flat_namespaced(rows: DataFrame) -> DataFrame:
    return rows.select(
        "namespace", "id", _vector_sum("values"), "metadata.filename", "metadata.size", "metadata.created_at",
        F.col("metadata.chunk").cast("bigint").alias("chunk"), "metadata.text",
    )


def _flat_payload(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", _vector_sum("vector"), F.col("payload.metadata.created_at").alias("created_at"),
        F.col("payload.chunk_part").cast("bigint").alias("chunk_part"),
        F.col("payload.document_id").alias("document_id"), F.col("payload.metadata.text").alias("text"),
    )


@registered
def typed_layout(spark, sf_dir):
    return _flat_typed(layouts.to_typed_layout(_records(spark, sf_dir)))


@registered
def payload_layout(spark, sf_dir):
    return _flat_payload(layouts.to_payload_layout(_records(spark, sf_dir)))


@registered
def namespaced_layout(spark, sf_dir):
    return _flat_namespaced(layouts.to_namespaced_layout(_records(spark, sf_dir, "content")))


@registered
def constraint_rejects(spark, sf_dir):
    documents = inputs.named_documents(spark, sf_dir).select(
        "doc_id", "filename", F.col("n_chars").alias("size"), F.lit("2024-01-01").alias("created_at"), "text"
    )
    chunks = chunking.with_content_ids(chunking.chunk_text(documents, size=6000, overlap=100), "doc_id")
    records = layouts.to_records(embedding.embed(chunks, "text", embedding.hash_encoder_factory(DIM), DIM))
    return layouts.check_constraints(records, dim=DIM)[1]


# -- vector tables -----------------------------------------------------------

def _collection(spark, layout: str) -> Collection:
    return open_collection(spark, scratch_path(spark, layout)).create(layout, dim=DIM)


def _two_versions(spark, sf_dir) -> Collection:
    collection = _collection(spark, "namespaced")
    collection.upsert(inputs.vector_records(spark, sf_dir))
    collection.upsert(inputs.vector_records(spark, sf_dir, shift=100, mark="second"))
    return collection


@registered
def create_collection(spark, sf_dir):
    made = [_collection(spark, layout).create(layout, dim=DIM + 1) for layout in layouts.SCHEMAS]
    rows = inputs.vector_records(spark, sf_dir)
    fan_out(rows, made)
    properties = [c.properties() for c in made]
    counted = [
        c.read().agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(p["layout"]).alias("layout"), F.lit(p["dim"]).cast("bigint").alias("dim"),
            F.lit(p["metric"]).alias("metric"), "n_rows",
        )
        for c, p in zip(made, properties)
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@registered
def append_vectors(spark, sf_dir):
    collection = _collection(spark, "typed")
    for shift, mark in ((0, "first"), (100, "second")):
        collection.append(layouts.to_typed_layout(inputs.vector_records(spark, sf_dir, shift, mark)))
    return _flat_typed(collection.read())


@registered
def upsert_vectors(spark, sf_dir):
    return _flat_namespaced(_two_versions(spark, sf_dir).read())


@registered
def compact_collection(spark, sf_dir):
    collection = _two_versions(spark, sf_dir)
    collection.compact()
    return _flat_namespaced(collection.read())


@registered
def upsert_payload(spark, sf_dir):
    collection = _collection(spark, "payload")
    for shift, mark in ((0, "first"), (100, "second")):
        collection.upsert(layouts.to_payload_layout(inputs.vector_records(spark, sf_dir, shift, mark)))
    return _flat_payload(collection.read())


@registered
def clear_namespace(spark, sf_dir):
    collection = _two_versions(spark, sf_dir)
    collection.clear_namespace("label3")
    return _flat_namespaced(collection.read())


@registered
def clear_collection(spark, sf_dir):
    collection = _two_versions(spark, sf_dir)
    collection.clear()
    collection.upsert(inputs.vector_records(spark, sf_dir, mark="reloaded"))
    return _flat_namespaced(collection.read())


@registered
def fan_out_tables(spark, sf_dir):
    made = [_collection(spark, layout) for layout in layouts.SCHEMAS]
    fan_out(inputs.vector_records(spark, sf_dir, mark="old"), made)
    fan_out_clear(made)
    fan_out(inputs.vector_records(spark, sf_dir), made)
    found = [
        c.search_rows().select(
            F.lit(c.layout).alias("layout"), F.col("id").cast("string").alias("id"),
            _vector_sum("values"), "text",
        )
        for c in made
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@registered
def load_rejects(spark, sf_dir):
    """Vectors of one label cut short: every table refuses those and stores the others."""
    records = inputs.vector_records(spark, sf_dir).withColumn(
        "values", F.when(F.col("metadata.chunk") == 3, F.slice("values", 1, 10)).otherwise(F.col("values")))
    made = [_collection(spark, layout) for layout in layouts.SCHEMAS]
    outcome = fan_out(records, made).select("layout", "id", F.col("reason").alias("outcome"))
    for c in made:
        outcome = outcome.unionByName(c.search_rows().select(
            F.lit(c.layout).alias("layout"), F.col("id").cast("string").alias("id"), F.lit("stored").alias("outcome")))
    return outcome


@registered
def write_json_roundtrip(spark, sf_dir):
    records = _records(spark, sf_dir, "content")
    path = scratch_path(spark, "json")
    sinks.write_json(records, path)
    return _flat_namespaced(layouts.to_namespaced_layout(sinks.read_json(spark, path, records.schema)))


@registered
def dump_results(spark, sf_dir):
    path = scratch_path(spark, "dump")
    sinks.dump_results(table(spark, sf_dir, "benchmark"), path)
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.item_id").cast("bigint").alias("item_id"),
        F.get_json_object("value", "$.text").alias("text"),
    )


@registered
def deliver_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    report = materialize(sinks.deliver_batches(rows, lambda: (lambda batch: None), 100), "deliveries")
    return report.agg(F.sum("n_rows").alias("n_rows"), F.count("error").alias("n_failed"))


@registered
def deliver_committed(spark, sf_dir):
    """All documents to a sink with commits, in two batches of which one is delivered twice; batch sizes by file."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    sink = FolderSink(scratch_path(spark, "delivered"))
    target = register_sink(spark, "committed_delivery", sink)
    for batch, chosen in (("1", F.col("lang") == "en"), ("1", F.col("lang") == "en"), ("2", ~F.col("lang").eqNullSafe("en"))):
        rows.where(chosen).write.format(target).option("batch", batch).option("rows", 50).mode("append").save()
    seen = sink.read(spark, rows.schema).withColumn("file", F.col("_metadata.file_path"))
    size = F.count(F.lit(1)).over(Window.partitionBy("file"))
    return seen.withColumn("fits", size <= 50).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sent"), F.min("fits").alias("fits"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


# -- search ------------------------------------------------------------------

def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", *_big("rank"), "id", "score")


@registered
def inner_product(spark, sf_dir):
    stored = inputs.scaled_vectors(spark, sf_dir)
    following = stored.select((F.col("id") - 1).alias("id"), F.col("values").alias("next"))
    pairs = stored.join(following, "id")
    return pairs.select("id", vec.round_score(vec.inner_product(F.col("values"), F.col("next"))).alias("score"))


@registered
def cosine(spark, sf_dir):
    stored = inputs.scaled_vectors(spark, sf_dir)
    following = stored.select((F.col("id") - 1).alias("id"), F.col("values").alias("next"))
    pairs = stored.join(following, "id")
    return pairs.select("id", vec.round_score(vec.cosine(F.col("values"), F.col("next"))).alias("score"))


@registered
def knn_ip(spark, sf_dir):
    return _hits(search.knn(inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir), 5, "ip"))


@registered
def knn_cosine(spark, sf_dir):
    return _hits(search.knn(inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir), 5, "cosine"))


@registered
def knn_block(spark, sf_dir):
    stored, asked = inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir)
    small_blocks = search.SearchBounds(block_vectors=200, block_queries=150)
    return _hits(search.knn(stored, asked, 5, "ip", method="block", bounds=small_blocks))


@registered
def knn_namespace(spark, sf_dir):
    collection = _collection(spark, "namespaced")
    collection.upsert(inputs.vector_records(spark, sf_dir))
    asked = inputs.vector_queries(spark, sf_dir)
    found = search.knn(collection.search_rows(), asked, 5, "cosine", namespace="label3")
    return _hits(found.withColumn("id", F.col("id").cast("bigint")))


@registered
def query_collection(spark, sf_dir):
    """Text prompts against a loaded table, with the table's own metric and namespace."""
    documents, sidecar = inputs.named_documents(spark, sf_dir), inputs.sidecar(spark, sf_dir)
    collection = _collection(spark, "namespaced")
    ingest_run(documents, sidecar, [collection], IngestOptions(dim=DIM))
    return _flat_hits(query(collection, _prompts(spark, sf_dir)))


@registered
def knn_filtered(spark, sf_dir):
    stored, asked = inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir)
    return _hits(search.knn(stored, asked, 5, "cosine", where=F.col("label") >= 5))


@registered
def quantize_int8(spark, sf_dir):
    stored = inputs.scaled_vectors(spark, sf_dir)
    coded = search.with_codes(stored, search.peak_value(stored, "ip"), "ip")
    return coded.select("id", F.posexplode("q8").alias("pos", "code")).select("id", *_big("pos", "code"))


@registered
def knn_int8_rescored(spark, sf_dir):
    stored, asked = inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir)
    return _hits(search.knn(stored, asked, 5, "cosine", method="int8", oversample=4))


def _indexed(spark, sf_dir) -> VectorIndex:
    """Deferred build: rows are loaded first, cells and codes are assigned afterwards."""
    loaded = materialize(inputs.scaled_vectors(spark, sf_dir), "loaded")
    return index.build_index(loaded, scratch_path(spark, "index"), cells=8)


@registered
def build_index(spark, sf_dir):
    """Every loaded vector is in exactly one cell, with its floats and codes."""
    built = _indexed(spark, sf_dir)
    return built.rows.select("id", F.col("cell").between(0, 7).alias("has_cell"), *_big_size("values", "q8"))


def _big_size(*columns: str) -> list[Column]:
    return [F.size(c).cast("bigint").alias(f"n_{c}") for c in columns]


@registered
def knn_int8_stored(spark, sf_dir):
    return _hits(_indexed(spark, sf_dir).search_codes(inputs.vector_queries(spark, sf_dir)))


@registered
def knn_ivf(spark, sf_dir):
    """Cells are read until none can hold a better hit."""
    return _hits(_indexed(spark, sf_dir).search_certified(inputs.vector_queries(spark, sf_dir), probes=4).hits)


@registered
def knn_int8_bounded(spark, sf_dir):
    """Stored codes with their errors leave few candidates, and the hits are the exact ones."""
    return _hits(_indexed(spark, sf_dir).search_bounded_codes(inputs.vector_queries(spark, sf_dir)))


@registered
def query_indexed(spark, sf_dir):
    """The table's own index after a load, an upsert that replaces and adds, and a cleared namespace, by cells and by codes."""
    collection = _collection(spark, "namespaced")
    collection.load(inputs.vector_records(spark, sf_dir))
    build_table_index(collection, cells=8)
    collection.upsert(inputs.vector_records(spark, sf_dir, shift=100, mark="second"))
    collection.clear_namespace("label4")
    asked = inputs.vector_queries(spark, sf_dir)
    found = [
        query(collection, asked, postprocess=False, pre_vectorized=True, namespace="label3", method=method).withColumn("method", F.lit(method))
        for method in ("ivf", "int8")
    ]
    return found[0].unionByName(found[1]).select("method", "query_id", *_big("rank"), F.col("id").cast("bigint").alias("id"), "score")


@registered
def ingest_run_long_chunks(spark, sf_dir):
    """Chunks above the tables' limit: every one that is not stored is named with its reason."""
    named = inputs.named_documents(spark, sf_dir)
    made = _collection(spark, "namespaced")
    refused = ingest_run(named, inputs.sidecar(spark, sf_dir), [made], IngestOptions(size=6000, overlap=0, max_text=10_000, dim=DIM))
    outcome = refused.select(F.col("doc_id"), F.col("reason").alias("outcome"))
    stored = made.search_rows().select(F.regexp_replace("metadata.filename", "[.]pdf$", "").cast("bigint").alias("doc_id"), F.lit("stored").alias("outcome"))
    return outcome.unionByName(stored).groupBy("doc_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@registered
def knn_ivf_all_cells(spark, sf_dir):
    return _hits(_indexed(spark, sf_dir).search(inputs.vector_queries(spark, sf_dir), probes=8))


@registered
def knn_ivf_blocks(spark, sf_dir):
    built = _indexed(spark, sf_dir)
    bounds = search.SearchBounds(block_vectors=50, block_queries=100)
    asked = inputs.vector_queries(spark, sf_dir)
    return _hits(search.knn_cells(built.rows, asked, built.cells, probes=8, bounds=bounds, blocks=True))


# -- text search and evaluation ----------------------------------------------

def _prompts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _stored_chunks(spark, sf_dir) -> DataFrame:
    documents = inputs.named_documents(spark, sf_dir).select(
        "doc_id", "filename", F.col("n_chars").alias("size"), F.lit("2024-01-01").alias("created_at"),
        text.clean_text(F.col("text")).alias("text"),
    )
    chunks = chunking.with_content_ids(chunking.chunk_text(documents), "doc_id")
    records = layouts.to_records(embedding.embed(chunks, "text", embedding.hash_encoder_factory(DIM), DIM))
    stored = materialize(layouts.to_namespaced_layout(records), "chunks")
    return layouts.searchable(stored, "namespaced")


def _flat_hits(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id", *_big("rank"), "id", "score",
        F.col("metadata.filename").alias("filename"), F.col("metadata.chunk").cast("bigint").alias("chunk"), "text",
    )


@registered
def flagship_search(spark, sf_dir):
    """Clean, chunk, embed and store the documents, then search them for every prompt."""
    return _flat_hits(text_search(_stored_chunks(spark, sf_dir), _prompts(spark, sf_dir), dim=DIM))


@registered
def text_search_ids(spark, sf_dir):
    asked = encode_queries(_prompts(spark, sf_dir), DIM)
    return _hits(search.knn(_stored_chunks(spark, sf_dir), asked, 5, "ip", dim=DIM))


@registered
def shape_hits(spark, sf_dir):
    """Hits without metadata and text, with their vectors."""
    found = shaped_search(
        _stored_chunks(spark, sf_dir), encode_queries(_prompts(spark, sf_dir), DIM), dim=DIM,
        include_metadata=False, include_text=False, include_vectors=True,
    )
    return found.select(
        "query_id", *_big("rank"), "id", "score", _vector_sum("values"),
        F.col("metadata").isNull().alias("no_metadata"), F.col("text").isNull().alias("no_text"),
    )


@registered
def hydrate_hits(spark, sf_dir):
    found = search.knn(inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir), 5, "cosine")
    stored = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    hydrated = hits.hydrate_hits(found, stored, ["lang", "text"], "doc_id")
    return hydrated.select("query_id", *_big("rank"), "id", "lang", "text")


@registered
def hydrate_hits_filtered(spark, sf_dir):
    """The same where the ids are too many to be broadcast: a bit table of them is applied to the texts' scan."""
    found = search.knn(inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir), 5, "cosine")
    stored = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    hydrated = hits.hydrate_hits(found, stored, ["lang", "text"], "doc_id", broadcast_bytes=0)
    return hydrated.select("query_id", *_big("rank"), "id", "lang", "text")


@registered
def result_agreement(spark, sf_dir):
    stored, asked = inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir)
    return hits.result_agreement(search.knn(stored, asked, 5, "ip"), search.knn(stored, asked, 5, "cosine"))


@registered
def quality_run_saved(spark, sf_dir):
    path = scratch_path(spark, "quality")
    quality_run(_stored_chunks(spark, sf_dir), _prompts(spark, sf_dir), path, dim=DIM)
    saved = spark.read.schema(
        "query_id bigint, rank int, id string, score double, metadata struct<filename:string,size:string,chunk:int>, text string"
    ).json(path)
    return _flat_hits(saved)


@registered
def replicate_workload(spark, sf_dir):
    requests = evaluation.replicate_workload(_prompts(spark, sf_dir), ITERATIONS)
    return requests.select("request_id", "query_id", *_big("iteration"), "text")


@registered
def workload_hits(spark, sf_dir):
    found = workload_run(
        inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir), ITERATIONS, metric="ip"
    )
    return found.select("query_id", "iteration", *_big("rank"), "id", "score")


@registered
def latency_summary(spark, sf_dir):
    summary = evaluation.latency_summary(inputs.latency_log(spark, sf_dir), ["database", "phase"])
    return summary.select("database", "phase", "n_requests", *[F.round(c, 6).alias(c) for c in evaluation.MEASURES])


@registered
def latency_quantiles(spark, sf_dir):
    """Stored sketches per phase, merged per database; the ranks of the answers in the log tell whether they are right."""
    log = inputs.latency_log(spark, sf_dir)
    stored = materialize(evaluation.latency_sketches(log, ["database", "phase"]), "sketches")
    asked = evaluation.latency_quantiles(evaluation.merge_sketches(stored, ["database"]), ["database"])
    asked = materialize(asked.withColumnRenamed("seconds", "answer"), "quantiles")
    # A few answers a database, so each row of the log meets those of its own.
    ranked = log.where(F.col("seconds").isNotNull()).join(asked, "database").groupBy("database", "probability", "n_requests").agg(
        F.avg((F.col("seconds") < F.col("answer")).cast("double")).alias("below"),
        F.avg((F.col("seconds") <= F.col("answer")).cast("double")).alias("up_to"),
        F.count(F.lit(1)).alias("n_counted"),
    )
    # Twice the stated error, which one answer in a hundred may exceed.
    slack = 2 * evaluation.rank_error()
    near = (F.col("below") - slack <= F.col("probability")) & (F.col("probability") <= F.col("up_to") + slack)
    return ranked.select("database", "probability", "n_requests", "n_counted", near.alias("within_error"))


@registered
def rounded_summary(spark, sf_dir):
    summary = evaluation.latency_summary(inputs.latency_log(spark, sf_dir), ["database"])
    return evaluation.rounded_summary(summary)


@registered
def compare_report(spark, sf_dir):
    summary = evaluation.latency_summary(inputs.latency_log(spark, sf_dir), ["database"])
    return evaluation.compare_report(evaluation.rounded_summary(summary), inputs.DATABASES)


@registered
def sig3(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", numbers.sig3(F.col("value")).alias("value"))


@registered
def ingest_run_rejects(spark, sf_dir):
    """Full ingest into all three layouts, then everything that was rejected."""
    named = inputs.extracted_documents(spark, sf_dir).withColumn("filename", F.concat("doc_id", F.lit(".pdf")))
    made = [_collection(spark, layout) for layout in layouts.SCHEMAS]
    return ingest_run(named, inputs.sidecar(spark, sf_dir), made, IngestOptions(ids="dense", dim=DIM)).select("doc_id", "reason")


@registered
def ingest_run_loaded(spark, sf_dir):
    """Full ingest into all three layouts, then the rows of each."""
    named = inputs.extracted_documents(spark, sf_dir).withColumn("filename", F.concat("doc_id", F.lit(".pdf")))
    made = [_collection(spark, layout) for layout in layouts.SCHEMAS]
    ingest_run(named, inputs.sidecar(spark, sf_dir), made, IngestOptions(ids="dense", dim=DIM))
    loaded = [
        c.search_rows().select(
            F.lit(c.layout).alias("layout"), F.col("id").cast("string").alias("id"),
            _vector_sum("values"), "text",
        )
        for c in made
    ]
    return loaded[0].unionByName(loaded[1]).unionByName(loaded[2])


def _loaded(collections: list[Collection]) -> DataFrame:
    found = [
        c.search_rows().select(
            F.lit(c.layout).alias("layout"), F.col("id").cast("string").alias("id"), _vector_sum("values"), "text",
        )
        for c in collections
    ]
    return reduce(DataFrame.unionByName, found)


@registered
def free_metadata_loaded(spark, sf_dir):
    """Sidecar columns beyond the fixed ones, through a full ingest into all three layouts."""
    made = [open_collection(spark, scratch_path(spark, layout)).create(layout, dim=DIM, promoted={"lang": "string"}) for layout in layouts.SCHEMAS]
    options = IngestOptions(ids="dense", dim=DIM, free=("lang", "quality", "source", "later"))
    ingest_run(inputs.named_documents(spark, sf_dir), inputs.free_sidecar(spark, sf_dir), made, options)
    found = [
        c.search_rows().select(
            F.lit(c.layout).alias("layout"), F.col("id").cast("string").alias("id"),
            F.col("promoted.lang").alias("lang"),
            *[F.try_variant_get("extra", f"$.{key}", kind).alias(key) for key, kind in (("quality", "bigint"), ("source", "string"), ("later", "boolean"))],
            "text",
        )
        for c in made
    ]
    return reduce(DataFrame.unionByName, found)


#: Promoted, nested and other keys, with missing ones among them.
FREE_FILTER = {
    "group": ["g0", "g1"],
    "any": [{"weight": {"gte": 50, "lt": 400}}, {("tags", "third"): True}],
    "not": {"label": 4},
}


@registered
def free_metadata_search(spark, sf_dir):
    """Search under a filter description, in a table some rows of which were replaced."""
    collection = open_collection(spark, scratch_path(spark, "payload")).create(
        "payload", dim=DIM, promoted={"group": "string", "weight": "double"})
    for shift, mark in ((0, "first"), (100, "second")):
        fan_out(inputs.free_vector_records(spark, sf_dir, shift, mark), [collection])
    found = query(collection, inputs.vector_queries(spark, sf_dir), pre_vectorized=True, where=FREE_FILTER)
    return found.select(
        "query_id", *_big("rank"), "id", "score",
        F.variant_get("extra", "$.group", "string").alias("grp"), F.variant_get("extra", "$.label", "bigint").alias("label"),
    )


@registered
def ingest_two_runs(spark, sf_dir):
    """A second load of other documents: its dense ids go on after those of the first."""
    named, sidecar = inputs.named_documents(spark, sf_dir), inputs.sidecar(spark, sf_dir)
    made = [_collection(spark, layout) for layout in ("typed", "payload")]
    options = IngestOptions(ids="dense", dim=DIM)
    ingest_run(named.where("lang = 'en'"), sidecar, made, options)
    ingest_run(named.where("lang is distinct from 'en'"), sidecar, made, options, clear=False)
    return _loaded(made)


@registered
def ingest_keeps_namespaces(spark, sf_dir):
    """A load empties its own namespace and leaves the others."""
    named, sidecar = inputs.named_documents(spark, sf_dir), inputs.sidecar(spark, sf_dir)
    collection = _collection(spark, "namespaced")
    collection.upsert(inputs.vector_records(spark, sf_dir))
    for _ in range(2):
        ingest_run(named, sidecar, [collection], IngestOptions(dim=DIM))
    return _flat_namespaced(collection.read())


@registered
def benchmark_run(spark, sf_dir):
    """Three timed jobs per table; the times themselves differ from run to run."""
    made = {layout: _collection(spark, layout) for layout in layouts.SCHEMAS}
    fan_out(inputs.vector_records(spark, sf_dir), list(made.values()), unique=True)
    log = benchmark.benchmark_run(made, _prompts(spark, sf_dir), scratch_path(spark, "results"), ITERATIONS)
    return log.select("database", "phase", "n_requests", (F.col("seconds") > 0).alias("has_time"))


# -- streaming ---------------------------------------------------------------

def _document_files(spark, sf_dir, files: int = 4) -> tuple[str, int]:
    """The documents as several parquet files, as they would arrive, and the number of half of them.

    A scan that has as many splits is written as it is, a file for each split,
    so no task gets more than a split.
    """
    path = scratch_path(spark, "arriving")
    arriving = table(spark, sf_dir, "documents")
    splits = arriving.rdd.getNumPartitions()
    (arriving if splits >= files else arriving.repartition(files, "doc_id")).write.parquet(path)
    return path, -(-max(splits, files) // 2)


@registered
def stream_ingest_documents(spark, sf_dir):
    path, half = _document_files(spark, sf_dir)
    stream = stream_documents(spark, path, files_per_batch=half, schema=DOCUMENTS)
    named = stream.withColumn("filename", F.concat("doc_id", F.lit(".pdf")))
    collection = _collection(spark, "namespaced")
    running = stream_ingest(
        named, inputs.sidecar(spark, sf_dir), collection, scratch_path(spark, "stream"), IngestOptions(dim=DIM),
        dead_letters=scratch_path(spark, "dead"),
    )
    running.awaitTermination()
    return _flat_namespaced(collection.read())


@registered
def stream_ingest_all_layouts(spark, sf_dir):
    """A stream into all three layouts, with ids that go on from batch to batch."""
    path, half = _document_files(spark, sf_dir)
    stream = stream_documents(spark, path, files_per_batch=half, schema=DOCUMENTS)
    named = stream.withColumn("filename", F.concat("doc_id", F.lit(".pdf")))
    made = [_collection(spark, layout) for layout in layouts.SCHEMAS]
    stream_ingest(
        named, inputs.sidecar(spark, sf_dir), made, scratch_path(spark, "stream"), IngestOptions(ids="dense", dim=DIM),
        dead_letters=scratch_path(spark, "dead"),
    ).awaitTermination()
    return _loaded(made).drop("id")


@registered
def dead_letter(spark, sf_dir):
    """A sink that refuses one language: batches with it are recorded, the others arrive."""
    path, dead, loaded = (scratch_path(spark, label) for label in ("arriving", "dead", "loaded"))
    # Every file holds one language, so every batch of one file does.
    table(spark, sf_dir, "documents").write.partitionBy("lang").parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        if batch.where(F.col("lang") == "fr").limit(1).count():
            raise ValueError("refused")
        batch.select("doc_id", F.lit("loaded").alias("reason")).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").parquet(f"{loaded}/batch={number}")

    stream = stream_documents(spark, path, files_per_batch=1, schema=DOCUMENTS)
    write_batches(stream, write, scratch_path(spark, "stream"), dead).awaitTermination()
    outcome = [spark.read.schema(DEAD_LETTERS).parquet(p).select("doc_id", "reason") for p in (dead, loaded)]
    return outcome[0].unionByName(outcome[1])


@registered
def attach_late_metadata_stream(spark, sf_dir):
    """Sidecar rows that come minutes after their documents, in a later run of the stream."""
    start, late = F.lit(1_700_000_000), F.lit(600)
    named = inputs.named_documents(spark, sf_dir).select("doc_id", "filename", F.timestamp_seconds(start + F.col("doc_id") % 60).alias("arrived"))
    noted = inputs.sidecar(spark, sf_dir).withColumn("arrived", F.timestamp_seconds(start + late + F.col("pos") % 60))
    paths = {label: scratch_path(spark, label) for label in ("arriving", "noting", "state", "described")}
    far = F.timestamp_seconds(start + F.lit(7 * 86_400))
    rounds = [
        (named, noted.where("false")), (named.where("false"), noted),
        # A row on each side that moves the time on, so that nothing else waits any longer.
        (named.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("").alias("filename"), far.alias("arrived")),
         noted.limit(1).withColumns({"digest": F.lit(""), "arrived": far})),
    ]
    for documents, sidecar in rounds:
        documents.write.mode("append").parquet(paths["arriving"])
        sidecar.write.mode("append").parquet(paths["noting"])
        described = attach_late_metadata(
            spark.readStream.schema(named.schema).parquet(paths["arriving"]),
            spark.readStream.schema(noted.schema).parquet(paths["noting"]), "doc_id", within="1 hour", delay="10 minutes")
        described.writeStream.option("checkpointLocation", paths["state"]).trigger(availableNow=True).start(
            path=paths["described"], format="parquet", outputMode="append").awaitTermination()
    return spark.read.parquet(paths["described"]).select(
        "doc_id", "digest", F.col("file_size").cast("string").alias("size"), "date", "reason")
