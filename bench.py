"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the cores. Every
query is run once to warm up and once for the time, and its rows are consumed
by Spark, not collected.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from vectide.operators import embedding, search  # noqa: E402
from vectide.operators.chunking import chunk_text  # noqa: E402
from vectide.functions.text import clean_text  # noqa: E402
from vectide.plans import inputs, registered  # noqa: E402
from vectide.plans.ingest import IngestOptions, ingest_run  # noqa: E402
from vectide.plans.retrieval import text_search, workload_run  # noqa: E402
from vectide.session import build_session, materialize, scratch_path  # noqa: E402
from vectide.sources.collections import open_collection  # noqa: E402
from vectide.sources.index import build_index  # noqa: E402

ITERATIONS = 50
DIM = inputs.DIM


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        f"local[{cpus}]", app="bench", shuffle_partitions=cpus,
        **{"spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    documents = materialize(inputs.named_documents(spark, sf_dir), "documents")
    # A metadata row for every document, so that all of them are loaded.
    sidecar = materialize(documents.select(
        F.col("doc_id").cast("string").alias("digest"), F.col("n_chars").alias("file_size"),
        F.lit("2024-01-01").alias("date"), F.col("doc_id").alias("pos"),
    ), "sidecar")
    vectors, queries = inputs.scaled_vectors(spark, sf_dir), inputs.vector_queries(spark, sf_dir)
    prompts = inputs.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    noisy = materialize(inputs.noisy_documents(spark, sf_dir), "noisy")
    index = build_index(materialize(vectors, "vectors"), scratch_path(spark, "index"), cells=16)
    chunks = chunk_text(documents.select("doc_id", "text"))

    def ingest(layout: str, ids: str):
        def run():
            table = open_collection(spark, scratch_path(spark, layout)).create(layout, dim=DIM)
            ingest_run(documents, sidecar, [table], IngestOptions(dim=DIM, ids=ids))
            return table
        return run

    loaded = ingest("namespaced", "content")()
    loaded.compact()

    def upsert():
        table = open_collection(spark, scratch_path(spark, "upsert")).create("namespaced", dim=DIM)
        for shift in (0, 100):
            table.upsert(inputs.vector_records(spark, sf_dir, shift))
        return table.read()

    jobs = {
        "ingest_namespaced": ingest("namespaced", "content"),
        "ingest_typed_dense_ids": ingest("typed", "dense"),
        "clean_text": lambda: noisy.select("doc_id", clean_text(F.col("text")).alias("text")),
        "chunk_text": lambda: chunks,
        "embed": lambda: embedding.embed(chunks, "text", embedding.hash_encoder_factory(DIM), DIM),
        "embed_hash": lambda: embedding.embed_hash(chunks, "text", DIM),
        "assign_dense_ids": lambda: registered.assign_dense_ids(spark, sf_dir),
        "text_search": lambda: text_search(loaded.search_rows(), prompts, dim=DIM),
        "knn_cosine": lambda: search.knn(vectors, queries, 5, "cosine", dim=DIM),
        "knn_ip": lambda: search.knn(vectors, queries, 5, "ip", dim=DIM),
        "knn_int8": lambda: index.search_codes(queries),
        "knn_ivf": lambda: index.search(queries, probes=4),
        "workload": lambda: workload_run(vectors, queries, ITERATIONS, dim=DIM),
        "upsert": upsert,
        "latency_summary": lambda: registered.rounded_summary(spark, sf_dir),
        "stream_ingest": lambda: registered.stream_ingest_documents(spark, sf_dir),
        "flagship": lambda: registered.flagship_search(spark, sf_dir),
    }
    seconds = {}
    for name, job in jobs.items():
        for _ in range(2):
            begun = time.perf_counter()
            result = job()
            if hasattr(result, "write"):
                result.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begun, 3)

    n_documents, n_chars = documents.agg(F.count(F.lit(1)), F.sum("n_chars")).first()
    n_chunks, n_requests = chunks.count(), queries.count() * ITERATIONS
    exact = search.knn(vectors, queries, 5, "cosine", dim=DIM)
    rates = {
        "documents_per_sec": round(n_documents / seconds["ingest_namespaced"], 1),
        "chunks_per_sec": round(n_chunks / seconds["ingest_namespaced"], 1),
        "ingest_mb_per_sec": round(n_chars / 1e6 / seconds["ingest_namespaced"], 2),
        "workload_queries": n_requests,
        "workload_queries_per_sec": round(n_requests / seconds["workload"], 1),
        "recall_int8": round(registered.hits.recall(index.search_codes(queries), exact), 4),
        "recall_ivf_4_of_16": round(registered.hits.recall(index.search(queries, probes=4), exact), 4),
    }
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None, "cpus": cpus, "spark": spark.version,
        "rates": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
