"""Documents of which cleaning leaves nothing are named."""

import pytest
from pyspark.sql import functions as F

from vectide.functions.text import clean_text
from vectide.operators.documents import EMPTIED, emptied
from vectide.plans.ingest import IngestOptions, ingest_run
from vectide.session import scratch_path
from vectide.sources.collections import open_collection

TEXTS = [" ", "  ", "\n", "\t\n  \n", "(cid:7)", " (cid:12)  (cid:3)\n", "(c-i-d:8)", "(ci-d:8)\t (cid:1)", "c-i-d",
         "-", "(cid:)", "(cid:7", "7", ".,", "\r", "a", " a ", "(cid:\u0663) ", "", None, " " * 5000, "(cid:5) " * 900]


@pytest.mark.parametrize("newline", ["", " "])
def test_exactly_those_that_end_empty(spark, newline):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    wanted = texts.where("length(text) > 0").where(F.length(clean_text(F.col("text"), newline)) == 0)
    found = emptied(texts, "doc_id", newline).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in wanted.collect())
    assert len(found) >= 7 and {r["reason"] for r in found} == {EMPTIED}


def test_every_document_is_loaded_or_named(spark):
    table = open_collection(spark, scratch_path(spark, "t")).create("namespaced", dim=8)
    documents = spark.createDataFrame([(i, f"{i}.pdf", t) for i, t in enumerate(TEXTS)], "doc_id long, filename string, text string")
    sidecar = documents.where("doc_id <> 1").select(F.col("doc_id").cast("string").alias("digest"), F.lit(1).alias("file_size"),
                                                    F.lit("2024-01-01").alias("date"), F.col("doc_id").alias("pos"))
    rejects = ingest_run(documents, sidecar, [table], IngestOptions(dim=8))
    named = sorted((r["doc_id"], r["reason"]) for r in rejects.collect())
    assert len(named) == len(dict(named)) and dict(named)[1] == "no_metadata" and dict(named)[0] == EMPTIED
    loaded = {int(r[0][:-4]) for r in table.read().select("metadata.filename").collect()}
    assert loaded | set(dict(named)) == set(range(len(TEXTS))) and not loaded & set(dict(named))
