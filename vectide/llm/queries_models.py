"""Queries of the operators that learn from part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import language, site_quality, toxicity
from vectide.llm.common import remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(remainder("doc_id", 3) != 1))
    found = language.identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "ambiguous")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources of the documents, paths their languages within a source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    judged = site_quality.judge(docs, labels, F.col("source"), F.col("lang"), carry=["doc_id"])
    return judged.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                         "doc_score", "host_score", "path_score", "quality", "kept")


QUERIES = {"op6_site_quality": op6_site_quality, "op1_language_id": op1_language_id, "op10_toxicity": op10_toxicity}
