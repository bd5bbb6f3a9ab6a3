"""Queries of the operators that find near copies and repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import jaccard, passages
from vectide.llm.common import table


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join_similar(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_shingles", "component_id")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


QUERIES = {"op5_repeated_passages": op5_repeated_passages, "op3_jaccard_join": op3_jaccard_join}
