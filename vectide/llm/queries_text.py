"""Queries of the operators that judge or encode one text at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import bpe, repetition
from vectide.llm.common import table

#: Vocabulary of the encoding query: a file of the installed tokenizer package.
TOKENIZER = "byte_bpe_50k.json"


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, carry=["doc_id"])


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])


QUERIES = {"op2_bpe_round_trip": op2_bpe_round_trip, "op9_repetition_rules": op9_repetition_rules}
