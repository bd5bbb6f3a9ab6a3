"""Queries of the operators on sequences of tokens and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import alignment, pieces, repair
from vectide.llm.common import table

#: Files of the installed tokenizer package.
BYTE_VOCABULARY, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), PIECE_MODEL, carry=["doc_id"])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.repair(damaged, lost=damaged.columns[-1])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_MODEL, carry=["doc_id"])


QUERIES = {"op11_piece_round_trip": op11_piece_round_trip, "op12_conversation_repair": op12_conversation_repair,
           "op13_token_alignment": op13_token_alignment}
