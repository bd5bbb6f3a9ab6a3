"""From raw documents to token ids: language, exact copies, near copies, mixture, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import bpe, exact_dedup, jaccard, language, mixing
from vectide.llm.common import quoted, remainder
from vectide.session import materialize

TOKENIZER = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language is ambiguous."""
    model = language.fit(docs.filter(remainder("doc_id", 3) != 1))
    found = language.identify(docs, model)
    lang_pred, _, ambiguous = found.columns[-3:]
    kept = found.filter((quoted(lang_pred) != language.UNKNOWN) & ~quoted(ambiguous))
    return kept.select(*[quoted(name) for name in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles keep the one with the least id."""
    return jaccard.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents until every source has its share of the words."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, with digests of the ids and of the text decoded from them."""
    carry = [name for name in docs.columns if name != "text"]
    return bpe.round_trip(docs, TOKENIZER, carry=carry, with_ids=True)


#: Each stage works on what the one before kept, written as Parquet and read again.
STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Trained models and merges by rank have no SQL; the pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
