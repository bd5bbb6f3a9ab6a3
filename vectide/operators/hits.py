"""Shaping, hydrating and comparing hit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.operators.idfilter import may_contain
from vectide.operators.ordering import first_ranked
from vectide.session import materialize


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a side of a join by itself; 0 if it never does."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    return 0 if text.startswith("-") else jvm.byteStringAsBytes(text)


def hydrate_hits(
    hits: DataFrame, stored: DataFrame, columns: list[str], id_col: str = "id", broadcast_bytes: int | None = None
) -> DataFrame:
    """Fetch stored columns for hits by id; hits without a stored row keep nulls.

    The hits are written once, because they are read twice and searching again
    costs more. Only stored rows that are hits survive the semi join. While
    their ids are few, Spark broadcasts them for it; with more than
    ``broadcast_bytes`` of ids (the session's own limit by default) a bit table
    of the ids goes ahead of the join, so that the wide columns are shuffled
    for hits and a sixteenth of the other rows. Copies of an id give one
    deterministic row. The rows found are written too: between two plain
    shuffles Spark can split an id that is a hit of very many queries.
    """
    hits = materialize(hits, "hits")
    wanted = hits.select(F.col("id")).distinct()
    source = stored.select(F.col(id_col).alias("id"), *columns)
    limit = broadcast_limit(hits.sparkSession) if broadcast_bytes is None else broadcast_bytes
    # A bound first, over the hits as they lie: it saves the count of the ids where they are surely few.
    width = F.octet_length(F.col("id").cast("string")) + 16
    if (hits.agg(F.sum(width)).first()[0] or 0) > limit:
        wanted = materialize(wanted, "wanted")
        source = may_contain(source, wanted, wanted.count())
    needed = source.join(wanted, "id", "left_semi")
    # Free metadata have no hash of their own, their text has.
    hashed = [F.to_json(c) if isinstance(source.schema[c].dataType, T.VariantType) else F.col(c) for c in columns]
    one_each = materialize(first_ranked(needed, ["id"], [F.xxhash64(*hashed).asc()]), "found")
    return hits.join(one_each, "id", "left").select(*hits.columns, *columns)


def shape_hits(
    hits: DataFrame,
    metadata: str = "metadata",
    text: str | None = None,
    include_metadata: bool = True,
    include_text: bool = True,
    vector: str | None = None,
) -> DataFrame:
    """Uniform hits: ``query_id, rank, id, score, metadata, text`` (and ``extra`` where there are free metadata, and ``values``).

    Without a ``text`` column the text is lifted out of the metadata. Metadata
    loses ``text`` and ``created_at``; the switches null a column out, and
    Catalyst then no longer reads it.
    """
    fields = [f.name for f in getattr(hits.schema[metadata].dataType, "fields", [])]
    lifted = F.col(text) if text else F.col(f"{metadata}.text")
    dropped = [f for f in ("text", "created_at") if f in fields]
    described = F.col(metadata).dropFields(*dropped) if dropped else F.col(metadata)
    shaped = [
        "query_id", "rank", "id", "score",
        F.when(F.lit(include_metadata), described).alias("metadata"),
        F.when(F.lit(include_text), lifted).alias("text"),
    ]
    if "extra" in hits.columns:
        shaped.append("extra")
    if vector:
        shaped.append(F.col(vector).alias("values"))
    return hits.select(*shaped)


def result_agreement(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """Per query: hits of each side, hits they share, and the share of ``k``."""
    left = a.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("in_a"))
    right = b.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("in_b"))
    both = left.join(right, ["query_id", "id"], "full_outer")
    counted = both.groupBy("query_id").agg(
        F.count("in_a").alias("n_a"),
        F.count("in_b").alias("n_b"),
        F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("n_both"),
    )
    return counted.withColumn("overlap", F.round(F.col("n_both") / F.greatest("n_a", "n_b"), 6))


def recall(approximate: DataFrame, exact: DataFrame, k: int = 5) -> float:
    """Share of the exact hits that the approximate search returned."""
    agreed = result_agreement(approximate, exact, k).agg(F.sum("n_both"), F.sum("n_b")).first()
    return agreed[0] / agreed[1] if agreed[1] else 1.0
