"""Ranking and dense numbering without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.session import materialize


def first_ranked(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """Best ``k`` rows of each key.

    Spark plans the filtered ``row_number`` as a group limit on both sides of
    the shuffle, so a hot key sends at most ``k`` rows per task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def rank_documents(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Start position of each document when all are laid out in key order.

    ``counts`` has one row per document with its number of items ``n``. Rows
    are range-partitioned by key and written once, so their partition numbers
    are fixed even if a task is repeated. One total per partition, not one row
    per document, is summed up in order; the rest stays parallel.
    """
    ranged = (
        counts.select(key, n)
        .repartitionByRange(key)
        .withColumn("_part", F.spark_partition_id())
    )
    placed = materialize(ranged, "ranges")
    totals = placed.groupBy("_part").agg(F.sum(n).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, a number set by configuration.
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return local.join(F.broadcast(starts), "_part").select(
        key, n, (F.col("_start") + F.col("_local")).cast("bigint").alias("first_id")
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core work when a scan has fewer splits than there are cores.

    For rows that are costly to process, such as long texts in few files. A
    scan that already has a split per core, as any large one does, is returned
    as it is, without a shuffle. ``df`` must be a plain scan: counting the
    partitions of anything that shuffles would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > cores else df.repartition(cores, key)
