"""Workloads and latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.numbers import sig3

#: Size of a latency sketch; up to so many values it is exact.
SKETCH_K = 1024
PROBABILITIES = (0.5, 0.95, 0.99)
MEASURES = ["mean_request", "mean_wall", "total_request", "total_wall"]


def replicate_workload(queries: DataFrame, iterations: int) -> DataFrame:
    """Every query once per iteration, under a request id of its own.

    Expanded row by row, without a join. The requests are then spread over the
    cores, because a handful of prompts would otherwise keep one task busy.
    """
    if iterations < 1:
        raise ValueError("iterations must be positive")
    spread = queries.sparkSession.sparkContext.defaultParallelism
    repeats = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration")
    expanded = queries.select("*", repeats)
    numbered = expanded.withColumn("request_id", F.col("query_id") * F.lit(iterations) + F.col("iteration"))
    return numbered.repartition(spread, "request_id")


def latency_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Request counts and times per group of ``database, phase, started, seconds``.

    ``mean_request`` is the mean time of one request; ``mean_wall`` divides the
    wall time of the group by its requests.
    """
    start = F.unix_micros(F.col("started").cast("timestamp"))
    end = start + F.round(F.col("seconds") * 1_000_000).cast("bigint")
    grouped = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum(F.col("seconds").cast("decimal(18,6)")).cast("double").alias("total_request"),
        ((F.max(end) - F.min(start)) / 1_000_000).alias("total_wall"),
    )
    return grouped.select(
        *by,
        "n_requests",
        (F.col("total_request") / F.col("n_requests")).alias("mean_request"),
        (F.col("total_wall") / F.col("n_requests")).alias("mean_wall"),
        "total_request",
        "total_wall",
    )


def rank_error(k: int = SKETCH_K) -> float:
    """Greatest distance between the rank asked for and that of the answer, at 99 % confidence, as a share of the values."""
    return 2.296 / k**0.9723


def latency_sketches(log: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """``sketch`` and ``n_requests`` per group: a few kilobytes that can be stored and merged later.

    Tasks send sketches, not values, however many values a group has. Null
    times do not count.
    """
    timed = log.where(F.col("seconds").isNotNull())
    return timed.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col("seconds").cast("double"), F.lit(k)).alias("sketch"),
        F.count(F.lit(1)).alias("n_requests"),
    )


def merge_sketches(sketches: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of wider groups, from stored ones of any runs or phases; the log is not read again."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n_requests").alias("n_requests")
    )


def latency_quantiles(sketches: DataFrame, by: list[str], probabilities: tuple[float, ...] = PROBABILITIES) -> DataFrame:
    """``n_requests, probability, seconds``: the least time that this share of the requests did not exceed, within :func:`rank_error`."""
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    answers = F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("seconds"))
        for p in probabilities
    ])).alias("_answer")
    return sketches.select(*by, "n_requests", answers).select(*by, "n_requests", "_answer.*")


def rounded_summary(summary: DataFrame) -> DataFrame:
    """Summary with its times at three significant digits."""
    return summary.select(*[sig3(F.col(c)).alias(c) if c in MEASURES else F.col(c) for c in summary.columns])


def compare_report(summary: DataFrame, databases: list[str]) -> DataFrame:
    """Measures as rows and databases as columns."""
    long = summary.unpivot(["database"], MEASURES, "metric", "value")
    return long.groupBy("metric").pivot("database", databases).agg(F.first("value", ignorenulls=True))


def ingest_report(documents: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Documents and characters per group."""
    return documents.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.length(text).cast("bigint")).alias("n_chars"),
    )
