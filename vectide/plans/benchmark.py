"""Timed runs of a prompt set against vector tables, and their summary."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.numbers import sig3
from vectide.operators.embedding import Encoder
from vectide.plans.retrieval import encode_queries, search, workload_run
from vectide.session import materialize
from vectide.sources.collections import Collection
from vectide.sources.sinks import dump_results

RUN_LOG = "database string, phase string, started timestamp, seconds double, n_requests bigint"
PHASES = ["encode", "quality", "workload"]


def benchmark_run(
    databases: dict[str, Collection],
    prompts: DataFrame,
    path: str,
    iterations: int = 100,
    k: int = 5,
    encoder_factory: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """Time three jobs per database and log one row for each.

    ``encode`` turns the prompts into vectors, so that encoding is not part of
    the search times. ``quality`` writes the shaped hits of every prompt below
    ``path``. ``workload`` searches every prompt ``iterations`` times.
    """
    log = []
    n_prompts = prompts.count()
    for name, collection in databases.items():
        found = collection.properties()
        rows, metric, dim = collection.search_rows(), found["metric"], found["dim"]

        def timed(phase: str, n_requests: int, job: Callable[[], object]):
            started, begun = datetime.datetime.now(), time.perf_counter()
            result = job()
            log.append((name, phase, started, time.perf_counter() - begun, n_requests))
            return result

        encoded = timed("encode", n_prompts, lambda: materialize(encode_queries(prompts, dim, encoder_factory), "prompts"))
        timed("quality", n_prompts, lambda: dump_results(
            search(rows, encoded, k, metric, dim=dim), f"{path}/{name}-results"))
        timed("workload", n_prompts * iterations, lambda: workload_run(
            rows, encoded, iterations, k, metric, dim).write.format("noop").mode("overwrite").save())
    # One row per database and phase.
    return prompts.sparkSession.createDataFrame(log, RUN_LOG)


def benchmark_summary(log: DataFrame) -> DataFrame:
    """One row per database: mean per request and total of each phase, to three digits."""
    totals = log.groupBy("database").pivot("phase", PHASES).agg(
        sig3(F.sum("seconds") / F.sum("n_requests")).alias("mean"), sig3(F.sum("seconds")).alias("total")
    )
    return totals.join(log.groupBy("database").agg(sig3(F.sum("seconds")).alias("total")), "database")
