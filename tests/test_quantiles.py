"""Latency quantiles from mergeable sketches."""

import pytest
from pyspark.sql import functions as F

from vectide.operators.evaluation import latency_quantiles, latency_sketches, merge_sketches, rank_error
from vectide.session import materialize

PROBABILITIES = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)


def asked(sketches, by):
    return {(r[by], r["probability"]): (r["seconds"], r["n_requests"]) for r in latency_quantiles(sketches, [by], PROBABILITIES).collect()}


def test_small_groups_are_exact(spark):
    log = spark.range(1000).select(F.lit("a").alias("database"), (F.col("id") * 7919 % 1000 + 1).cast("double").alias("seconds"))
    found = asked(latency_sketches(log, ["database"]), "database")
    assert {p: found["a", p][0] for p in PROBABILITIES} == {0.0: 1, 0.25: 250, 0.5: 500, 0.95: 950, 0.99: 990, 1.0: 1000}


def test_stored_sketches_of_uneven_runs_merge(spark):
    # One phase holds nearly all rows; the times of the phases do not overlap.
    log = spark.range(400_000).select(
        F.lit("a").alias("database"), F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("phase"),
        F.when(F.col("id") % 100 == 0, F.col("id") + 1e6).otherwise(F.col("id")).alias("seconds"))
    by_phase = materialize(latency_sketches(log, ["database", "phase"]), "sketches")
    assert by_phase.agg(F.max(F.octet_length("sketch"))).first()[0] < 100_000
    found = asked(merge_sketches(by_phase, ["database"]), "database")
    for p in PROBABILITIES:
        answer, n = found["a", p]
        share = log.where(F.col("seconds") <= answer).count() / 400_000
        assert n == 400_000 and abs(share - p) <= 2 * rank_error() + 1 / 400_000
    assert found["a", 1.0][0] > 1e6


def test_nulls_ties_and_empty_logs(spark):
    rows = [("a", None), ("a", 2.0), ("b", None)] + [("c", 5.0)] * 3000
    log = spark.createDataFrame(rows, "database string, seconds double")
    found = asked(latency_sketches(log, ["database"]), "database")
    assert {key[0] for key in found} == {"a", "c"}
    assert found["a", 0.5] == (2.0, 1) and found["c", 0.99] == (5.0, 3000)
    empty = latency_sketches(log.limit(0), ["database"])
    assert latency_quantiles(merge_sketches(empty, ["database"]), ["database"]).count() == 0


def test_wrong_probabilities(spark):
    with pytest.raises(ValueError):
        latency_quantiles(spark.range(1), ["id"], (1.5,))


def test_a_larger_sketch_errs_less():
    assert 0.0027 < rank_error(1024) < 0.0028 and rank_error(200) == pytest.approx(0.0133, abs=1e-4)
