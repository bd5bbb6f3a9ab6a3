"""Sidecar rows that come after their documents, in streams."""

import pytest
from pyspark.sql import functions as F

from vectide.operators.documents import NO_METADATA, attach_metadata
from vectide.plans.ingest import IngestOptions
from vectide.sources.collections import open_collection
from vectide.streaming.late import attach_late_metadata, stream_ingest_late

START = 1_700_000_000
DOCS = "doc_id long, filename string, text string, arrived timestamp"
NOTES = "digest string, file_size long, date string, pos long, arrived timestamp"


def at(df, seconds="seconds"):
    return df.withColumn("arrived", F.timestamp_seconds(F.lit(START) + F.col(seconds))).drop(seconds)


def documents(spark, *rows):
    return at(spark.createDataFrame([(i, f"data{i}.pdf", f"text of {i}", s) for i, s in rows], "doc_id long, filename string, text string, seconds long"))


def notes(spark, *rows):
    return at(spark.createDataFrame([(*r[:1], r[1], "2024-01-02T03", *r[2:]) for r in rows], "digest string, file_size long, date string, pos long, seconds long"))


@pytest.fixture()
def streams(spark, tmp_path):
    """``add(documents, notes)`` puts files where the streams look; ``described()`` is the stream."""
    paths = [str(tmp_path / name) for name in ("documents", "notes")]

    def add(*frames):
        for frame, path in zip(frames, paths):
            if frame is not None:
                frame.coalesce(1).write.mode("append").parquet(path)

    def described():
        given = [spark.readStream.schema(schema).parquet(path) for schema, path in zip((DOCS, NOTES), paths)]
        return attach_late_metadata(*given, "doc_id", within="1 hour", delay="10 minutes")

    return add, described, paths


def far(spark):
    return documents(spark, (None, 900_000)), notes(spark, ("-", 0, 0, 900_000))


def test_late_rows_match_and_the_rest_is_rejected_in_its_time(spark, tmp_path, streams):
    add, described, _ = streams
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        described().writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(
            path=out, format="parquet", outputMode="append").awaitTermination()
        return {r["doc_id"]: (r["file_size"], r["reason"]) for r in spark.read.parquet(out).collect()}

    # 1 has its row first, 2 later, 3 two of which the first in file order comes last, 4 none, 5 one that is out of time.
    docs = documents(spark, (1, 0), (2, 5), (3, 10), (4, 15), (5, 20))
    first = notes(spark, ("1", 11, 1, 0), ("3", 39, 9, 5))
    later = notes(spark, ("2", 22, 2, 1_000), ("3", 33, 3, 1_200))
    add(docs, first)
    assert run() == {}
    add(documents(spark, (6, 1_200)), later)
    assert run() == {}
    add(documents(spark, (7, 5_000)), notes(spark, ("5", 55, 5, 5_000), ("7", 77, 7, 5_100)))
    found = run()
    assert found == {1: (11, None), 2: (22, None), 3: (33, None), 4: (None, NO_METADATA), 5: (None, NO_METADATA)}
    add(*far(spark))
    assert run() == found | {6: (None, NO_METADATA), 7: (77, None)}
    kept, missing = attach_metadata(docs.where("doc_id < 5"), first.unionByName(later).drop("arrived"), "doc_id")
    assert {r["doc_id"]: r["size"] for r in kept.collect()} == {1: "11", 2: "22", 3: "33"}
    assert [r["doc_id"] for r in missing.collect()] == [4]


def test_described_documents_are_loaded(spark, tmp_path, streams):
    add, described, paths = streams
    table = open_collection(spark, str(tmp_path / "table")).create("namespaced", dim=8)
    dead = str(tmp_path / "dead")

    def run():
        stream_ingest_late(
            described(), lambda: spark.read.schema(DOCS).parquet(paths[0]).where("doc_id is not null"), table,
            str(tmp_path / "state"), IngestOptions(dim=8), dead).awaitTermination()
        return sorted((r["filename"], r["size"]) for r in table.read().select("metadata.*").collect())

    add(documents(spark, (1, 0), (2, 5), (3, 9)), notes(spark, ("1", 11, 1, 0)))
    assert run() == []
    add(far(spark)[0], notes(spark, ("3", 33, 3, 900)))
    add(None, far(spark)[1])
    assert run() == [("data1.pdf", "11"), ("data3.pdf", "33")]
    assert [(r["doc_id"], r["reason"]) for r in spark.read.parquet(dead).collect()] == [(2, NO_METADATA)]
