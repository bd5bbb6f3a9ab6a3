"""Delivered rows count once, whatever is killed, repeated or delivered again."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.sources.delivery import BatchWriter, FolderSink, StreamWriter, register_sink

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def rows(n, first=0):
    ids = list(range(first, first + n))
    return [pa.RecordBatch.from_pydict({"id": ids[i:i + 70], "text": [f"t{x}" for x in ids[i:i + 70]]}) for i in range(0, n, 70)]


def delivered(spark, sink):
    return sorted(r["id"] for r in sink.read(spark, SCHEMA).collect())


def sizes(path):
    return sorted(pq.read_metadata(f).num_rows for f in path.glob("staged/*/*.parquet"))


def test_batches_are_cut_by_size(spark, tmp_path):
    sink = FolderSink(str(tmp_path))
    writer = BatchWriter(sink, 100, SCHEMA, "1")
    writer.commit([writer.write(iter(rows(350))), writer.write(iter([])), None])
    assert sizes(tmp_path) == [50, 100, 100, 100] and delivered(spark, sink) == list(range(350))


def test_a_killed_and_repeated_task_counts_once(spark, tmp_path):
    sink = FolderSink(str(tmp_path))
    writer = BatchWriter(sink, 100, SCHEMA, "1")
    writer.write(iter(rows(120)))  # its executor is lost after the rows, before its message
    writer.commit([writer.write(iter(rows(120))), writer.write(iter(rows(30, 120)))])
    assert delivered(spark, sink) == list(range(150))


def test_a_failing_task_leaves_nothing(tmp_path):
    def broken():
        yield from rows(210)
        raise OSError("gone")

    writer = BatchWriter(FolderSink(str(tmp_path)), 100, SCHEMA, "1")
    with pytest.raises(OSError):
        writer.write(broken())
    assert sizes(tmp_path) == []


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    sink = FolderSink(str(tmp_path))
    for _ in range(2):
        writer = StreamWriter(sink, 100, SCHEMA, "s")
        writer.commit([writer.write(iter(rows(120)))], 4)
    writer.commit([writer.write(iter(rows(5, 500)))], 5)
    assert delivered(spark, sink) == [*range(120), *range(500, 505)]
    assert sizes(tmp_path) == [5, 20, 100]


def test_batch_write_of_a_job_that_fails_publishes_nothing(spark, tmp_path):
    sink = FolderSink(str(tmp_path))
    name = register_sink(spark, "failing_delivery", sink)
    given = spark.range(1000, numPartitions=4).withColumn("text", F.when(F.col("id") == 900, F.raise_error("bad")).otherwise("x"))
    with pytest.raises(Exception, match="bad"):
        given.write.format(name).option("batch", "1").mode("append").save()
    assert sink.published() == {}
    given.where("id < 900").write.format(name).option("batch", "1").mode("append").save()
    assert delivered(spark, sink) == list(range(900))
    with pytest.raises(Exception, match="option batch"):
        given.write.format(name).mode("append").save()


def test_stream_that_runs_a_batch_again(spark, tmp_path):
    sink = FolderSink(str(tmp_path / "out"))
    name = register_sink(spark, "stream_delivery", sink)
    source, state = tmp_path / "in", tmp_path / "state"

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        stream.writeStream.format(name).option("batch", "docs").option("rows", 40).option(
            "checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()

    for part in range(2):
        spark.range(part * 100, part * 100 + 100).withColumn("text", F.lit("x")).write.mode("append").parquet(str(source))
        run()
    assert delivered(spark, sink) == list(range(200))
    # Spark's own record of the last batch is lost, so that it runs it again.
    for file in [*state.glob("commits/1"), *state.glob("commits/.1.crc")]:
        file.unlink()
    run()
    assert delivered(spark, sink) == list(range(200)) and set(sink.published()) == {"docs-0", "docs-1"}
