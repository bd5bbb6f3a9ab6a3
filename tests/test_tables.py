"""Vector tables, sinks and sources."""

import json

import pytest
from pyspark.sql import functions as F

from vectide.operators import layouts
from vectide.operators.documents import assemble_pages
from vectide.plans import inputs
from vectide.session import materialize, scratch_path, shared_folder
from vectide.sources import documents as sources
from vectide.sources import sinks
from vectide.sources.collections import fan_out, open_collection


def record(i, value=1.0, namespace="a", text="t"):
    return (str(i), [value] * 3, (f"f{i}", "9", "2024-01-01", 1, text), namespace)


def records(spark, rows):
    return spark.createDataFrame(rows, layouts.SCHEMAS["namespaced"])


def content(collection):
    return sorted((r["namespace"], r["id"], r["values"][0]) for r in collection.read().collect())


@pytest.fixture
def collection(spark):
    return open_collection(spark, scratch_path(spark, "table")).create("namespaced", dim=3)


def test_create_keeps_what_exists(spark, collection):
    collection.upsert(records(spark, [record(1)]))
    again = open_collection(spark, collection.path + "/").create("namespaced", dim=99, metric="ip")
    assert again.properties()["dim"] == 3 and again.properties()["metric"] == "cosine"
    assert content(again) == [("a", "1", 1.0)]


def test_missing_and_unknown(spark):
    nowhere = open_collection(spark, scratch_path(spark, "nowhere"))
    assert nowhere.properties() is None
    with pytest.raises(ValueError):
        nowhere.read()
    with pytest.raises(ValueError):
        nowhere.create("columnar")


def test_empty_table_has_its_schema(collection):
    assert collection.read().schema.names == layouts.SCHEMAS["namespaced"].names
    assert collection.read().count() == 0


def test_upsert_twice_is_upsert_once(spark, collection):
    batch = records(spark, [record(1, 1.0), record(2, 2.0)])
    collection.upsert(batch)
    once = content(collection)
    collection.upsert(batch)
    assert content(collection) == once == [("a", "1", 1.0), ("a", "2", 2.0)]


def test_newest_wins_within_namespace(spark, collection):
    collection.upsert(records(spark, [record(1, 1.0, "a"), record(1, 1.0, "b")]))
    collection.compact()
    collection.upsert(records(spark, [record(1, 5.0, "b"), record(3, 3.0, "b")]))
    assert content(collection) == [("a", "1", 1.0), ("b", "1", 5.0), ("b", "3", 3.0)]
    collection.upsert(records(spark, [record(3, 4.0, "b")]))
    collection.compact()
    assert content(collection) == [("a", "1", 1.0), ("b", "1", 5.0), ("b", "3", 4.0)]


def test_order_decides_within_a_batch(spark, collection):
    rows = records(spark, [record(1, float(v)) for v in range(50)]).withColumn("version", F.col("values")[0])
    collection.upsert(rows.withColumn("version", -F.col("version")), order="version")
    assert content(collection) == [("a", "1", 0.0)]


def test_repeated_keys_in_a_batch_are_read_once(spark, collection):
    collection.upsert(records(spark, [record(1, float(v % 7)) for v in range(50)]))
    found = content(collection)
    assert len(found) == 1
    collection.compact()
    assert content(collection) == found


def test_load_fills_an_empty_table_and_upserts_otherwise(spark, collection):
    collection.load(records(spark, [record(1, 1.0), record(2, 2.0)]))
    assert collection.last_batch() == 0
    collection.load(records(spark, [record(2, 3.0)]))
    assert content(collection) == [("a", "1", 1.0), ("a", "2", 3.0)]


def test_redelivered_batches_count_once(spark, collection):
    collection.upsert(records(spark, [record(1, 1.0)]), batch=1)
    collection.upsert(records(spark, [record(1, 2.0)]), batch=2)
    collection.upsert(records(spark, [record(1, 1.0)]), batch=1)
    assert content(collection) == [("a", "1", 2.0)]
    collection.compact()
    collection.upsert(records(spark, [record(1, 1.0)]), batch=1)
    assert content(collection) == [("a", "1", 2.0)]


def test_batch_numbers_start_at_one(spark, collection):
    with pytest.raises(ValueError):
        collection.upsert(records(spark, [record(1)]), batch=0)


def test_clear_namespace_then_load_again(spark, collection):
    collection.upsert(records(spark, [record(1, 1.0, "a"), record(2, 2.0, "b")]))
    collection.compact()
    collection.upsert(records(spark, [record(3, 3.0, "a")]))
    collection.clear_namespace("a")
    assert content(collection) == [("b", "2", 2.0)]
    collection.upsert(records(spark, [record(1, 9.0, "a")]))
    assert content(collection) == [("a", "1", 9.0), ("b", "2", 2.0)]
    collection.compact()
    assert content(collection) == [("a", "1", 9.0), ("b", "2", 2.0)]


def test_clear_then_append_and_upsert(spark, collection):
    collection.upsert(records(spark, [record(1)]))
    collection.clear()
    assert content(collection) == []
    collection.append(records(spark, [record(1, 2.0), record(1, 2.0)]))
    assert content(collection) == [("a", "1", 2.0)] * 2
    collection.clear_namespace("a")
    collection.append(records(spark, [record(7, 7.0)]))
    assert content(collection) == [("a", "7", 7.0)]


def test_namespaces_only_where_declared(spark):
    typed = open_collection(spark, scratch_path(spark, "typed")).create("typed")
    with pytest.raises(ValueError):
        typed.clear_namespace("a")


def test_fan_out_leaves_the_records_alone(spark):
    made = [open_collection(spark, scratch_path(spark, n)).create(n, dim=3) for n in layouts.SCHEMAS]
    rows = records(spark, [record(1, text="hello")])
    fan_out(rows, made)
    typed, namespaced, payload = (c.read().first() for c in made)
    assert json.loads(typed["metadata"]) == {"filename": "f1", "size": "9", "chunk": 1} and typed["text"] == "hello"
    assert namespaced["namespace"] == "development" and namespaced["metadata"]["text"] == "hello"
    assert payload["payload"]["document_id"] == "f1" and payload["payload"]["chunk_part"] == 1
    assert payload["payload"]["metadata"]["created_at"] == "2024-01-01"


def test_constraints(spark):
    rows = records(spark, [record(1), record(2, text="x" * 5001), record(3, text="x" * 5000)])
    rows = rows.unionByName(rows.limit(1).withColumn("id", F.lit("4")).withColumn("values", F.array(F.lit(1.0).cast("float"))))
    kept, rejects = layouts.check_constraints(rows, dim=3)
    assert sorted(r["id"] for r in kept.collect()) == ["1", "3"]
    assert sorted(map(tuple, rejects.collect())) == [("2", "text_too_long"), ("4", "wrong_dimension")]


def test_delivery_reports_failed_batches(spark):
    rows = spark.range(0, 1050, 1, 4).withColumn("text", F.lit("x"))

    def factory():
        def sink(batch):
            if 500 in batch.column("id").to_pylist():
                raise RuntimeError("refused")

        return sink

    report = sinks.deliver_batches(rows, factory, 100).toPandas()
    assert report["n_rows"].sum() == 1050 and report["n_rows"].max() == 100
    assert list(report[report["error"].notna()]["error"]) == ["RuntimeError: refused"]
    assert report.groupby("task")["batch"].apply(lambda b: list(b) == list(range(len(b)))).all()


def test_json_keeps_all_rows_and_nulls(spark):
    rows = records(spark, [record(i, text=None if i == 3 else "t") for i in range(20)]).repartition(4)
    path = scratch_path(spark, "json")
    sinks.write_json(rows, path)
    sinks.write_json(rows, path)
    assert sinks.read_json(spark, path, rows.schema).exceptAll(rows).count() == 0
    assert sinks.read_json(spark, path, rows.schema).count() == 20


def test_text_files_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text(" ")
    (tmp_path / "c.bin").write_bytes(b"1|2|3")
    (tmp_path / "d.bin").write_bytes(b"broken")
    (tmp_path / "e.bin").write_bytes(b"|")
    texts = sources.scan_text_files(spark, str(tmp_path), "*.txt")
    assert sorted(map(tuple, texts.collect())) == [("a.txt", "one\ntwo"), ("b.txt", " ")]

    def extractor(content: bytes) -> list[str]:
        if content == b"broken":
            raise ValueError("not a document")
        return [p for p in content.decode().split("|") if p]

    pages, failed = sources.extract_pages(sources.scan_files(spark, str(tmp_path), "*.bin"), extractor)
    assert sorted(map(tuple, failed.collect())) == [("d.bin", "extract_failed")]
    assembled = assemble_pages(pages, "filename", "page_no")
    assert sorted(map(tuple, assembled.collect())) == [("c.bin", "123"), ("e.bin", "")]


def test_pdf_reader_is_optional():
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="install pypdf"):
            sources.pdf_extractor()(b"")


def test_sidecar_file_order_decides(spark, tmp_path):
    from vectide.operators.documents import first_sidecar_rows

    lines = ["digest,file_size,date"] + [f"d{i % 100},{i},2024-01-{1 + i % 28:02}" for i in range(1000)]
    (tmp_path / "metadata.csv").write_text("\n".join(lines))
    first = first_sidecar_rows(sources.read_sidecar(spark, str(tmp_path / "metadata.csv")))
    assert sorted(r["file_size"] for r in first.collect()) == list(range(100))


def test_shared_folder_follows_the_setting(spark, sf_dir):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")
    kept = materialize(inputs.vectors(spark, sf_dir), "copy")
    assert kept.inputFiles()[0].removeprefix("file:").lstrip("/").startswith(shared_folder(spark).removeprefix("file:").lstrip("/"))
    assert kept.count() == 500


class FakeContext:
    def __init__(self, master, directory=None):
        self.master, self.directory = master, directory

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return self.directory

    def setCheckpointDir(self, directory):
        self.directory = f"file:{directory}/session"


class FakeSession:
    def __init__(self, context, named=None):
        self.sparkContext, self.conf = context, {"spark.checkpoint.dir": named} if named else {}


def test_only_a_local_session_may_choose_a_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession(FakeContext("spark://host:7077")))
    assert shared_folder(FakeSession(FakeContext("yarn"), "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(FakeSession(FakeContext("yarn", "hdfs:///set/by/user"))) == "hdfs:///set/by/user"
    local = FakeSession(FakeContext("local[2]"))
    assert shared_folder(local) == shared_folder(local)
