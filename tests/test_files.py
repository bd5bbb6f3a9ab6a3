"""Every listed file gives a row, in batch and as a stream."""

import os

import pytest

from vectide.sources import files


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("first é")
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe no text")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "d.txt").write_text("x" * 100_000)
    (tmp_path / "e.bin").write_bytes(b"other")
    (tmp_path / "_hidden.txt").write_text("hidden")
    os.symlink(tmp_path / "gone", tmp_path / "f.txt")
    return tmp_path


def test_rows_for_all_files(spark, folder):
    rows = {r["filename"]: r for r in files.read_files(spark, str(folder), "*.txt").collect()}
    assert {"a.txt", "b.txt", "c.txt", "d.txt"} <= set(rows) and not {"e.bin", "_hidden.txt"} & set(rows)
    assert rows["b.txt"]["reason"] == files.EMPTY_FILE and rows["d.txt"]["size"] == 100_000
    found, rejects = files.text_documents(files.read_files(spark, f"file:{folder}", "[a-d].txt"))
    assert sorted(len(r["text"]) for r in found.collect()) == [7, 100_000]
    assert sorted(map(tuple, rejects.collect())) == [("b.txt", files.EMPTY_FILE), ("c.txt", files.NOT_TEXT)]


def test_a_file_that_is_gone_is_a_row_with_a_reason(tmp_path):
    (row,) = files._read(files.Files(str(tmp_path), [(str(tmp_path / "gone.txt"), 5)]))
    assert row[1] == "gone.txt" and row[3] is None and row[4].startswith(files.UNREADABLE)


def test_empty_folder(spark, tmp_path):
    assert files.read_files(spark, str(tmp_path)).count() == 0


def test_partitions_are_bounded(monkeypatch):
    monkeypatch.setattr(files, "BYTES_PER_TASK", 10)
    parts = files._partitions("/", [files.Listed(0, str(i), 4) for i in range(5)] + [files.Listed(0, "large", 100)])
    assert [[p for p, _ in part.files] for part in parts] == [["0", "1"], ["2", "3"], ["4"], ["large"]]


def test_stream_delivers_each_file_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def run():
        stream = files.stream_files(spark, str(source)).select("filename", "size", "reason")
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["filename"], r["reason"]) for r in spark.read.parquet(out).collect())

    for i in range(5):
        (source / f"{i}.txt").write_text("" if i == 2 else "text")
        os.utime(source / f"{i}.txt", (1_000 + i, 1_000 + i))
    first = [(f"{i}.txt", files.EMPTY_FILE if i == 2 else None) for i in range(5)]
    assert run() == first
    (source / "5.txt").write_text("later")
    assert run() == [*first, ("5.txt", None)]


def test_written_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("x.txt", b"one"), ("y.txt", b""), ("z.txt", None)], "filename string, content binary")
    for _ in range(2):  # delivered twice, there once
        assert sum(r["files"] for r in files.write_files(rows, str(tmp_path / "out")).collect()) == 3
    found = {r["filename"]: r["content"] and bytes(r["content"]) for r in files.read_files(spark, str(tmp_path / "out")).collect()}
    assert found == {"x.txt": b"one", "y.txt": None, "z.txt": None}
