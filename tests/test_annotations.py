"""The data source of annotation files against Spark's own readers, in batches and as a stream."""

import io
import os

import pytest

from inspectra.sources import annotations, files
from inspectra.streaming import feeds


def put(root, name, data, at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    if at is not None:
        os.utime(path, ns=(at, at))


TEXTS = {
    "train/labels/a.txt": b"0 0.5 0.5 0.1 0.1\n\n  1 0.5 0.5 0.2 0.2  \r\n2 1 1 1 1\r3 1 1 1 1",
    "train/labels/b.txt": "é 0.5 ü\n".encode() * 50 + b"\n \n\r\r\n",
    "val/labels/c.txt": b"",
    "val/labels/d.txt": b" \n\t\n",
    "val/labels/e.txt": b"x" * 300 + b"\n" + b"y",
    "val/_hidden/f.txt": b"0 1 1 1 1",
    "val/labels/.g.txt": b"0 1 1 1 1",
}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_give_the_lines_of_the_whole_text(size):
    for text in TEXTS.values():
        want = [x.strip(b" ") for x in text.replace(b"\r", b"\n").split(b"\n") if x.strip(b" ")]
        ranges = [p for r in annotations.cut([("p", len(text))], size, False) for p in r.pieces]
        assert [x for _, start, end in ranges for x in annotations.range_lines(io.BytesIO(text), start, end)] == want


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_do_not_matter(monkeypatch, block):
    monkeypatch.setattr(annotations, "BLOCK", block)
    test_ranges_give_the_lines_of_the_whole_text(7)


def test_partitions_cover_files_once():
    made = annotations.cut([("a", 10), ("b", 0), ("c", 25), ("d", 3)], 10, False)
    assert [p.pieces for p in made] == [(("a", 0, 10), ("b", 0, 0)), (("c", 0, 10),), (("c", 10, 20),), (("c", 20, 25), ("d", 0, 3))]
    assert [p.pieces for p in annotations.cut([("c", 25), ("d", 3)], 10, True)] == [(("c", 0, 25),), (("d", 0, 3),)]
    assert [p.pieces for p in annotations.cut([], 10, False)] == [()]


@pytest.mark.parametrize("size", [16, annotations.RANGE])
def test_same_rows_as_the_reader_of_whole_texts(spark, tmp_path, size):
    for name, data in TEXTS.items():
        put(tmp_path, name, data)
    got = sorted(tuple(r) for r in annotations.annotation_lines(spark, str(tmp_path), size).collect())
    want = sorted((r.path, r.line, r.value) for r in files.label_lines(spark, str(tmp_path)).collect())
    assert got == want and len(got) == 57


def test_reports_of_several_lines_are_read_whole(spark, tmp_path):
    put(tmp_path, "a.json", b'{\n "summary": {\n  "total_images": 3\n }\n}')
    put(tmp_path, "b.json", b"{\n broken")
    read = files.read_reports(spark, str(tmp_path / "*.json"))
    assert [(r[0].rsplit("/", 1)[1], r[1]) for r in read.selectExpr("path", "variant_get(report, '$.summary.total_images', 'int')").collect()] == [("a.json", 3)]


def test_empty_folder_and_whole_texts(spark, tmp_path):
    assert annotations.annotation_lines(spark, str(tmp_path)).count() == 0
    put(tmp_path, "a.xml", b"<annotation>\n</annotation>")
    put(tmp_path, "b.xml", b"")
    got = {r.path.rsplit("/", 1)[1]: r.value for r in annotations.annotation_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.xml": "<annotation>\n</annotation>", "b.xml": ""}


def test_stream_takes_each_file_once(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    put(root, "a.xml", b"one", 1_000_000_000)
    put(root, "b.xml", b"two", 1_000_000_000)

    def go():
        feeds.to_parquet(annotations.annotation_texts(spark, str(root), stream=True), checkpoint, out).awaitTermination()
        return sorted(r.value for r in spark.read.schema("path string, value string").parquet(out).collect())

    assert go() == ["one", "two"]
    assert go() == ["one", "two"]
    put(root, "sub/c.xml", b"three", 2_000_000_000)
    assert go() == ["one", "three", "two"]


def test_a_young_file_waits(tmp_path):
    put(tmp_path, "old.txt", b"1", 5_000_000_000)
    put(tmp_path, "new.txt", b"2")
    options = {"path": str(tmp_path), "delay": "3600000"}
    reader = annotations.StreamReader(options)
    upto = reader.latestOffset()
    assert upto == {"upto": 5_000_000_000}
    assert [[p[0].rsplit("/", 1)[1] for p in r.pieces] for r in reader.partitions(reader.initialOffset(), upto)] == [["old.txt"]]
