"""A Spark data source for annotation files: byte ranges of files in a batch, files that appear as a stream.

Register it once per session with `register(spark)`, then read with format "annotations". Options:
path: the folder, an address that pyarrow knows and all executors reach; whole: true gives a row per file instead of one
per line; bytes: size of a range; delay: milliseconds that a file must be old before a stream takes it.
Rows: path, start (first byte of the range), nth (of the line among the non-blank ones of its range; 1 for a whole file)
and value (the line without spaces around it, or the text). Files and folders whose names begin with _ or a dot are left
out, as Spark's own readers do.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, nth int, value string"
#: Bytes of a range, pieces of one partition, bytes read and given out at once.
RANGE, PIECES, BLOCK = 32 << 20, 1000, 1 << 20
ENDS = re.compile(rb"[\r\n]")


@dataclass
class Ranges(InputPartition):
    """What one task reads: (path below the root's file system, first byte, byte after the last)."""

    pieces: tuple[tuple[str, int, int], ...]


def _located(root: str) -> tuple:
    """The file system, the folder in it, and the address as readers show it."""
    from pyarrow import fs

    uri = (root if ":" in root else f"file://{root}").rstrip("/")
    at, base = fs.FileSystem.from_uri(uri)
    return at, base, f"file:{base}" if isinstance(at, fs.LocalFileSystem) else uri


def _listed(root: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the files below root, in order of path."""
    from pyarrow import fs

    at, base, _ = _located(root)
    infos = at.get_file_info(fs.FileSelector(base, recursive=True))
    shown = [i for i in infos if i.type == fs.FileType.File and not any(p[:1] in "._" for p in i.path[len(base) :].strip("/").split("/"))]
    return sorted((i.path, i.size, i.mtime_ns or 0) for i in shown)


def cut(files: list[tuple[str, int]], size: int, whole: bool) -> list[Ranges]:
    """Files (path, bytes) in partitions of about size bytes; a longer file is cut into ranges unless it is read whole."""
    out: list[Ranges] = []
    held: list[tuple[str, int, int]] = []
    total = 0
    for path, length in files:
        step = max(length, 1) if whole else size
        for start in range(0, max(length, 1), step):
            end = min(start + step, length)
            if held and (total + end - start > size or len(held) >= PIECES):
                out.append(Ranges(tuple(held)))
                held, total = [], 0
            held.append((path, start, end))
            total += end - start
    return [*out, Ranges(tuple(held))]


def range_lines(file, start: int, end: int) -> Iterator[bytes]:
    """The non-blank lines that begin in the range, to their ends. A line ends with \\r or \\n; blank lines do not count, so
    \\r\\n is no case of its own."""
    place, first, held = max(start - 1, 0), start > 0, []
    file.seek(place)
    while place < end:
        block = file.read(BLOCK)
        if block and not ENDS.search(block):
            held.append(block)
            continue
        parts = ENDS.split(b"".join(held) + block)
        held = [parts.pop()] if block else []
        for part in parts:
            if not first and place < end and (line := part.strip(b" ")):
                yield line
            first = False
            place += len(part) + 1
        if not block:
            return


class _Files:
    """What the reader and the stream reader share."""

    def __init__(self, options: dict):
        self.root, self.whole = options["path"], options.get("whole", "false").lower() == "true"
        self.size, self.delay = int(options.get("bytes", RANGE)), int(options.get("delay", 0))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        at, base, uri = _located(self.root)
        rows: list[tuple[str, int, int, str]] = []
        held = 0
        for path, start, end in partition.pieces:
            with at.open_input_file(path) as file:
                for k, value in enumerate([file.read()] if self.whole else range_lines(file, start, end)):
                    rows.append((uri + path[len(base) :], start, k + 1, value.decode("utf-8", "replace")))
                    held += len(value) + len(path)
                    if held > BLOCK:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "start", "nth", "value"])


class BatchReader(_Files, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return cut([(path, length) for path, length, _ in _listed(self.root)], self.size, self.whole)


class StreamReader(_Files, DataSourceStreamReader):
    """Files by time of change. An offset is the latest time taken, so nothing has to be remembered about single files; a file
    must be complete, and seen by a listing, once it is `delay` milliseconds old."""

    def initialOffset(self) -> dict:
        return {"upto": -1}

    def latestOffset(self) -> dict:
        limit = time.time_ns() - self.delay * 1_000_000 if self.delay else None
        return {"upto": max((t for _, _, t in _listed(self.root) if limit is None or t <= limit), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return cut([(path, length) for path, length, t in _listed(self.root) if start["upto"] < t <= end["upto"]], self.size, self.whole)

    def commit(self, end: dict) -> None:
        pass


class Annotations(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:  # noqa: ANN001
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: ANN001, N802
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Annotations)


def annotation_lines(spark: SparkSession, root: str, size: int = RANGE) -> DataFrame:
    """path, line and value of every non-blank line below root, as files.label_lines gives them, from ranges of `size` bytes,
    so that one very long file is read by many tasks. Lines of a range are placed by the counts of the ranges before it."""
    register(spark)
    found = spark.read.format("annotations").option("bytes", size).load(root)
    counts = found.groupBy("path", "start").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("path", "start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return found.join(places, ["path", "start"]).select("path", (F.col("_before") + F.col("nth")).cast("int").alias("line"), "value")


def annotation_texts(spark: SparkSession, root: str, stream: bool = False, delay: int = 0) -> DataFrame:
    """path and value of every file below root as a whole, in a batch or as a stream of the files that appear."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("annotations").option("whole", "true").option("delay", delay)
    return reader.load(root).select("path", "value")
