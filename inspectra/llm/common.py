"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; a word is a longest run of anything else.
BREAKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A name for a column of our own that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or a local one in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Folders that keep has written and clear has not removed.
KEPT: list[str] = []


def clear(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove what keep has written, or some of it. Results not written yet read these tables, so call it after their write."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in list(KEPT if paths is None else paths):
        path = hadoop(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        KEPT.remove(name)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    KEPT.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of a few megabytes for this session, so that Python workers stay small beside long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def hold_on(on: bool = True) -> None:
    """Let this worker's allocator keep what is freed until give_back, so that loops over arrays of megabytes need not fetch them
    from the system, page by page, each time. Without `on` it keeps as little as after any large array, from now on."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)  # of glibc
    if option:
        option(-1, 1 << (30 if on else 26))  # M_TRIM_THRESHOLD
        option(-3, 1 << 25)  # M_MMAP_THRESHOLD
    if not on:
        give_back()


def give_back() -> None:
    """Return unused memory of this worker to the system, Arrow's and the allocator's: a worker waits for its next task with
    what it holds, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def seeded(seed: str, *cols: Column) -> Column:
    """A number from 0 to 2^60 - 1 drawn from the seed and the columns; the same in any SQL engine with md5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
