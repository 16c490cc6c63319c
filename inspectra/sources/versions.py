"""Tables that are changed by rewriting the buckets of the keys that change.

A table is a folder: data/<folder>/bucket=<b> holds the rows of a bucket as one change wrote them, commits a row for each
bucket that a change rewrote (version, bucket, folder, buckets). A bucket's rows are in the folder of its last version, so
a change becomes visible when the one file of its commit does, buckets that it does not touch keep their files, and earlier
versions stay readable. Folders that no commit names, as a failed writer leaves them, are not read. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.workflow import insert_absent, upsert

COMMIT = "version long, bucket int, folder string, buckets int"


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, root: str, folder: str, version: int, buckets: int) -> None:
    """One file, of a row for each bucket in the folder; its rename makes the version."""
    done = spark.read.parquet(f"{root}/data/{folder}").select("bucket").distinct()
    rows = done.select(F.lit(version).cast("long").alias("version"), F.col("bucket").cast("int").alias("bucket"), F.lit(folder).alias("folder"), F.lit(buckets).cast("int").alias("buckets"))
    rows.coalesce(1).write.mode("append").parquet(f"{root}/commits")


def _write(rows: DataFrame, root: str, key: list[str], buckets: int) -> str:
    folder = uuid.uuid4().hex
    rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/data/{folder}")
    return folder


def create_table(rows: DataFrame, root: str, key: list[str], buckets: int) -> None:
    """Version 1 of rows, at least one; keys are unique. buckets: so many that a bucket is about one file; fixed from here on.
    A column named bucket is refused, as its name stands for the place of the rows."""
    if "bucket" in rows.columns:
        raise ValueError("a versioned table has no column named bucket")
    _commit(rows.sparkSession, root, _write(rows, root, key, buckets), 1, buckets)


def committed(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """bucket, folder, version and buckets of every bucket as of a version (the last, if none is named)."""
    commits = spark.read.schema(COMMIT).parquet(f"{root}/commits")
    told = commits.where(F.col("version") <= version) if version is not None else commits
    return told.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder"), F.max("version").alias("version"), F.max("buckets").alias("buckets"))


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows as of a version (the last, if none is named)."""
    return spark.read.parquet(*[f"{root}/data/{r['folder']}/bucket={r['bucket']}" for r in committed(spark, root, version).collect()])


def change_table(new: DataFrame, root: str, key: list[str], replace: bool = True) -> int:
    """The version after new is put in: rows of keys that are there take new's columns (replace) or stay; others are added.

    Only buckets that a row of new falls into are read and written, without replace only those that gain a row. new: keys
    unique, not null, cast to the types of the table; columns that new lacks are null in added rows, a column that the table lacks is refused. Its size sets the cost
    with the buckets it meets; what the driver sees is a row for each bucket. new without rows changes nothing.
    """
    spark = new.sparkSession
    state = committed(spark, root).collect()
    version, buckets = max(r["version"] for r in state), state[0]["buckets"]
    where = {r["bucket"]: f"{root}/data/{r['folder']}/bucket={r['bucket']}" for r in state}
    types = spark.read.parquet(next(iter(where.values()))).schema
    new = new.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in new.columns])
    at = _bucket(key, buckets)

    def old(rows: DataFrame) -> tuple[list[int], DataFrame]:
        met = [r[0] for r in rows.select(at).distinct().collect()]
        there = [where[b] for b in met if b in where]
        return met, spark.read.schema(types).parquet(*there) if there else spark.createDataFrame([], types)

    met, rows = old(new)
    if not replace:
        new = insert_absent(rows, new, key)
        met, rows = old(new)
    if not met:
        return version
    _commit(spark, root, _write(upsert(rows, new, key), root, key, buckets), version + 1, buckets)
    return version + 1
