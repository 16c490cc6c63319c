"""Tables of buckets: what a change rewrites, what it leaves, and what a failed one leaves behind."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from inspectra.sources import versions as V


def files(root, bucket):
    return sorted(glob.glob(f"{root}/data/*/bucket={bucket}/*.parquet"))


def now(spark, root, version=None):
    return {r["id"]: (r["a"], r["b"]) for r in V.read_version(spark, root, version).collect()}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "t")
    V.create_table(spark.range(200).select("id", F.lit("x").alias("a"), F.lit(1.5).alias("b")), root, ["id"], 16)
    before = {r["bucket"]: r["folder"] for r in V.committed(spark, root).collect()}
    assert len(before) == 16 and len(now(spark, root)) == 200
    new = spark.createDataFrame([(7, "y"), (1000, "z")], "id int, a string")  # int keys land where long ones do
    assert V.change_table(new, root, ["id"]) == 2
    want = {i: ("y" if i == 7 else "x", 1.5) for i in range(200)} | {1000: ("z", None)}
    assert now(spark, root) == want and now(spark, root, 1) == {i: ("x", 1.5) for i in range(200)}
    after = {r["bucket"]: r["folder"] for r in V.committed(spark, root).collect()}
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 2 and all(len({os.path.dirname(f) for f in files(root, b)}) == 1 + (b in changed) for b in after)
    assert V.change_table(new.limit(0), root, ["id"]) == 2


def test_absent_rows_only(spark, tmp_path):
    root = str(tmp_path / "t")
    V.create_table(spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0)], "id long, a string, b double"), root, ["id"], 8)
    assert V.change_table(spark.createDataFrame([(1, "y", 9.0)], "id long, a string, b double"), root, ["id"], replace=False) == 1
    assert V.change_table(spark.createDataFrame([(1, "y", 9.0), (3, "y", 9.0)], "id long, a string, b double"), root, ["id"], replace=False) == 2
    assert now(spark, root) == {1: ("x", 1.0), 2: ("x", 2.0), 3: ("y", 9.0)}


def test_a_failed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    V.create_table(spark.createDataFrame([(1, "x", 1.0)], "id long, a string, b double"), root, ["id"], 4)
    new = spark.createDataFrame([(1, "y", 2.0)], "id long, a string, b double")
    commit = V._commit
    monkeypatch.setattr(V, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        V.change_table(new, root, ["id"])
    assert now(spark, root) == {1: ("x", 1.0)}
    monkeypatch.setattr(V, "_commit", commit)
    assert V.change_table(new, root, ["id"]) == 2 and now(spark, root) == {1: ("y", 2.0)}


def test_unknown_columns_are_refused(spark, tmp_path):
    V.create_table(spark.createDataFrame([(1, 2)], "id long, a long"), str(tmp_path / "u"), ["id"], 4)
    with pytest.raises(KeyError):
        V.change_table(spark.createDataFrame([(1, 2)], "id long, c long"), str(tmp_path / "u"), ["id"])
    with pytest.raises(ValueError):
        V.create_table(spark.createDataFrame([(1, 2)], "id long, bucket long"), str(tmp_path / "t"), ["id"], 4)
