"""Ranks, places and quantiles on tables large enough that split points are a sample, beside columns that no rank needs."""

import numpy as np
import pytest
from inspectra.operators import aggregates as A
from inspectra.operators import windows as W
from pyspark.sql import functions as F

N = 400_000


@pytest.fixture(scope="module")
def rows(spark):
    score = F.xxhash64("id") / 2.0**63
    df = spark.range(N).select("id", score.alias("score"), F.md5(F.col("id").cast("string")).alias("text"), F.lit("pad").alias("other"))
    return df.withColumn("y", (F.abs(F.xxhash64("id", F.lit(1))) % 100 / 100 < (F.col("score") + 1) / 2).cast("int")).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 5))


@pytest.fixture(scope="module")
def local(rows):
    return rows.select("id", "score", "y", "g").toPandas()


def area(x, y):
    rank = np.argsort(np.argsort(x)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_area_is_that_of_a_sorted_table_again_and_again(rows, local):
    want = area(local.score.to_numpy(), local.y.to_numpy())
    assert [A.auroc(rows, "y", "score").first()["auroc"] for _ in range(2)] == pytest.approx([want] * 2, abs=1e-12)
    groups = {r["g"]: r["auroc"] for r in A.auroc(rows, "y", "score", ["g"]).collect()}
    for g, own in local.groupby("g", dropna=False):
        assert groups[None if np.isnan(g) else g] == pytest.approx(area(own.score.to_numpy(), own.y.to_numpy()), abs=1e-12)


def test_every_place_is_given_once(rows, local):
    order = np.argsort(local.score.to_numpy())
    want = np.empty(N, int)
    want[order] = np.arange(N)
    got = W.numbered(rows, ["score", "id"]).toPandas().sort_values("id")
    assert (got["at"].to_numpy() == want).all() and got.columns.tolist() == [*rows.columns, "at"]
    kept = {r["id"] for r in W.decimate(rows, ["score", "id"], 1000).collect()}
    assert kept == set(local.id.to_numpy()[order][::400].tolist())
    batches = W.cyclic_batches(rows, ["score", "id"], 7, 3).orderBy("batch", "slot").collect()
    assert [r["id"] for r in batches] == local.id.to_numpy()[order][:21].tolist()


def test_mid_ranks_and_quantiles(rows, local):
    ranks = A.mid_ranks(rows, "score", sums={"p": F.col("y"), "first": F.col("id")}).toPandas().sort_values("score")
    assert (ranks["mid_rank"].to_numpy() == np.arange(1, N + 1)).all()
    shares = {"lo": 0.001, "mid": 0.5, "hi": 0.999}
    for r in A.quantiles(rows, "score", shares, ["g"]).collect():
        own = local[local.g.isna() if r["g"] is None else local.g == r["g"]].score
        assert np.allclose([r[c] for c in shares], np.quantile(own, list(shares.values())), rtol=0, atol=1e-15)
    assert A.nearest_rank(rows, "score", 0.95).first()["value"] == round(float(np.sort(local.score)[round((N - 1) * 0.95)]), 3)


def test_hot_values_nulls_and_empty_tables(spark):
    hot = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 7 == 1, None).when(F.col("id") == 2, float("nan")).otherwise(F.col("id") * 1.0).alias("x"))
    places = W.numbered(hot, ["x", "id"]).orderBy("at").collect()
    assert [r["at"] for r in places] == list(range(30_000)) and [r["id"] for r in places] == [r["id"] for r in hot.orderBy("x", "id").collect()]
    whole = hot.where("not isnan(x)")
    values = [r["x"] for r in whole.where("x is not null").collect()]
    assert A.quantiles(whole, "x", {"q": 0.25}).first()["q"] == np.quantile(values, 0.25)
    texts = W.numbered(hot.select(F.md5(F.col("id").cast("string")).alias("t"), "id"), ["t"]).orderBy("at").collect()
    assert [r["t"] for r in texts] == sorted(r["t"] for r in texts)
    none = hot.limit(0).withColumn("y", F.lit(1))
    assert W.numbered(none, ["x"]).count() == 0 and A.quantiles(none, "x", {"q": 0.5}).first()["q"] is None
    assert A.auroc(none, "y", "x").first()["auroc"] is None and A.nearest_rank(none, "x", 0.5).first()["value"] == 0
