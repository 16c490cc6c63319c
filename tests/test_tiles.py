"""Rasters by tiles against the same work on the whole map; sketches against exact ranks."""

import numpy as np
import pytest
from inspectra.operators import images as U
from inspectra.operators import sketches as K
from inspectra.operators import tiles as T
from pyspark.sql import functions as F


def positions(spark, maps):
    rows = [(i, y * m.shape[1] + x, float(m[y, x])) for i, m in enumerate(maps) for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "id long, pos long, score double")


def by_flood(mask):
    """Regions by walking from pixel to pixel."""
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            seen[y, x], stack, own = True, [(y, x)], []
            while stack:
                a, b = stack.pop()
                own.append((a, b))
                for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                    for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
            ys, xs = np.array(own).T
            out.append((xs.min(), ys.min(), xs.max() + 1, ys.max() + 1, len(own), xs.mean(), ys.mean()))
    return sorted(out)


def test_regions_of_maps_that_span_tiles(spark):
    draw = np.random.default_rng(2)
    snake = np.zeros((23, 31))
    snake[::4], snake[1::8, -1], snake[2::8, -1], snake[3::8, -1], snake[5::8, 0], snake[6::8, 0], snake[7::8, 0] = 1, 1, 1, 1, 1, 1, 1
    maps = [(draw.random((23, 31)) < p).astype(float) for p in (0.2, 0.4, 0.55)] + [snake, np.ones((23, 31)), np.zeros((23, 31))]
    got = T.mask_regions(positions(spark, maps), 0.5, 31, 2, tile=5).collect()
    for i, m in enumerate(maps):
        want = [r for r in by_flood(m > 0.5) if r[4] >= 2]
        own = sorted(tuple(r)[1:] for r in got if r["id"] == i)
        assert len(own) == len(want) and all(np.allclose(a, b) for a, b in zip(own, want))
        assert np.allclose(np.array(sorted(U.regions_of(m > 0.5))), np.array(by_flood(m > 0.5)))
    assert sum(r["id"] == 3 for r in got) == 1
    assert T.mask_regions(positions(spark, maps).limit(0), 0.5, 31).count() == 0


@pytest.mark.parametrize("height,width,size,tile", [(23, 31, 3, 5), (20, 18, 9, 10), (4, 7, 5, 6), (65, 9, 9, 64)])
def test_smoothing_over_tiles(spark, height, width, size, tile):
    draw = np.random.default_rng(height)
    maps = [draw.random((height, width)) for _ in range(2)]
    got = {(r["id"], r["pos"]): r["score"] for r in T.smooth_map(positions(spark, maps), width, height, size, tile).collect()}
    assert len(got) == 2 * height * width
    kernel = T.gaussian(size)
    for i, m in enumerate(maps):
        p = np.pad(m, size // 2, mode="reflect")
        p = sum(k * p[j : j + height] for j, k in enumerate(kernel))
        p = sum(k * p[:, j : j + width] for j, k in enumerate(kernel))
        assert np.allclose([got[i, k] for k in range(height * width)], p.ravel())


def test_sparse_maps_are_zero_elsewhere_and_small_tiles_are_refused(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "id long, pos long, score double")
    got = {r["pos"]: r["score"] for r in T.smooth_map(df, 30, 20, 3, tile=6).collect()}
    assert len(got) == 600 and sum(v > 0 for v in got.values()) == 4 and got[599] == 0
    with pytest.raises(ValueError):
        T.smooth_map(df, 30, 20, 9, tile=8)


def test_merged_sketches_hold_their_bound(spark):
    df = spark.range(200_000).select((F.xxhash64("id") / 2.0**63).alias("x"), (F.col("id") % 50).alias("day"), (F.col("id") % 2).alias("model")).union(spark.createDataFrame([(None, 1, 1), (float("nan"), 1, 1)], "x double, day long, model long"))
    kept = K.quantile_sketches(df, "x", ["day", "model"])
    merged = K.merge_sketches(kept, ["model"])
    for r in K.sketch_quantiles(merged, {"lo": 0.01, "mid": 0.5, "hi": 0.99}).collect():
        own = np.sort([v["x"] for v in df.where((F.col("model") == r["model"]) & F.col("x").isNotNull() & ~F.isnan("x")).select("x").collect()])
        assert r["n"] == len(own) == 100_000
        for name, q in (("lo", 0.01), ("mid", 0.5), ("hi", 0.99)):
            assert abs(np.searchsorted(own, r[name], "right") / len(own) - q) <= 2 * K.rank_error()
    near = merged.select(K.sketch_rank(F.col("sketch"), F.lit(0.0)).alias("r")).collect()
    assert all(abs(r["r"] - 0.5) <= 2 * K.rank_error() for r in near)
    assert K.merge_sketches(K.quantile_sketches(df.limit(0), "x", ["day"]), []).first()["n"] is None
