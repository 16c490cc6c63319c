"""Rasters of any size, cut into square tiles: connected regions and smoothing without an image in one task.

A raster is a table of positions (id, pos, score) with its width, pos counted row by row. Every tile is labelled or smoothed
alone; what crosses a border is a join of border pixels, or a copy of the pixels within the kernel's radius.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

TILE = 256
FOUND = "label long, kind string, x1 int, y1 int, x2 int, y2 int, area long, sx long, sy long"


def labelled(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a boolean mask, numbered from 1 in reading order; 0 outside."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(np.where(mask, label, mask.size + 1), 1, constant_values=mask.size + 1)
        h, w = mask.shape
        least = np.min([p[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, least, 0)
        new = np.where(mask, np.minimum(new, np.concatenate([[0], label.ravel()])[new]), 0)
        if (new == label).all():
            found = np.unique(label[mask])
            return np.where(mask, np.searchsorted(found, label) + 1, 0)
        label = new


def tile_parts(mask: np.ndarray, y0: int, x0: int, width: int) -> pd.DataFrame:
    """Regions of one tile, named by their first position in the raster (kind part: bounds and sums), and its border pixels
    with the name of their region (kind edge, at x1, y1)."""
    label = labelled(mask)
    ys, xs = np.nonzero(label)
    k = label[ys, xs]
    ys, xs = ys + y0, xs + x0
    n = int(k.max(initial=0)) + 1
    ends = {c: np.full(n, start) for c, start in (("x1", 1 << 30), ("y1", 1 << 30), ("x2", 0), ("y2", 0))}
    np.minimum.at(ends["x1"], k, xs)
    np.minimum.at(ends["y1"], k, ys)
    np.maximum.at(ends["x2"], k, xs + 1)
    np.maximum.at(ends["y2"], k, ys + 1)
    name = np.full(n, 1 << 62)
    np.minimum.at(name, k, ys.astype("int64") * width + xs)
    whole = lambda w: np.bincount(k, w, n).astype("int64")
    parts = pd.DataFrame({"label": name, "kind": "part", **ends, "area": np.bincount(k, minlength=n), "sx": whole(xs), "sy": whole(ys)}).iloc[1:]
    h, w = mask.shape
    rim = (ys == y0) | (ys == y0 + h - 1) | (xs == x0) | (xs == x0 + w - 1)
    edges = pd.DataFrame({"label": name[k[rim]], "kind": "edge", "x1": xs[rim], "y1": ys[rim], "x2": 0, "y2": 0, "area": 0, "sx": 0, "sy": 0})
    return pd.concat([parts, edges])


def roots(pairs: DataFrame) -> DataFrame:
    """id, label and root (the smallest label reachable within the id) of the labels in pairs (id, v, m).

    Every label hands its larger neighbours, then its smaller ones, to its smallest neighbour, until all point at a root.
    """
    larger, smaller = F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m")
    now = written(pairs.select("id", larger, smaller).where("v > m").distinct(), "labels")
    while True:
        both = now.select("id", F.col("v").alias("x"), F.col("m").alias("y")).union(now.select("id", "m", "v"))
        least = both.groupBy("id", "x").agg(F.least(F.min("y"), F.first("x")).alias("t"))
        large = both.where("y > x").join(least, ["id", "x"]).select("id", F.col("y").alias("v"), F.col("t").alias("m")).distinct()
        smallest = large.groupBy("id", "v").agg(F.min("m").alias("t"))
        handed = large.join(smallest, ["id", "v"]).where("m > t").select("id", F.col("m").alias("v"), F.col("t").alias("m"))
        now = written(handed.union(smallest.select("id", "v", "t")).distinct(), "labels")
        many = now.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not many and not now.join(now.select("id", F.col("m").alias("v")), ["id", "v"], "left_semi").limit(1).count():
            return now.select("id", F.col("v").alias("label"), F.col("m").alias("root"))


def joined_regions(found: DataFrame, least_area: int, tile: int) -> DataFrame:
    """Regions of the rasters from the parts and edges of their tiles: id, x1, y1, x2, y2 (one past), area, cx, cy.

    Only border pixels meet: each looks at its neighbours in other tiles, and labels that touch are merged.
    """
    edges = found.where("kind = 'edge'").select("id", F.col("x1").alias("x"), F.col("y1").alias("y"), "label")
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))])  # the other four see these
    sent = edges.withColumn("d", F.explode(near)).select("id", (F.col("x") + F.col("d.dx")).alias("tx"), (F.col("y") + F.col("d.dy")).alias("ty"), F.col("label").alias("v"), "x", "y")
    place = lambda c: F.floor(F.col(c) / tile)
    sent = sent.where((place("tx") != place("x")) | (place("ty") != place("y"))).drop("x", "y")
    met = sent.join(edges.select("id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("label").alias("m")), ["id", "tx", "ty"])
    named = found.where("kind = 'part'").join(roots(met.select("id", "v", "m")), ["id", "label"], "left")
    whole = named.groupBy("id", F.coalesce("root", "label").alias("first")).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("area").alias("area"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")
    )
    return whole.where(F.col("area") >= least_area).select("id", "x1", "y1", "x2", "y2", "area", (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"))


def mask_regions(long_df: DataFrame, threshold: float, width: int, least_area: int = 16, tile: int = TILE) -> DataFrame:
    """Regions of the positions of each raster whose score is above the threshold. long_df: id, pos, score."""
    at = long_df.where(F.col("score") > threshold).select("id", F.floor(F.col("pos") / width).alias("y"), (F.col("pos") % width).alias("x"))
    dealt = at.select("id", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"), "y", "x")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(part["ty"].iloc[0]) * tile, int(part["tx"].iloc[0]) * tile
        mask = np.zeros((tile, tile), bool)
        mask[part["y"] - y0, part["x"] - x0] = True
        return tile_parts(mask, y0, x0, width).assign(id=part["id"].iloc[0])

    kind = long_df.schema["id"].dataType.simpleString()
    found = dealt.groupBy("id", "ty", "tx").applyInPandas(run, f"id {kind}, {FOUND}")
    return joined_regions(written(found, "tiles"), least_area, tile)


def gaussian(size: int) -> np.ndarray:
    """Weights of a Gaussian kernel of a given (odd) size, with the customary sigma for it."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return kernel / kernel.sum()


def reflected(i: np.ndarray, n: int) -> np.ndarray:
    """Places within 0 .. n - 1 of places beyond, reflected at the borders without repeating them."""
    i = np.abs(i) % max(2 * (n - 1), 1)
    return np.where(i < n, i, 2 * (n - 1) - i)


def smooth_map(long_df: DataFrame, width: int, height: int, size: int = 9, tile: int = TILE) -> DataFrame:
    """id, pos and score smoothed by a Gaussian of a given size, borders reflected without the edge; positions that are not
    there count 0. A pixel goes to its tile and to those within the kernel's radius."""
    kernel, r = gaussian(size), size // 2
    if tile <= 2 * r:
        raise ValueError("tiles must be wider than the kernel")

    def tiles(c: str, n: int) -> Column:
        lo, hi = F.floor((F.col(c) - r) / tile), F.floor((F.col(c) + r) / tile)
        return F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit((n - 1) // tile)).cast("int")))

    at = long_df.select("id", F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), "score")
    dealt = at.withColumn("ty", tiles("y", height)).withColumn("tx", tiles("x", width))
    every = [F.explode(F.sequence(F.lit(0), F.lit((n - 1) // tile))).alias(c) for c, n in (("ty", height), ("tx", width))]
    grid = long_df.select("id").distinct().select("id", every[0]).select("id", "ty", every[1])  # tiles that no pixel reaches count 0
    none = [F.lit(None).cast(dealt.schema[c].dataType).alias(c) for c in ("y", "x", "score")]
    dealt = dealt.unionByName(grid.select("id", "ty", "tx", *none))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(part["ty"].iloc[0]) * tile, int(part["tx"].iloc[0]) * tile
        h, w = min(tile, height - y0), min(tile, width - x0)
        held, there = np.zeros((h + 2 * r, w + 2 * r)), part.dropna(subset=["y"])
        held[there["y"].astype(int) - y0 + r, there["x"].astype(int) - x0 + r] = there["score"]
        p = held[reflected(np.arange(y0 - r, y0 + h + r), height) - y0 + r][:, reflected(np.arange(x0 - r, x0 + w + r), width) - x0 + r]
        p = sum(k * p[i : i + h] for i, k in enumerate(kernel))
        p = sum(k * p[:, i : i + w] for i, k in enumerate(kernel))
        pos = (np.arange(y0, y0 + h, dtype="int64")[:, None] * width + np.arange(x0, x0 + w)).ravel()
        return pd.DataFrame({"id": part["id"].iloc[0], "pos": pos, "score": p.ravel()})

    kind = long_df.schema["id"].dataType.simpleString()
    return dealt.groupBy("id", "ty", "tx").applyInPandas(run, f"id {kind}, pos long, score double")
