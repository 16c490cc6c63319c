"""Batch jobs over image pixels and detector scores, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import otsu_threshold  # noqa: F401  the threshold of extract_regions, offered per group of rows as well
from .tiles import labelled, mask_regions, smooth_map, tile_parts  # noqa: F401  the work on positions is by tiles


def predict_batch(df: DataFrame, scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """df through a detector: scorer() is called once per task and gives a function from a batch to its output columns.

    If a batch fails its rows are tried one by one; a row that fails has null outputs and its error in `error`.
    schema: DDL of the outputs.
    """
    fields = [f.split()[0] for f in schema.split(",")]
    whole = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, {schema}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for part in batches:
            part = part.reset_index(drop=True)
            try:
                yield pd.concat([part, score(part)[fields].reset_index(drop=True)], axis=1).assign(error=None)
            except Exception:
                for i in range(len(part)):
                    row = part.iloc[[i]].reset_index(drop=True)
                    try:
                        yield pd.concat([row, score(row)[fields].reset_index(drop=True)], axis=1).assign(error=None)
                    except Exception as why:  # one row's failure is data
                        yield row.assign(**dict.fromkeys(fields)).assign(error=str(why))

    return df.mapInPandas(run, whole)


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows, columns, and blue, green, red of an image row's bytes."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return raw[:, :, :3] if channels >= 3 else np.repeat(raw[:, :, :1], 3, axis=2)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Fixed-point luminance, 0.114 B + 0.587 G + 0.299 R."""
    b, g, r = (bgr[:, :, i].astype(np.int64) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def laplacian_variance(image: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, borders reflected without the edge."""
    p = np.pad(image.astype(np.float64), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(np.float64), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average of a one-channel image."""

    def weights(n: int, m: int) -> np.ndarray:
        lo, hi = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
        w = np.clip(np.minimum(hi, np.arange(n) + 1) - np.maximum(lo, np.arange(n)), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return weights(image.shape[0], height) @ image.astype(np.float64) @ weights(image.shape[1], width).T


def dhash(image: np.ndarray) -> int:
    """64 bits, row by row, most significant first: right neighbour brighter on a 9 by 8 average; as a signed number."""
    small = np.rint(resized(image, 8, 9))
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    value = int("".join("1" if x else "0" for x in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def _each(df: DataFrame, make: Callable[[np.ndarray], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    """make over the decoded images of df (origin, height, width, nChannels, data): rows of origin and what it gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for x in part.itertuples(index=False):
                if x.width > 0 and x.height > 0:
                    yield pd.DataFrame([(x.origin, *r) for r in make(pixels(x.data, x.height, x.width, x.nChannels))], columns=["origin", *names])

    return df.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, f"origin string, {schema}")


def image_features(df: DataFrame, bright: int = 245, dark: int = 10) -> DataFrame:
    """origin, blur (Laplacian variance), bright_ratio (pixels >= bright), dark_ratio (pixels <= dark) and dhash."""

    def make(bgr: np.ndarray) -> list[tuple]:
        g = gray(bgr)
        return [(laplacian_variance(g), float((g >= bright).mean()), float((g <= dark).mean()), dhash(g))]

    return _each(df, make, "blur double, bright_ratio double, dark_ratio double, dhash long", ["blur", "bright_ratio", "dark_ratio", "dhash"])


def lab(bgr: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) scaled to bytes: L to 0..255, a and b shifted by 128."""
    c = bgr[:, :, ::-1] / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    y = xyz[:, :, 1]
    light = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    return np.stack([light * 255 / 100, 500 * (f[:, :, 0] - f[:, :, 1]) + 128, 200 * (f[:, :, 1] - f[:, :, 2]) + 128], axis=2)


def sobel(image: np.ndarray) -> np.ndarray:
    """Gradient magnitude, 3 by 3 Sobel, borders reflected without the edge."""
    p = np.pad(image.astype(np.float64), 1, mode="reflect")
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return np.hypot(dx, dy)


def pixel_features(df: DataFrame, size: int = 256) -> DataFrame:
    """origin, pos (row-major), channel (0-2 L, a, b; 3 gradient) and value of images resized to a square."""

    def make(bgr: np.ndarray) -> list[tuple]:
        small = np.stack([resized(bgr[:, :, i], size, size) for i in range(3)], axis=2)
        channels = np.dstack([lab(small), sobel(gray(np.rint(small).astype(np.uint8)))]).reshape(-1, 4)
        return [(i // 4, i % 4, float(v)) for i, v in enumerate(channels.ravel())]

    return _each(df, make, "pos int, channel int, value double", ["pos", "channel", "value"])


def otsu(image: np.ndarray) -> int:
    """Level t of a byte image with the largest between-class variance of <= t and > t."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.nan_to_num(n0 * (n0[-1] - n0) * (s0 / n0 - (s0[-1] - s0) / (n0[-1] - n0)) ** 2)
    return int(np.argmax(v))


def regions_of(mask: np.ndarray) -> list[tuple]:
    """(x1, y1, x2, y2, area, cx, cy) of the components; x2 and y2 are one past the last pixel."""
    parts = tile_parts(mask, 0, 0, mask.shape[1])
    parts = parts[parts["kind"] == "part"]
    return [(x.x1, x.y1, x.x2, x.y2, x.area, x.sx / x.area, x.sy / x.area) for x in parts.itertuples()]


REGION = "x1 int, y1 int, x2 int, y2 int, area int, cx double, cy double"
REGION_NAMES = [f.split()[0] for f in REGION.split(", ")]


def extract_regions(df: DataFrame, least_area: int = 1, dark: bool = True) -> DataFrame:
    """Regions of each image darker (or brighter) than its Otsu threshold."""

    def make(bgr: np.ndarray) -> list[tuple]:
        g = gray(bgr)
        t = otsu(g)
        return [r for r in regions_of(g <= t if dark else g > t) if r[4] >= least_area]

    return _each(df, make, REGION, REGION_NAMES)


def thumbnail_plan(issues: DataFrame, path: str, order: list[str], width: str, height: str) -> DataFrame:
    """For the first issue of each path: a short name and the size of a thumbnail of 240 by 180 at most."""
    first = issues.groupBy(path).agg(F.min(F.struct(*order, width, height)).alias("_f")).select(path, f"_f.{width}", f"_f.{height}")
    scale = F.least(240 / F.col(width), 180 / F.col(height), F.lit(1.0))
    side = lambda c: F.greatest(F.floor(F.col(c) * scale), F.lit(1)).cast("int")
    return first.select(path, F.concat(F.substring(F.sha1(F.col(path).cast("binary")), 1, 12), F.lit(".jpg")).alias("name"), side(width).alias("thumb_width"), side(height).alias("thumb_height"))
