"""Box geometry. A pixel box is a struct x1, y1, x2, y2; a centre box is cx, cy, w, h, normalised to the image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(EDGES, (x1, y1, x2, y2))])


def voc_to_center(b: Column, width: Column, height: Column) -> Column:
    mid = lambda a, z, n: (b[a] + b[z]) / 2 / n
    return F.struct(mid("x1", "x2", width).alias("cx"), mid("y1", "y2", height).alias("cy"), ((b["x2"] - b["x1"]) / width).alias("w"), ((b["y2"] - b["y1"]) / height).alias("h"))


def center_to_pixels(c: Column, width: Column, height: Column) -> Column:
    return box((c["cx"] - c["w"] / 2) * width, (c["cy"] - c["h"] / 2) * height, (c["cx"] + c["w"] / 2) * width, (c["cy"] + c["h"] / 2) * height)


def export_box(b: Column, image_width: Column, image_height: Column) -> Column:
    """Centre box for export: image no smaller than the box, sides of one pixel at least."""
    wide, high = F.greatest(F.coalesce(image_width.cast("double"), F.lit(1.0)), b["x2"], F.lit(1.0)), F.greatest(F.coalesce(image_height.cast("double"), F.lit(1.0)), b["y2"], F.lit(1.0))
    w, h = F.greatest(b["x2"] - b["x1"], F.lit(1.0)), F.greatest(b["y2"] - b["y1"], F.lit(1.0))
    return F.struct(((b["x1"] + w / 2) / wide).alias("cx"), ((b["y1"] + h / 2) / high).alias("cy"), (w / wide).alias("w"), (h / high).alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda x: F.greatest(x["x2"] - x["x1"], F.lit(0.0)) * F.greatest(x["y2"] - x["y1"], F.lit(0.0))
    shared = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def letterbox(width: Column, height: Column, target_w: int, target_h: int) -> Column:
    """ratio and padding that fit an image into a target size; half-even rounding."""
    ratio = F.least(target_w / width, target_h / height)
    new_w, new_h = F.bround(width * ratio), F.bround(height * ratio)
    return F.struct(ratio.alias("ratio"), ((target_w - new_w) / 2).alias("pad_x"), ((target_h - new_h) / 2).alias("pad_y"))


def unletterbox(b: Column, fit: Column, width: Column, height: Column) -> Column:
    """A box of the target back in the image, clipped and rounded half-even."""
    back = lambda c, pad, n: F.bround(F.least(F.greatest((c - pad) / fit["ratio"], F.lit(0.0)), n.cast("double"))).cast("int")
    return F.struct(back(b["x1"], fit["pad_x"], width).alias("x1"), back(b["y1"], fit["pad_y"], height).alias("y1"), back(b["x2"], fit["pad_x"], width).alias("x2"), back(b["y2"], fit["pad_y"], height).alias("y2"))


def decode_detection(row: Column, layout: str = "xyxy", least: float = 0.25) -> Column:
    """box, confidence and class of a raw detection row, null below `least`.

    `xyxy`: x1, y1, x2, y2, confidence, class. `xywh`: centre, size, then a score per class; the best class wins, the
    first on ties.
    """
    if layout == "xyxy":
        found = F.struct(box(row[0], row[1], row[2], row[3]).alias("box"), row[4].cast("double").alias("confidence"), row[5].cast("int").alias("class_id"))
    else:
        scores = F.slice(row, 5, F.greatest(F.size(row) - 4, F.lit(0)))
        best = F.array_max(F.transform(scores, lambda s, i: F.struct(s.alias("s"), (-i).alias("i"))))
        corners = box(row[0] - row[2] / 2, row[1] - row[3] / 2, row[0] + row[2] / 2, row[1] + row[3] / 2)
        found = F.struct(corners.alias("box"), best["s"].cast("double").alias("confidence"), (-best["i"]).cast("int").alias("class_id"))
    return F.when(found["confidence"] >= least, found)


def region_geometry(b: Column) -> Column:
    """area, aspect ratio (0 without height) and centroid."""
    w, h = F.greatest(b["x2"] - b["x1"], F.lit(0.0)), F.greatest(b["y2"] - b["y1"], F.lit(0.0))
    return F.struct((w * h).alias("area"), F.when(h > 0, w / h).otherwise(0.0).alias("aspect_ratio"), ((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter)).otherwise(0.0)


def shape_ok(area: Column, aspect: Column, circular: Column, ranges: dict[str, tuple[float, float]]) -> Column:
    return area.between(*ranges["area"]) & aspect.between(*ranges["aspect"]) & circular.between(*ranges["circularity"])


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Boxes whose largest coordinate is at most 1 are scaled by the image size."""
    scaled = box(b["x1"] * width, b["y1"] * height, b["x2"] * width, b["y2"] * height)
    return F.when(F.greatest(*[b[e] for e in EDGES]) <= 1, scaled).otherwise(b)
