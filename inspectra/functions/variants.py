"""Reading free-form JSON held as VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tolerant_number(value: Column, *paths: str) -> Column:
    """The first of the paths that holds a number or a numeric string; booleans and other text do not count."""

    def one(path: str) -> Column:
        held = F.try_variant_get(value, path, "variant")
        plain = ~F.coalesce(F.schema_of_variant(held), F.lit("VOID")).isin("BOOLEAN", "VOID")
        return F.when(plain, F.try_variant_get(value, path, "double"))

    return F.coalesce(*[one(p) for p in paths])


def text_at(value: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(value, p, "string") for p in paths])


def _edges(value: Column, at: str) -> Column:
    """x1, y1, x2, y2 of a JSON object: by corner names, else by origin and size."""
    n = lambda *names: tolerant_number(value, *[f"{at}.{x}" for x in names])
    a, b, c, d = n("x1", "left", "xmin"), n("y1", "top", "ymin"), n("x2", "right", "xmax"), n("y2", "bottom", "ymax")
    x, y, w, h = n("x"), n("y"), n("width", "w"), n("height", "h")
    whole = lambda *cs: reduce(lambda p, q: p & q, [k.isNotNull() for k in cs])
    fields = lambda *cs: F.struct(*[k.alias(f) for f, k in zip(("x1", "y1", "x2", "y2"), cs)])
    return F.when(whole(a, b, c, d), fields(a, b, c, d)).when(whole(x, y, w, h), fields(x, y, x + w, y + h))


def _listed(value: Column, at: str, sized: bool = False) -> Column:
    a, b, c, d = (tolerant_number(value, f"{at}[{i}]") for i in range(4))
    whole = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    c, d = (a + c, b + d) if sized else (c, d)
    return F.when(whole, F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def normalize_box(value: Column) -> Column:
    """A box from any known spelling, in fixed precedence, as x1, y1, x2, y2; null if there is none."""
    objects = [_edges(value, "$.bounding_box"), _edges(value, "$"), *[_edges(value, f"$.{k}") for k in ("bbox", "box", "bndbox", "coordinates")]]
    lists = [_listed(value, f"$.{k}", k == "xywh") for k in ("xyxy", "bounding_box", "bbox", "box", "xywh", "coordinates")]
    return F.coalesce(*objects, *lists)


def region_area(value: Column) -> Column:
    b = normalize_box(value)
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return F.coalesce(tolerant_number(value, "$.area"), F.when((w > 0) & (h > 0), w * h))


def region_ratio(value: Column) -> Column:
    b = normalize_box(value)
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return F.coalesce(tolerant_number(value, "$.aspect_ratio"), F.when((w > 0) & (h > 0), w / h))


def model_row(meta: Column) -> dict[str, Column]:
    """Registry fields from training metadata: a square input size (640 by default) and the precision."""
    size = F.coalesce(tolerant_number(meta, "$.image_size", "$.imgsz"), F.lit(640.0)).cast("int")
    mixed = F.try_variant_get(meta, "$.amp", "boolean")
    return {"input_size": F.array(size, size), "precision": F.when(F.coalesce(mixed, F.lit(False)), "fp16").otherwise("fp32")}


def first_defined(value: Column, key: str, sections: tuple[str, ...]) -> Column:
    """The value of key in the first section that has it; a JSON null counts as having it."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{s}.{key}" if s else f"$.{key}", "variant") for s in sections])


def range_text(low: Column, mid: Column, high: Column) -> Column:
    shown = lambda c: F.when(c.isNotNull(), F.format_string("%.1f", c)).otherwise("-")
    return F.concat_ws(" / ", shown(low), shown(mid), shown(high))
