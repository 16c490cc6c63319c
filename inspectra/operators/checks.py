"""Checks of rows, images, label lines, annotations and uploads, and searches over records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_parts

IMAGE_SUFFIXES = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")


def split_by_extension(df: DataFrame, path: str, allowed: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """df with suffix and issue: UNSUPPORTED_IMAGE_FORMAT, or null where the suffix is allowed."""
    suffix = path_parts(F.col(path))["suffix"]
    return df.withColumn("suffix", suffix).withColumn("issue", F.when(~F.col("suffix").isin(*allowed), "UNSUPPORTED_IMAGE_FORMAT"))


@dataclass(frozen=True)
class ImageLimits:
    blur: float
    bright: float
    dark: float
    width: int = 0
    height: int = 0


#: The gate of a single inspection, and the limits of a dataset scan.
GATE, SCAN = ImageLimits(30.0, 0.85, 0.85, 64, 64), ImageLimits(80.0, 0.80, 0.80)


def _present(*cases: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(when, F.lit(name)) for when, name in cases]), lambda x: x.isNotNull())


def quality_gate(df: DataFrame, width: str, height: str, blur: str, bright: str, dark: str, limits: ImageLimits = GATE) -> DataFrame:
    """df with issues and valid; limits are compared unrounded, blur strictly, ratios inclusively."""
    small = (F.col(width) < limits.width) | (F.col(height) < limits.height)
    issues = _present(
        (small, "RESOLUTION_TOO_SMALL"), (F.col(blur) < limits.blur, "BLURRY_IMAGE"), (F.col(bright) >= limits.bright, "OVEREXPOSED_IMAGE"), (F.col(dark) >= limits.dark, "UNDEREXPOSED_IMAGE"),
    )
    return df.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def exposure_issues(df: DataFrame, path: str, blur: str, bright: str, dark: str, limits: ImageLimits = SCAN) -> DataFrame:
    """A row (path, code, value) for every blur or exposure issue of a scan; values rounded to 4 places."""
    found = [
        F.when(F.col(blur) < limits.blur, F.struct(F.lit("BLURRY_IMAGE").alias("code"), F.round(blur, 4).alias("value"))),
        F.when(F.col(bright) >= limits.bright, F.struct(F.lit("OVEREXPOSED_IMAGE").alias("code"), F.round(bright, 4).alias("value"))),
        F.when(F.col(dark) >= limits.dark, F.struct(F.lit("UNDEREXPOSED_IMAGE").alias("code"), F.round(dark, 4).alias("value"))),
    ]
    rows = df.select(F.col(path).alias("path"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i"))
    return rows.select("path", "i.code", "i.value")


def scan_label_lines(df: DataFrame, text: str) -> DataFrame:
    """df with a row per non-blank line of a label text: line (1-based among non-blank lines) and value, trimmed."""
    lines = F.filter(F.transform(F.split(F.col(text), "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select("*", F.posexplode(lines).alias("_at", "value")).withColumn("line", F.col("_at") + 1).drop("_at")


def _with_fields(lines: DataFrame, text: str) -> tuple[DataFrame, str]:
    """lines with a column of the parsed label line (n, class_id, cx, cy, w, h), and its name; each line is cut up once."""
    cut, fields = (next(n for k in range(99) if (n := f"_{x}{k}") not in lines.columns) for x in ("cut", "fields"))
    parts = F.col(cut)
    whole = F.when(F.get(parts, 0).rlike(r"^[+-]?\d+$"), F.get(parts, 0).try_cast("long"))
    number = lambda i: F.coalesce(F.get(parts, i).try_cast("double"), F.when(F.lower(F.get(parts, i)).isin("+nan", "-nan"), F.lit(float("nan"))))
    parsed = F.struct(F.size(parts).alias("n"), whole.alias("class_id"), *[number(i + 1).alias(k) for i, k in enumerate(("cx", "cy", "w", "h"))])
    ready = lines.withColumn(cut, F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), r"\s+")).withColumn(fields, parsed)
    return ready.drop(cut), fields


def _label_tests(f: Column, n_classes: int) -> tuple[Column, Column, Column]:
    """(malformed, class out of range, box out of bounds); comparisons with NaN are false."""
    numbers = [f[k] for k in ("cx", "cy", "w", "h")]
    malformed = (f["n"] != 5) | f["class_id"].isNull() | reduce(lambda a, b: a | b, [x.isNull() for x in numbers])
    below = lambda a, b: ~F.isnan(a) & (a < b)
    cx, cy, w, h = numbers
    out = ((w <= 0) & ~F.isnan(w)) | ((h <= 0) & ~F.isnan(h)) | below(cx - w / 2, F.lit(0.0)) | below(cy - h / 2, F.lit(0.0))
    out = out | (~F.isnan(cx + w / 2) & (cx + w / 2 > 1)) | (~F.isnan(cy + h / 2) & (cy + h / 2 > 1))
    return malformed, ~f["class_id"].between(0, n_classes - 1), out


def label_issues(lines: DataFrame, text: str, width: str, height: str, n_classes: int, tiny: tuple[float, float, float] = (4.0, 4.0, 16.0)) -> DataFrame:
    """lines with issues (a line may have several) and counted, true where its class counts in the distribution.

    tiny: least width, height and area in pixels. A class out of range does not stop a line, a box out of bounds does.
    """
    parsed, name = _with_fields(lines, text)
    f = F.col(name)
    bad, klass, out = _label_tests(f, n_classes)
    wide, high = f["w"] * F.col(width), f["h"] * F.col(height)
    small = (wide < tiny[0]) | (high < tiny[1]) | (wide * high < tiny[2])
    issues = F.when(bad, F.array(F.lit("MALFORMED_ANNOTATION"))).otherwise(_present((klass, "INVALID_CLASS"), (out, "OUT_OF_BOUNDS_BOX"), (~out & small, "TINY_BOX")))
    return parsed.withColumns({"class_id": f["class_id"], "issues": issues, "counted": ~bad & ~klass}).drop(name)


def validate_labels(lines: DataFrame, text: str, n_classes: int) -> DataFrame:
    """lines with error: the first of MALFORMED_LABEL, INVALID_CLASS and OUT_OF_BOUNDS_BOX, null for a valid line."""
    parsed, name = _with_fields(lines, text)
    f = F.col(name)
    bad, klass, out = _label_tests(f, n_classes)
    return parsed.withColumns({"class_id": f["class_id"], "error": F.when(bad, "MALFORMED_LABEL").when(klass, "INVALID_CLASS").when(out, "OUT_OF_BOUNDS_BOX")}).drop(name)


def voc_issues(objects: DataFrame, known: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """objects with error: the first problem of a box annotation, null for a good one.

    objects: filename, width, height, name, xmin, ymin, xmax, ymax, one row per object (all null where the XML could not
    be read, name null where there is no object). known: filename of existing images.
    """
    met = objects.join(known.select("filename", F.lit(True).alias("_known")).distinct(), "filename", "left")
    c = F.col
    reversed_ = (c("xmax") <= c("xmin")) | (c("ymax") <= c("ymin"))
    outside = (c("xmin") < 0) | (c("ymin") < 0) | (c("xmax") > c("width")) | (c("ymax") > c("height"))
    numbers = reduce(lambda a, b: a | b, [c(x).isNull() for x in ("xmin", "ymin", "xmax", "ymax")])
    error = (
        F.when(c("filename").isNull(), "INVALID_XML").when(c("_known").isNull(), "IMAGE_NOT_FOUND").when(c("width").isNull() | c("height").isNull() | (c("width") <= 0) | (c("height") <= 0), "INVALID_IMAGE_SIZE")
        .when(c("name").isNull(), "NO_VALID_BOXES").when(~c("name").isin(*classes), "UNKNOWN_CLASS").when(numbers | reversed_, "INVALID_BOX").when(outside, "OUT_OF_BOUNDS_BOX")
    )
    return met.withColumn("error", error).drop("_known")


def decode_upload(df: DataFrame, filename: str, content: str, max_bytes: int = 10 * 1024 * 1024, allowed: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """df with data (decoded base64) and error: INVALID_IMAGE for a wrong suffix, bad base64, no or too many bytes."""
    data = F.try_to_binary(F.col(content), F.lit("base64"))
    bad = ~path_parts(F.col(filename))["suffix"].isin(*allowed) | data.isNull() | (F.octet_length(data) == 0) | (F.octet_length(data) > max_bytes)
    return df.withColumn("error", F.when(bad, "INVALID_IMAGE")).withColumn("data", F.when(~bad, data))


def search(df: DataFrame, status: str | None, keyword: str | None, cols: list[str], reasons: str | None, status_col: str = "status") -> DataFrame:
    """Rows of a status whose columns, put together, hold the keyword in any case."""
    shown = [F.col(c).cast("string") for c in cols] + ([F.array_join(F.col(reasons), " ")] if reasons else [])
    out = df if status is None else df.where(F.col(status_col) == status)
    return out if not keyword else out.where(F.lower(F.concat_ws(" ", *shown)).contains(keyword.lower()))


def search_reviews(df: DataFrame, status: str | None, reason: str | None, status_col: str = "status", reasons: str = "review_reasons") -> DataFrame:
    return search(df, status, reason, [], reasons, status_col)


def admit_batch(df: DataFrame, path: str, size: str, mtime: str, order: list[str], max_bytes: int = 10 * 1024 * 1024, cap: int = 50, batch: str | None = None) -> DataFrame:
    """df with outcome: ignored (hidden path or no image), duplicated, limited (beyond the cap) or accepted, and oversize.

    The cap is the feature: a batch holds so many files at most. batch: column of independent batches.
    """
    group = [F.col(batch)] if batch else [F.lit(0)]
    hidden = F.exists(F.split(F.col(path), "/"), lambda x: x.startswith("."))
    image = ~hidden & path_parts(F.col(path))["suffix"].isin(*IMAGE_SUFFIXES)
    key = [F.col(path), F.col(size), F.col(mtime)]
    nth = F.row_number().over(Window.partitionBy(*group, image, *key).orderBy(*order))
    marked = df.withColumn("_image", image).withColumn("_nth", nth).withColumn("_new", (F.col("_image") & (F.col("_nth") == 1)).cast("int"))
    place = F.sum("_new").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(~F.col("_image"), "ignored").when(F.col("_nth") > 1, "duplicated").when(place > cap, "limited").otherwise("accepted")
    return marked.withColumn("outcome", outcome).withColumn("oversize", F.col(size) > max_bytes).drop("_image", "_nth", "_new")


def check_constraints(df: DataFrame, rules: list[tuple[str, str, object]]) -> DataFrame:
    """df with violations. rules: (column, kind, bound), kind in min, max, max_length, one_of, at_most (another column)."""
    broken = {
        "min": lambda c, b: c < b, "max": lambda c, b: c > b, "max_length": lambda c, b: F.length(c) > b,
        "one_of": lambda c, b: ~c.isin(*b), "at_most": lambda c, b: c > F.col(b),
    }
    return df.withColumn("violations", _present(*[(broken[kind](F.col(c), bound), f"{c}:{kind}") for c, kind, bound in rules]))


def project(df: DataFrame, view: dict[str, str]) -> DataFrame:
    """The fields of a list view: shown name to expression."""
    return df.select(*[F.expr(e).alias(n) for n, e in view.items()])


def of_type(models: DataFrame, kind: str, column: str = "model_type") -> DataFrame:
    return models.where(F.col(column) == kind)
