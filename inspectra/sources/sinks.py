"""Writers of reports, labels, manifests and audit logs. Each returns what it wrote, so tests and queries can look at it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_report(images: DataFrame, issues: DataFrame, order: list[str], keep: int = 200, w: str = "width", h: str = "height") -> DataFrame:
    """One nested row: schema_version, summary, image_size_statistics and the first issues in emission order."""
    total = images.agg(F.struct(F.count(F.lit(1)).alias("total_images")).alias("s"), F.struct(F.min(w).alias("width_min"), F.max(w).alias("width_max"), F.round(F.avg(w), 2).alias("width_mean"), F.min(h).alias("height_min"), F.max(h).alias("height_max"), F.round(F.avg(h), 2).alias("height_mean")).alias("image_size_statistics"))
    codes = issues.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issue_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("counts"))
    first = issues.orderBy(*order).limit(keep).agg(F.array_sort(F.collect_list(F.struct(*order, "code"))).alias("issues"))
    one = total.join(codes, F.lit(True)).join(first, F.lit(True))
    summary = F.struct(F.col("s.total_images"), "issue_count", "counts")
    return one.select(F.lit("1.0").alias("schema_version"), summary.alias("summary"), "image_size_statistics", "issues")


def write_quality_report(report: DataFrame, path: str) -> DataFrame:
    report.write.mode("errorifexists").json(path)
    return report


def label_text(boxes: DataFrame, image: str, class_id: str, box: str, order: list[str], decimals: int = 6) -> DataFrame:
    """image and text: a line `class cx cy w h` per box in order."""
    line = F.format_string("%d " + " ".join([f"%.{decimals}f"] * 4), class_id, *[F.col(f"{box}.{x}") for x in ("cx", "cy", "w", "h")])
    lines = boxes.select(image, F.struct(*order, line.alias("_line")).alias("_s")).groupBy(image).agg(F.array_sort(F.collect_list("_s")).alias("_l"))
    return lines.select(image, F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("text"))


def write_labels(labels: DataFrame, path: str, split: str | None = None) -> DataFrame:
    writer = labels.write.mode("errorifexists")
    (writer.partitionBy(split) if split else writer).parquet(path)
    return labels


def manifest(samples: DataFrame, version: str, operator: str, label: str = "label", model: str = "model_version", source_version: str | None = None) -> DataFrame:
    """One row: dataset_version, source_dataset_version, created_at, sample_count, added_sample_count, class_distribution,
    source_model_versions (sorted, distinct) and export_operator. Ids and hashes are rows of manifest_samples."""
    classes = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sample_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("class_distribution"))
    models = samples.select(model).where(F.col(model).isNotNull()).distinct().agg(F.array_sort(F.collect_list(model)).alias("source_model_versions"))
    return classes.join(models, F.lit(True)).withColumns({"dataset_version": F.lit(version), "source_dataset_version": F.lit(source_version).cast("string"), "created_at": F.current_timestamp(), "added_sample_count": F.col("sample_count"), "export_operator": F.lit(operator)})


def audit_rows(df: DataFrame, action: Column, entity: Column, operator: Column, ts: Column) -> DataFrame:
    return df.select(action.alias("action"), entity.cast("string").alias("entity_id"), operator.cast("string").alias("operator"), ts.alias("created_at"))


def append_audit(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("append").parquet(path)
    return rows


def flatten_report(report: DataFrame) -> DataFrame:
    """The summary of quality reports as table columns."""
    return report.select("schema_version", "summary.total_images", "summary.issue_count", "image_size_statistics.*")


def write_evaluation(metrics: DataFrame, cases: DataFrame, path: str) -> None:
    """metrics, false_positives and false_negatives below path. cases: kind false_positive or false_negative."""
    metrics.write.mode("errorifexists").json(f"{path}/metrics")
    for kind in ("false_positive", "false_negative"):
        cases.where(F.col("kind") == kind).write.mode("errorifexists").parquet(f"{path}/{kind}s")


def bitmap(levels: Column, width: int, height: int) -> Column:
    """The bytes of a bitmap file (24 bits a pixel, no compression) of grey levels, an array of 0 to 255 row by row."""
    pad = -3 * width % 4
    size = (3 * width + pad) * height
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + size, 0, 0, 54, 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0).hex()
    line = lambda y: F.concat(F.array_join(F.transform(F.slice(levels, (height - 1 - y) * width + 1, F.lit(width)), lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3))), ""), F.lit("00" * pad))
    return F.unhex(F.concat(F.lit(head), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), line), "")))


def write_files(df: DataFrame, root: str) -> int:
    """Write each row's data (binary) as a file at its path below root, in the tasks; how many. root: a folder, or an address
    that pyarrow knows, which all executors reach. A task that runs again writes the same files again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
        made: set[str] = set()
        for part in batches:
            for path, data in zip(part["path"], part["data"]):
                name = f"{base}/{path}"
                folder = name.rsplit("/", 1)[0]
                if folder not in made:
                    at.create_dir(folder, recursive=True)
                    made.add(folder)
                with at.open_output_stream(name) as out:
                    out.write(data)
            yield pd.DataFrame({"n": [len(part)]})

    return df.select("path", "data").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def manifest_samples(samples: DataFrame, version: str, source_version: str | None, id: str, hash: str) -> DataFrame:
    """The samples behind a manifest, a row each: dataset_version, source_dataset_version, sample_id and image_hash."""
    return samples.select(F.lit(version).alias("dataset_version"), F.lit(source_version).cast("string").alias("source_dataset_version"), F.col(id).cast("string").alias("sample_id"), F.col(hash).alias("image_hash"))
