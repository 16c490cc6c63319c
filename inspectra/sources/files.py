"""Readers of image sets, labels, annotations, reports and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_parts
from ..operators.checks import IMAGE_SUFFIXES, scan_label_lines

SPLITS = ("train", "val", "test")
VOC = (
    "filename STRING, size STRUCT<width: INT, height: INT, depth: INT>, "
    "object ARRAY<STRUCT<name: STRING, bndbox: STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>>>, _corrupt_record STRING"
)


def dataset_paths(df: DataFrame, path: str) -> DataFrame:
    """df with split, stem and suffix of paths in either layout: <split>/images/... or images/<split>/..."""
    parts = path_parts(F.col(path))
    a, b = F.regexp_extract(path, r"(?:^|/)(train|val|test)/images/", 1), F.regexp_extract(path, r"(?:^|/)images/(train|val|test)/", 1)
    split = F.nullif(F.when(a != "", a).otherwise(b), F.lit(""))
    return df.withColumn("split", split).withColumn("stem", parts["stem"]).withColumn("suffix", parts["suffix"])


def scan_dataset(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """path, split, stem, suffix, length, md5 and supported of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = dataset_paths(files.select("path", "length", F.md5("content").alias("md5")), "path")
    return out.withColumn("supported", F.col("suffix").isin(*extensions))


def decode_images(spark: SparkSession, root: str) -> DataFrame:
    """origin, height, width, nChannels, mode, data and issue; CORRUPT_IMAGE where a file cannot be decoded."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")
    return images.withColumn("issue", F.when(F.col("width") < 0, "CORRUPT_IMAGE"))


def label_lines(spark: SparkSession, root: str) -> DataFrame:
    """path, line and value of every non-blank line of the text files below root."""
    texts = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return scan_label_lines(texts.select(F.col("_metadata.file_path").alias("path"), "value").withColumnRenamed("value", "text"), "text").drop("text")


def parse_voc(df: DataFrame, xml: str) -> DataFrame:
    """A row per object of box annotations: filename, width, height, name, xmin, ymin, xmax, ymax. XML that cannot be read
    gives a row of nulls, an annotation without objects a row without name."""
    read = df.withColumn("_x", F.from_xml(F.col(xml), VOC, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.col("_x._corrupt_record").isNull()
    each = read.select(*df.columns, F.when(good, F.col("_x.filename")).alias("filename"), F.when(good, F.col("_x.size")).alias("_s"), F.explode_outer(F.when(good, F.col("_x.object"))).alias("_o"))
    return each.select(*df.columns, "filename", F.col("_s.width").alias("width"), F.col("_s.height").alias("height"), F.col("_o.name").alias("name"), *[F.col(f"_o.bndbox.{e}").alias(e) for e in ("xmin", "ymin", "xmax", "ymax")])


def parse_reports(df: DataFrame, json: str) -> DataFrame:
    """df with report, a VARIANT; rows whose JSON cannot be read are left out."""
    return df.withColumn("report", F.try_parse_json(F.col(json))).where("report is not null")


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    texts = spark.read.text(glob, wholetext=True)
    return parse_reports(texts.select(F.col("_metadata.file_path").alias("path"), "value"), "value").drop("value")


def scan_anomaly_layout(df: DataFrame, path: str) -> DataFrame:
    """df with part (train or test), defect (parent directory), stem and label (0 for good) of anomaly set paths; other
    paths, and training images that are not good, are left out."""
    part, defect = F.regexp_extract(path, r"(?:^|/)(train|test)/([^/]+)/[^/]+$", 1), F.regexp_extract(path, r"(?:^|/)(train|test)/([^/]+)/[^/]+$", 2)
    out = df.withColumn("part", part).withColumn("defect", defect).withColumn("stem", path_parts(F.col(path))["stem"]).withColumn("label", (F.col("defect") != "good").cast("int"))
    return out.where((F.col("part") == "test") | ((F.col("part") == "train") & (F.col("defect") == "good")))


def read_table(spark: SparkSession, directory: str, name: str, order: list | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A Parquet table, or a page of it in an explicit order."""
    out = spark.read.parquet(f"{directory}/{name}.parquet")
    if order:
        out = out.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)
