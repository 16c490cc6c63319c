"""Queries on annotation files: written to the shared folder by tasks, read back by ranges and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from ..sources import annotations, files
from ..sources.shared import shared_folder
from ..sources.sinks import write_files
from ..streaming import feeds as R
from .inspection import OUT
from .registry import query
from .standins import LABELS, label_texts, table

#: Orders that one label file holds, and bytes of the ranges that files are read by.
ORDERS, BYTES = 4096, 64 << 10
#: Objects of one annotation: line items of a supplier that are in one part of its keys.
IMAGES = 4


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query(f"""WITH {LABELS}, e AS (SELECT l_orderkey // {ORDERS} AS k, CASE WHEN kind = 'bad' THEN 'MALFORMED_LABEL' WHEN cls NOT BETWEEN 0 AND 5 THEN 'INVALID_CLASS' WHEN kind = 'ok' AND {OUT} THEN 'OUT_OF_BOUNDS_BOX' END AS error FROM lines)
SELECT k::VARCHAR AS stem, count(*) AS n, count(*)::BIGINT AS last_line, (count(*) * (count(*) + 1) // 2)::BIGINT AS line_sum, count(*) FILTER (error = 'MALFORMED_LABEL') AS malformed, count(*) FILTER (error = 'INVALID_CLASS') AS invalid_class, count(*) FILTER (error = 'OUT_OF_BOUNDS_BOX') AS out_of_bounds FROM e GROUP BY k""")
def annotation_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Label files of many orders each, with blank lines and mixed line ends, read by ranges and validated."""
    key = F.floor(F.col("l_orderkey") / ORDERS).cast("long")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "value"))), lambda x: x["value"])
    texts = label_texts(spark, sf).groupBy(key.alias("k")).agg(F.array_join(lines, "\r\n \n").alias("text"))
    root = _folder(spark, "labels")
    write_files(texts.select(F.concat(F.lit("train/labels/"), F.col("k").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("data")), root)
    checked = C.validate_labels(annotations.annotation_lines(spark, root, BYTES), "value", 6)
    named = {"malformed": "MALFORMED_LABEL", "invalid_class": "INVALID_CLASS", "out_of_bounds": "OUT_OF_BOUNDS_BOX"}
    stem = F.regexp_extract("path", r"(\d+)\.txt$", 1).alias("stem")
    return checked.groupBy(stem).agg(F.count(F.lit(1)).alias("n"), F.max("line").cast("long").alias("last_line"), F.sum("line").alias("line_sum"), *[F.count_if(F.col("error") == v).alias(k) for k, v in named.items()])


def _box_files(spark: SparkSession, sf: str) -> DataFrame:
    """A box annotation for each supplier and part of its keys: k, path and data; every 13th supplier's cannot be read."""
    i = table(spark, sf, "lineitem").withColumn("part", F.col("l_partkey") % IMAGES)
    r = lambda c: F.round(c).cast("int").cast("string")
    q, d = F.col("l_quantity") * 10, F.col("l_discount") * 1000
    edges: list[tuple[str, Column]] = [("xmin", r(q)), ("ymin", r(d)), ("xmax", r(q + F.col("l_tax") * 1000 - 20)), ("ymax", r(d + 40))]
    corners = [x for name, value in edges for x in (F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))]
    one = F.concat(F.lit("<object><name>"), "l_returnflag", F.lit("</name><bndbox>"), *corners, F.lit("</bndbox></object>"))
    each = i.select("l_suppkey", "part", one.alias("o")).groupBy("l_suppkey", "part").agg(F.array_join(F.array_sort(F.collect_list("o")), "\n").alias("objects"))
    k, name = F.col("l_suppkey"), F.concat_ws("-", "l_suppkey", "part")
    width = F.when(k % 17 == 0, "0").otherwise("500")
    xml = F.concat(F.lit("<annotation><filename>"), name, F.lit("</filename><size><width>"), width, F.lit("</width><height>400</height><depth>3</depth></size>"), "objects", F.lit("</annotation>"))
    text = F.when(k % 13 == 0, "<annotation><filename>x</file").otherwise(xml)
    return each.select(k.alias("k"), F.concat(F.lit("Annotations/"), name, F.lit(".xml")).alias("path"), F.encode(text, "utf-8").alias("data"))


@query(f"""WITH v AS (SELECT l_suppkey AS k, l_partkey % {IMAGES} AS part, l_returnflag AS name, round(l_quantity * 10) AS xmin, round(l_discount * 1000) AS ymin, round(l_quantity * 10 + l_tax * 1000 - 20) AS xmax, round(l_discount * 1000 + 40) AS ymax FROM lineitem),
known AS (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal >= 0), e AS (SELECT k, part, CASE WHEN s_suppkey IS NULL THEN 'IMAGE_NOT_FOUND' WHEN k % 17 = 0 THEN 'INVALID_IMAGE_SIZE' WHEN name NOT IN ('A', 'N') THEN 'UNKNOWN_CLASS' WHEN xmax <= xmin OR ymax <= ymin THEN 'INVALID_BOX'
  WHEN xmin < 0 OR ymin < 0 OR xmax > 500 OR ymax > 400 THEN 'OUT_OF_BOUNDS_BOX' ELSE 'valid' END AS error FROM v LEFT JOIN known ON k = s_suppkey WHERE k % 13 <> 0 UNION ALL SELECT DISTINCT k, part, 'INVALID_XML' FROM v WHERE k % 13 = 0)
SELECT k || '-' || part AS stem, error, count(*) AS n FROM e GROUP BY ALL""")
def annotation_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Box annotations as a stream of files: those of even suppliers are there when it first runs, the others when it goes on
    from its checkpoint. Every object is judged once."""
    root, checkpoint, out = (_folder(spark, x) for x in ("boxes", "checkpoint", "judged"))
    made = _box_files(spark, sf)
    stems = F.explode(F.array(*[F.concat(F.col("s_suppkey").cast("string"), F.lit(f"-{p}")) for p in range(IMAGES)]))
    known = table(spark, sf, "supplier").where("s_acctbal >= 0").select(stems.alias("filename"))
    for wave in (F.col("k") % 2 == 0, F.col("k") % 2 != 0):
        write_files(made.where(wave), root)
        objects = files.parse_voc(annotations.annotation_texts(spark, root, stream=True), "value")
        judged = C.voc_issues(objects, known, ("A", "N")).select("path", F.coalesce("error", F.lit("valid")).alias("error"))
        R.to_parquet(judged, checkpoint, out).awaitTermination()
    stem = F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("stem")
    return spark.read.schema("path string, error string").parquet(out).groupBy(stem, "error").agg(F.count(F.lit(1)).alias("n"))
