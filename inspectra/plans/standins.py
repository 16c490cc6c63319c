"""The business tables in the roles of images, inspections, boxes and actions, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import box
from ..sources.shared import shared_folder  # noqa: F401  queries take it from here


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def inspections(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as inspections: line items over 20 as regions, price as anomaly score, priority as image quality."""
    items = table(spark, sf, "lineitem").where("l_quantity > 20")
    region = F.struct(*ORDER, F.col("l_returnflag").alias("class_name"), (F.col("l_quantity") / 50).alias("confidence"))
    regions = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(region)).alias("r"))
    o = table(spark, sf, "orders").join(regions, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    r = F.transform(F.coalesce("r", F.array().cast(regions.schema["r"].dataType)), lambda x: F.struct(x["class_name"].alias("class_name"), x["confidence"].alias("confidence")))
    issues = F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("BLURRY_IMAGE"))).when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 50 == 0), F.array(F.lit("CORRUPT_IMAGE")))
    return o.select(
        F.col("o_orderkey").alias("inspection_id"), "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice", r.alias("regions"), F.coalesce(issues, F.array().cast("array<string>")).alias("issues"),
        (F.col("o_totalprice") / 50000).alias("score"), F.lit(False).alias("flag"), ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 == 0)).alias("failed"),
    )


DECISION = {"issues": "issues", "regions": "regions", "score": "score", "flag": "flag", "failed": "failed"}

INSPECTIONS = """
regions AS (SELECT l_orderkey, list({'c': l_quantity / 50, 'k': l_returnflag} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS regions
  FROM lineitem WHERE l_quantity > 20 GROUP BY 1),
inspections AS (SELECT o_orderkey AS inspection_id, o_custkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice, regions, coalesce(len(regions), 0) AS n,
  coalesce(list_max(list_transform(regions, lambda x: x.c)), 0) AS top, coalesce(len(list_filter(regions, lambda x: x.k = 'R' AND x.c >= 0.5)), 0) > 0 AS risky,
  o_totalprice / 50000 AS score, (o_orderstatus = 'P' AND o_orderkey % 7 = 0) AS failed,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'BLURRY_IMAGE' WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 0 THEN 'CORRUPT_IMAGE' END AS issue
  FROM orders LEFT JOIN regions ON l_orderkey = o_orderkey),
told AS (SELECT *, list_sort(list_distinct(list_filter([issue, CASE WHEN failed THEN 'INFERENCE_FAILED' END, CASE WHEN n > 0 AND top < 0.5 THEN 'YOLO_LOW_CONFIDENCE' END,
  CASE WHEN n = 0 AND score >= 8.35 THEN 'YOLO_NONE_ANOMALY_HIGH' END, CASE WHEN n > 0 AND score >= 8.35 THEN 'MODEL_CONFLICT_OR_UNKNOWN_ANOMALY' END,
  CASE WHEN risky THEN 'HIGH_RISK_DEFECT' END, CASE WHEN score >= 8.35 THEN 'UNKNOWN_ANOMALY' END], lambda x: x IS NOT NULL))) AS reasons FROM inspections),
decided AS (SELECT *, CASE WHEN list_contains(reasons, 'CORRUPT_IMAGE') THEN 'IMAGE_QUALITY_FAILED' WHEN failed THEN 'INFERENCE_FAILED' WHEN len(reasons) > 0 THEN 'REVIEW_REQUIRED'
  WHEN n > 0 THEN 'DEFECT' WHEN score >= 8.35 THEN 'ANOMALY' ELSE 'PASS' END AS status FROM told)
"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as images: md5 of the text, and a split from the id."""
    d = table(spark, sf, "documents")
    bucket = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("int") % 10
    return d.withColumn("hash", F.md5("text")).withColumn("split", F.when(bucket <= 6, "train").when(bucket <= 8, "val").otherwise("test"))


DOCUMENTS = """
bucketed AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::INT % 10 AS bucket FROM documents),
images AS (SELECT doc_id, lang, source, n_chars, text, md5(text) AS hash, CASE WHEN bucket <= 6 THEN 'train' WHEN bucket <= 8 THEN 'val' ELSE 'test' END AS split FROM bucketed)
"""


def boxes(spark: SparkSession, sf: str, shift: float = 0.0) -> DataFrame:
    """Line items as boxes of images (orders): struct box, class, confidence; shifted right by tax."""
    i = table(spark, sf, "lineitem")
    x = F.col("l_quantity") * 10 + F.col("l_tax") * shift
    y = F.col("l_discount") * 1000
    return i.select(
        F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("cls"), (F.col("l_quantity") / 50).alias("conf"), box(x, y, x + 40 + F.col("l_linenumber") * 5, y + 40).alias("box"), *ORDER, "l_tax", "l_discount"
    )


BOXES = """
boxes AS (SELECT l_orderkey AS image, l_returnflag AS cls, l_quantity / 50 AS conf, l_quantity * 10 AS x1, l_discount * 1000 AS y1,
  l_quantity * 10 + 40 + l_linenumber * 5 AS x2, l_discount * 1000 + 40 AS y2, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_discount FROM lineitem)
"""


def label_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A label line per line item, some of them broken."""
    i = table(spark, sf, "lineitem")
    k = F.col("l_orderkey") % 11
    numbers = F.concat_ws(" ", (F.col("l_quantity") / 50).cast("string"), (F.col("l_discount") * 10).cast("string"), (F.col("l_tax") * 4).cast("string"), F.lit("0.2"))
    line = F.when(k == 3, F.concat_ws(" ", F.col("l_linenumber") - 1, (F.col("l_quantity") / 50).cast("string"))).when(k == 5, F.concat(F.lit("1.0 "), numbers)).when(k == 7, F.concat_ws(" ", F.col("l_linenumber") - 1, F.lit("nan 0.5 0.1 0.1")))
    return i.select("l_orderkey", "l_linenumber", F.coalesce(line, F.concat_ws(" ", F.col("l_linenumber") - 1, numbers)).alias("value"))


LABELS = """
lines AS (SELECT l_orderkey, l_linenumber - 1 AS cls, l_quantity / 50 AS cx, l_discount * 10 AS cy, l_tax * 4 AS w, 0.2::DOUBLE AS h,
  CASE WHEN l_orderkey % 11 IN (3, 5) THEN 'bad' WHEN l_orderkey % 11 = 7 THEN 'nan' ELSE 'ok' END AS kind FROM lineitem)
"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as pixels: id, pos, channel 0, x, label."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("pos", "v")).select("id", "label", "pos", F.lit(0).alias("channel"), F.col("v").cast("double").alias("x"))


VECTORS = "vectors AS (SELECT vec_id AS id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as review actions: purchase approves, click corrects, error rejects; the user is the review."""
    e = table(spark, sf, "events")
    kinds = F.create_map(*[F.lit(x) for kv in (("purchase", "approve"), ("click", "correct"), ("error", "reject")) for x in kv])
    return e.where(F.col("event_type").isin("purchase", "click", "error")).select(F.col("user_id").alias("review_id"), F.col("event_id").alias("action_id"), kinds[F.col("event_type")].alias("action"), F.lit("r").alias("reviewer"), "ts")


ACTIONS = """
actions AS (SELECT user_id AS review_id, event_id AS action_id, ts, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'correct' ELSE 'reject' END AS action
  FROM events WHERE event_type IN ('purchase', 'click', 'error'))
"""


def models(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as registered models: brand is the type, name and size the version."""
    p = table(spark, sf, "part")
    version = F.concat_ws("-", "p_name", "p_size")
    return p.select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("model_type"), F.col("p_name").alias("model_name"), version.alias("version"), (F.col("p_partkey") % 2 == 0).alias("active"))


MODELS = "models AS (SELECT p_partkey AS model_id, p_brand AS model_type, p_name AS model_name, p_name || '-' || p_size AS version, p_partkey % 2 = 0 AS active FROM part)"
