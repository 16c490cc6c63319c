"""Queries on datasets: duplicates, leakage, splits, annotations, detections, evaluation and reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import hashing, text, variants
from ..operators import aggregates as A
from ..operators import checks as C
from ..operators import images as U
from ..operators import joins as J
from ..operators import windows as W
from ..sources import files, sinks
from ..streaming import feeds as R
from .registry import query
from .standins import ACTIONS, BOXES, DOCUMENTS, MODELS, ORDER, VECTORS, actions, boxes, documents, models, shared_folder, table, vectors


@query(f"WITH {DOCUMENTS} SELECT i.doc_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING_ANNOTATION' WHEN l.e THEN 'EMPTY_ANNOTATION' END AS annotation FROM images i LEFT JOIN (SELECT doc_id, bool_and(quality = 0) AS e FROM labels GROUP BY 1) l USING (doc_id)")
def annotation_presence(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, " ").otherwise("0 0.5 0.5 0.1 0.1").alias("text"))
    return J.annotation_presence(documents(spark, sf), labels, ["doc_id"], "text").select("doc_id", "annotation")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def missing_images(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return A.class_distribution(J.missing_images(table(spark, sf, "lineitem"), o, "l_orderkey"), "l_orderkey")


STEMS = "a AS (SELECT doc_id - (doc_id % 10 = 0)::INT AS stem, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id - (doc_id % 15 = 7)::INT AS stem, count(*) AS n FROM labels GROUP BY 1)"


def _stems(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stems of all documents and of all labels; some ids stand for the one before, so that stems are missing and double."""
    stem = lambda n, k: (F.col("doc_id") - (F.col("doc_id") % n == k).cast("int")).alias("stem")
    return table(spark, sf, "documents").select(stem(10, 0)), table(spark, sf, "labels").select(stem(15, 7))


@query(f"""WITH {STEMS} SELECT coalesce(a.stem, b.stem) AS stem, coalesce(a.n, 0) AS n_images, coalesce(b.n, 0) AS n_annotations, CASE WHEN a.n > 1 OR b.n > 1 THEN 'duplicate' WHEN b.n IS NULL THEN 'unmatched_image' WHEN a.n IS NULL THEN 'unmatched_annotation' ELSE 'matched' END AS state
FROM a FULL JOIN b ON a.stem = b.stem""")
def stem_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return J.pair_by_stem(*_stems(spark, sf), "stem")


@query(f"WITH {STEMS} SELECT stem FROM a INTERSECT SELECT stem FROM b")
def matched_stems(spark: SparkSession, sf: str) -> DataFrame:
    return W.matched(*_stems(spark, sf), "stem")


@query(f"WITH {STEMS} SELECT stem, 'left' AS side FROM a WHERE stem NOT IN (SELECT stem FROM b) UNION ALL SELECT stem, 'right' FROM b WHERE stem NOT IN (SELECT stem FROM a)")
def unmatched_stems(spark: SparkSession, sf: str) -> DataFrame:
    return W.unmatched(*_stems(spark, sf), "stem")


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def unknown_classes(spark: SparkSession, sf: str) -> DataFrame:
    return W.unknown_values(table(spark, sf, "events"), "event_type", ["click", "view"])


@query("SELECT x AS lang FROM (VALUES ('en'), ('xx'), ('de'), ('yy')) t(x) WHERE x NOT IN (SELECT lang FROM documents)")
def missing_splits(spark: SparkSession, sf: str) -> DataFrame:
    return W.missing_values(table(spark, sf, "documents"), "lang", ["en", "xx", "de", "yy"])


@query("SELECT o_orderkey AS id, o_orderstatus AS status, NULL::DOUBLE AS value FROM orders UNION ALL SELECT event_id, NULL, round(value, 6) FROM events")
def united_reports(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return W.union_reports(a, table(spark, sf, "events").select(F.col("event_id").alias("id"), F.round("value", 6).alias("value")))


@query("SELECT DISTINCT least(l_suppkey, l_linenumber) AS a, greatest(l_suppkey, l_linenumber) AS b FROM lineitem")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return W.distinct_pairs(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_linenumber").cast("long").alias("b")), "a", "b")


@query(f"WITH {DOCUMENTS} SELECT * FROM (SELECT doc_id, split, min(doc_id) OVER h AS first_id, count(*) OVER h - count(*) OVER (PARTITION BY hash, split) AS links FROM images WINDOW h AS (PARTITION BY hash)) WHERE links > 0")
def exact_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return J.exact_leakage(documents(spark, sf).select("doc_id", "hash", "split"), "doc_id", "hash", "split").select("doc_id", "split", "first_id", "links")


@query(f"WITH {DOCUMENTS} SELECT t.doc_id AS train_name, v.name AS val_name FROM images t JOIN (SELECT hash, max(doc_id) AS name FROM images WHERE split = 'val' GROUP BY 1) v USING (hash) WHERE t.split = 'train'")
def split_hash_leakage(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return J.split_hash_leakage(d.where("split = 'train'"), d.where("split = 'val'"), "doc_id", "hash").select("train_name", "val_name")


@query(f"WITH {DOCUMENTS} SELECT doc_id, duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY hash) AS duplicate_of FROM images) WHERE doc_id <> duplicate_of")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return W.exact_duplicates(documents(spark, sf).select("doc_id", "hash"), "doc_id", "hash", ["doc_id"]).select("doc_id", "duplicate_of")


@query(f"WITH {DOCUMENTS} SELECT hash, count(*) AS size, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT split) AS n_splits FROM images GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return A.hash_groups(documents(spark, sf), "doc_id", "hash", "split")


#: Vectors, and each again with one element turned round: neighbours within two bits.
HASHED = """rows AS (SELECT vec_id, label, embedding AS e FROM embeddings UNION ALL SELECT vec_id + 1000000000, 1 - label, list_transform(range(1, 65), lambda i: CASE WHEN i = vec_id % 64 + 1 THEN -embedding[i] ELSE embedding[i] END) FROM embeddings),
hashed AS (SELECT vec_id, label, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN e[i + 1] > e[i] THEN (1::HUGEINT << (63 - i)) ELSE 0 END))::BIGINT AS h FROM rows)"""


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("e"))
    turned = F.transform("e", lambda x, i: F.when(i == F.pmod("vec_id", F.lit(64)), -x).otherwise(x))
    both = e.unionByName(e.select((F.col("vec_id") + 1000000000).alias("vec_id"), (1 - F.col("label")).alias("label"), turned.alias("e")))
    return both.select("vec_id", "label", hashing.difference_hash(F.col("e")).alias("h"), F.md5(F.col("vec_id").cast("string")).alias("content"))


NEAR = f"WITH {HASHED}, near AS (SELECT a.vec_id AS first_id, b.vec_id AS second_id, bit_count(xor(a.h, b.h))::INT AS distance, a.label AS first_split, b.label AS second_split FROM hashed a JOIN hashed b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 4)"


@query(f"{NEAR} SELECT first_id, second_id, distance FROM near")
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return J.near_duplicates(_hashed(spark, sf), "vec_id", "h", "content", 4, 63)


@query(f"{NEAR} SELECT * FROM near WHERE first_split <> second_split")
def near_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return J.near_leakage(_hashed(spark, sf), "vec_id", "h", "content", "label", 4, 63)


KEY = "md5('42|' || doc_id)"


@query(f"""WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY {KEY}, doc_id) AS nth FROM documents)
SELECT doc_id, CASE WHEN nth <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN nth <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return W.stratified_split(table(spark, sf, "documents"), "doc_id", "lang").select("doc_id", "split")


@query(f"WITH {DOCUMENTS} SELECT doc_id, first_value(split) OVER (PARTITION BY hash ORDER BY doc_id) AS split FROM images")
def aligned_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return W.align_duplicates(documents(spark, sf).select("doc_id", "hash", "split"), "doc_id", "hash", "split").select("doc_id", "split")


@query(f"WITH r AS (SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY {KEY}, doc_id) AS nth FROM documents) SELECT doc_id, CASE WHEN nth <= greatest(1, least(n - 1, round_even(n * 0.25::DOUBLE, 0))) THEN 'val' ELSE 'train' END AS split FROM r")
def random_split(spark: SparkSession, sf: str) -> DataFrame:
    return W.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.25).select("doc_id", "split")


@query(f"WITH {DOCUMENTS} SELECT split, lang, count(*) AS n FROM images GROUP BY 1, 2")
def split_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.split_distribution(documents(spark, sf), "split", "lang")


@query("SELECT p_partkey, place, 80 - n AS short FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part) WHERE place <= 80)")
def top_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return W.top_k_per_class(table(spark, sf, "part"), "p_brand", [F.desc("p_size"), "p_partkey"], 80).select("p_partkey", F.col("place").cast("long").alias("place"), "short")


@query(f"WITH {BOXES}, k AS (SELECT image, cls, l_linenumber, count(*) AS n FROM boxes GROUP BY ALL) SELECT image, count(*) AS kept, sum(n - 1)::BIGINT AS removed FROM k GROUP BY 1")
def repeated_boxes(spark: SparkSession, sf: str) -> DataFrame:
    kept, removed = W.drop_repeated_boxes(boxes(spark, sf), "image", "cls", ["l_linenumber"])
    return kept.groupBy("image").agg(F.count(F.lit(1)).alias("kept")).join(removed, "image")


@query("SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS class_id FROM part GROUP BY 1")
def class_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return W.class_ids(table(spark, sf, "part"), "p_brand", ["p_partkey"]).select("p_brand", F.col("class_id").cast("long").alias("class_id"))


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS nth, count(*) OVER () AS total FROM orders) SELECT o_orderkey FROM n WHERE nth % greatest(1, ceil(total / 1000)::BIGINT) = 0")
def decimated_rows(spark: SparkSession, sf: str) -> DataFrame:
    return W.decimate(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 1000).select("o_orderkey")


@query("WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS nth, count(*) OVER () AS total FROM embeddings), s AS (SELECT unnest(range(1600)) AS i) SELECT i // 16 AS batch, i % 16 AS slot, vec_id FROM s JOIN n ON nth = i % total")
def cyclic_batches(spark: SparkSession, sf: str) -> DataFrame:
    return W.cyclic_batches(table(spark, sf, "embeddings").select("vec_id"), ["vec_id"], 16, 100)


NUM = ", row_number() OVER (PARTITION BY image ORDER BY conf DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"


@query(f"WITH {BOXES} SELECT image, l_partkey, region FROM (SELECT *{NUM} AS region FROM boxes)")
def numbered_regions(spark: SparkSession, sf: str) -> DataFrame:
    return W.number_regions(boxes(spark, sf), "image", [F.desc("conf"), *ORDER]).select("image", "l_partkey", F.col("region").cast("long").alias("region"))


IOU = """CASE WHEN (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) > 0 THEN
greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) ELSE 0 END"""


@query(f"""WITH RECURSIVE {BOXES}, n AS (SELECT *{NUM} AS r FROM boxes), over AS (SELECT a.image, a.r AS r1, b.r AS r2 FROM n a JOIN n b ON a.image = b.image AND a.r < b.r WHERE {IOU} > 0.5),
top AS (SELECT image, max(r) AS m FROM n GROUP BY 1),
walk AS (SELECT image, 0::BIGINT AS r, []::BIGINT[] AS kept FROM top UNION ALL
  SELECT w.image, w.r + 1, CASE WHEN EXISTS (SELECT 1 FROM over o WHERE o.image = w.image AND o.r2 = w.r + 1 AND list_contains(w.kept, o.r1)) THEN w.kept ELSE list_append(w.kept, w.r + 1) END FROM walk w JOIN top USING (image) WHERE w.r < top.m)
SELECT w.image, len(w.kept)::BIGINT AS kept, top.m AS boxes FROM walk w JOIN top ON w.image = top.image AND w.r = top.m""")
def suppressed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    n = b.groupBy("image").agg(F.count(F.lit(1)).alias("boxes"))
    return W.nms(b, "image", "box", "conf", ORDER).groupBy("image").agg(F.count(F.lit(1)).alias("kept")).join(n, "image")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return J.match_boxes(boxes(spark, sf).where("l_linenumber <= 4"), boxes(spark, sf, 400.0).where("l_linenumber >= 2"), "image", "box", "cls", ORDER)


MATCHED = f"""WITH RECURSIVE {BOXES}, t AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM boxes WHERE l_linenumber <= 4),
p AS (SELECT image, cls, x1 + l_tax * 400 AS x1, y1, x2 + l_tax * 400 AS x2, y2, row_number() OVER (PARTITION BY image ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM boxes WHERE l_linenumber >= 2),
pairs AS (SELECT a.image, a.r AS t, b.r AS p, a.cls = b.cls AS same, {IOU} AS iou FROM t a JOIN p b ON a.image = b.image), good AS (SELECT * FROM pairs WHERE iou >= 0.5),
top AS (SELECT image, max(r) AS m FROM t GROUP BY 1),
walk AS (SELECT image, 0::BIGINT AS r, []::BIGINT[] AS used, []::VARCHAR[] AS outcomes FROM top UNION ALL
  SELECT w.image, w.r + 1, CASE WHEN g.p IS NULL THEN w.used ELSE list_append(w.used, g.p) END, list_append(w.outcomes, CASE WHEN g.p IS NULL THEN 'missed' WHEN g.same THEN 'hit' ELSE 'class_error' END)
  FROM walk w JOIN top USING (image) LEFT JOIN LATERAL (SELECT arg_max(p, {{'i': iou, 'p': -p}}) AS p, arg_max(same, {{'i': iou, 'p': -p}}) AS same FROM good WHERE good.image = w.image AND good.t = w.r + 1 AND NOT list_contains(w.used, p)) g ON true WHERE w.r < top.m),
done AS (SELECT w.* FROM walk w JOIN top ON w.image = top.image AND w.r = top.m),
outcomes AS (SELECT image, unnest(range(1, len(outcomes) + 1)) AS "at", unnest(outcomes) AS outcome FROM done UNION ALL SELECT p.image, p.r, 'false_positive' FROM p JOIN done d ON p.image = d.image AND NOT list_contains(d.used, p.r))"""


@query(MATCHED + ' SELECT image, "at", outcome FROM outcomes')
def matched_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf).select("image", F.col("at").cast("long").alias("at"), "outcome")


@query(MATCHED + " SELECT outcome, count(*) AS n FROM outcomes WHERE outcome <> 'hit' GROUP BY ROLLUP (outcome)")
def error_tally(spark: SparkSession, sf: str) -> DataFrame:
    return A.error_tally(_matches(spark, sf))


@query(MATCHED + " SELECT image, outcome, count(*) AS n FROM outcomes WHERE outcome <> 'hit' GROUP BY 1, 2")
def errors_by_image(spark: SparkSession, sf: str) -> DataFrame:
    return A.error_tally(_matches(spark, sf), by=["image"])


@query(MATCHED + """ SELECT image, "at", outcome FROM outcomes WHERE outcome <> 'hit'""")
def error_items(spark: SparkSession, sf: str) -> DataFrame:
    return A.error_items(_matches(spark, sf)).select("image", F.col("at").cast("long").alias("at"), "outcome")


@query(f"""WITH {BOXES} SELECT image, l_partkey, round((x2 - x1) * (y2 - y1), 6) AS area, round((x2 - x1) / (y2 - y1), 6) AS aspect, round((x1 + x2) / 2 / 700, 6) AS cx, round((y2 - y1) / 500, 6) AS h, x1::INT AS back, (x2 - x1) * (y2 - y1) BETWEEN 1800 AND 2800 AND (x2 - x1) / (y2 - y1) BETWEEN 1.2::DOUBLE AND 2.0::DOUBLE AS fits,
least((x1 / 700 * 640 / 640), 1) <= 1 AS small FROM boxes""")
def box_geometry(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.lit(700.0), F.lit(500.0)
    g, c = B.region_geometry(F.col("box")), B.voc_to_center(F.col("box"), w, h)
    back = B.center_to_pixels(c, w, h)
    round_ = B.circularity(g["area"], 2 * (F.col("box.x2") - F.col("box.x1") + F.col("box.y2") - F.col("box.y1")))
    fits = B.shape_ok(g["area"], g["aspect_ratio"], round_, {"area": (1800, 2800), "aspect": (1.2, 2.0), "circularity": (0.0, 1.0)})
    whole = B.to_pixels(F.col("box"), w, h)["x1"] >= 0
    return boxes(spark, sf).select("image", "l_partkey", F.round(g["area"], 6).alias("area"), F.round(g["aspect_ratio"], 6).alias("aspect"), F.round(c["cx"], 6).alias("cx"), F.round(c["h"], 6).alias("h"), F.round(back["x1"]).cast("int").alias("back"), fits.alias("fits"), whole.alias("small"))


@query(f"""WITH {BOXES}, f AS (SELECT *, 640 / 1000 AS ratio, (640 - round_even(600 * (640 / 1000), 0)) / 2 AS pad FROM boxes)
SELECT image, l_partkey, round_even(least(greatest(x1 / ratio, 0), 1000), 0)::INT AS x1, round_even(least(greatest((y1 + 40 - pad) / ratio, 0), 600), 0)::INT AS y1 FROM f""")
def letterboxed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.lit(1000), F.lit(600)
    b = F.struct(*[(F.col(f"box.{e}") + (40 if e[0] == "y" else 0)).alias(e) for e in B.EDGES])
    out = B.unletterbox(b, B.letterbox(w, h, 640, 640), w, h)
    return boxes(spark, sf).select("image", "l_partkey", out["x1"].alias("x1"), out["y1"].alias("y1"))


@query("SELECT l_orderkey, l_partkey, CASE WHEN l_tax >= 0.05 OR l_discount >= 0.05 THEN CASE WHEN l_tax >= l_discount THEN 0 ELSE 1 END END::INT AS class_id, round(CASE WHEN l_tax >= 0.05 OR l_discount >= 0.05 THEN l_quantity - 5 END, 6) AS x1 FROM lineitem")
def decoded_detections(spark: SparkSession, sf: str) -> DataFrame:
    row = F.array("l_quantity", "l_quantity", F.lit(10.0), F.lit(10.0), "l_tax", "l_discount")
    d = B.decode_detection(row, "xywh", 0.05)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", d["class_id"].alias("class_id"), F.round(d["box"]["x1"], 6).alias("x1"))


@query(f"WITH {BOXES}, l AS (SELECT image, printf('%d %.6f %.6f %.6f %.6f', l_linenumber, (x1 + x2) / 2 / 1000, (y1 + y2) / 2 / 1000, (x2 - x1) / 1000, (y2 - y1) / 1000) AS line, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM boxes) SELECT image, length(string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS chars, count(*) AS lines FROM l GROUP BY 1")
def label_texts(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("c", B.voc_to_center(F.col("box"), F.lit(1000.0), F.lit(1000.0)))
    return sinks.label_text(b, "image", "l_linenumber", "c", ORDER).select("image", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1")
def orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.class_distribution(J.orphans(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").where("p_size > 5"), "p_partkey"), "l_orderkey")


@query("SELECT l_partkey, count(*) AS n FROM (SELECT CASE WHEN p.p_partkey IS NOT NULL THEN l.l_partkey END AS l_partkey FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 5) GROUP BY 1")
def repaired_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return A.class_distribution(J.null_orphans(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").where("p_size > 5"), "p_partkey"), "l_partkey")


@query(f"""WITH {MODELS}, a AS (SELECT model_type, min(model_id) AS id FROM models WHERE active GROUP BY 1), i AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'detection' ELSE p_brand END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_name || '-' || p_size END AS asked FROM part),
m AS (SELECT model_id, CASE WHEN model_id % 4 = 1 THEN 'detection' ELSE model_type END AS model_type, version, active FROM models), act AS (SELECT model_type, min(model_id) AS id FROM m WHERE active GROUP BY 1), req AS (SELECT version, min(model_id) AS id FROM m WHERE model_type = 'detection' GROUP BY 1)
SELECT p_partkey, CASE WHEN kind = 'detection' AND asked IS NOT NULL THEN req.id ELSE act.id END AS model_id FROM i LEFT JOIN act ON kind = act.model_type LEFT JOIN req ON asked = req.version""")
def attached_models(spark: SparkSession, sf: str) -> DataFrame:
    m = models(spark, sf).withColumn("model_type", F.when(F.col("model_id") % 4 == 1, "detection").otherwise(F.col("model_type")))
    i = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "detection").otherwise(F.col("p_brand")).alias("kind"), F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("-", "p_name", "p_size")).alias("asked"))
    return J.attach_models(i, m, "kind", "asked").select("p_partkey", "model_id")


@query("SELECT o_orderkey, n_nationkey AS version_id FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40")
def stamped_samples(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "nation").select(F.col("n_nationkey").alias("version"), F.col("n_nationkey").alias("version_id"))
    return J.stamp_version(table(spark, sf, "orders").withColumn("version", F.col("o_custkey") % 40), v).select("o_orderkey", "version_id")


@query("""WITH e AS (SELECT l_linenumber AS batch, l_returnflag AS config, avg(l_quantity) AS latency, avg(l_extendedprice) AS throughput FROM lineitem GROUP BY 1, 2)
SELECT a.batch, a.config, round(b.latency / a.latency, 6) AS latency_speedup, round(a.throughput / b.throughput, 6) AS throughput_speedup FROM e a JOIN e b ON a.batch = b.batch AND b.config = 'A' WHERE a.config <> 'A'""")
def compared_configs(spark: SparkSession, sf: str) -> DataFrame:
    out = J.compare_configs(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice", "A")
    return out.select(F.col("l_linenumber").alias("batch"), F.col("l_returnflag").alias("config"), F.round("latency_speedup", 6).alias("latency_speedup"), F.round("throughput_speedup", 6).alias("throughput_speedup"))


@query(f"""WITH {VECTORS}, b AS (SELECT id, pos, x * (1 + 0.001::DOUBLE * (pos % 3)) AS y FROM vectors WHERE id % 100 <> 7)
SELECT count(v.x) AS n_a, count(y) AS n_b, false AS same_shape, round(max(abs(x - y)), 6) AS max_abs_diff, bool_and(abs(x - y) <= 0.001::DOUBLE + 0.001::DOUBLE * abs(y)) AS all_close FROM vectors v FULL JOIN b ON v.id = b.id AND v.pos = b.pos""")
def compared_outputs(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("id", "pos", "x")
    out = J.compare_outputs(v, v.where("id % 100 <> 7").withColumn("x", F.col("x") * (1 + 0.001 * (F.col("pos") % 3))), ["id", "pos"], "x", 0.001, 0.001)
    return out.withColumn("max_abs_diff", F.round("max_abs_diff", 6))


@query(f"""WITH {MODELS}, told AS (SELECT 'p' || (event_id % 50) AS k, max(value) AS m FROM events GROUP BY 1), asked AS (SELECT l_partkey + 1900 AS model_id FROM lineitem GROUP BY 1)
SELECT a.model_id, round(coalesce(t.m, p_size), 6) AS metrics, CASE WHEN p_partkey IS NULL THEN 'MODEL_NOT_FOUND' END AS error FROM asked a LEFT JOIN part ON p_partkey = a.model_id LEFT JOIN told t ON t.k = 'p' || (p_partkey % 100)""")
def overridden_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("model_id"), F.concat(F.lit("p"), (F.col("p_partkey") % 100).cast("string")).alias("name"), F.col("p_size").cast("double").alias("metrics"))
    e = table(spark, sf, "events").select(F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("name"), F.col("value").alias("metrics"))
    asked = table(spark, sf, "lineitem").select((F.col("l_partkey") + 1900).alias("model_id")).distinct()
    return J.override_metrics(m, e, "name", asked).select("model_id", F.round("metrics", 6).alias("metrics"), "error")


@query("""WITH i AS (SELECT doc_id, lang AS defect, doc_id % 40 AS stem FROM documents), m AS (SELECT doc_id AS mask, lang AS defect, (doc_id % 60)::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN '_mask' ELSE '' END AS stem FROM documents),
r AS (SELECT mask, defect, replace(stem, '_mask', '') AS s, CASE WHEN contains(stem, '_mask') THEN 0 ELSE 1 END AS rank FROM m), b AS (SELECT defect, s, arg_min(mask, {'r': rank, 'm': mask}) AS mask FROM r GROUP BY 1, 2)
SELECT doc_id, CASE WHEN i.defect <> 'good' THEN mask END AS mask FROM i LEFT JOIN b ON i.defect = b.defect AND i.stem::VARCHAR = b.s""")
def paired_masks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    i = d.select("doc_id", F.col("lang").alias("defect"), (F.col("doc_id") % 40).cast("string").alias("stem"))
    m = d.select(F.col("doc_id").alias("mask"), F.col("lang").alias("defect"), F.concat((F.col("doc_id") % 60).cast("string"), F.when(F.col("doc_id") % 2 == 0, "_mask").otherwise("")).alias("stem"))
    return J.pair_masks(i, m).select("doc_id", "mask")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.class_distribution(table(spark, sf, "lineitem"), "l_returnflag")


@query("SELECT count(*) AS issue_count, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, 0::BIGINT AS invalid_annotation_count FROM events")
def issue_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.issue_summary(table(spark, sf, "events"), "event_type", ("click", "error"))


@query("SELECT count(*) AS count, min(p_size) AS width_min, max(p_size) AS width_max, round(avg(p_size), 2) AS width_mean, min(p_partkey % 9) AS height_min, max(p_partkey % 9) AS height_max, round(avg(p_partkey % 9), 2) AS height_mean, count(DISTINCT (p_size, p_partkey % 9)) AS resolutions FROM part")
def size_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return A.size_statistics(table(spark, sf, "part").withColumn("h", F.col("p_partkey") % 9), "p_size", "h")


@query("SELECT p_size AS width, p_partkey % 9 AS height, count(*) AS n FROM part GROUP BY 1, 2")
def resolution_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.resolutions(table(spark, sf, "part").withColumn("h", F.col("p_partkey") % 9), "p_size", "h")


@query("""SELECT 'width' AS kind, (n_chars - 100)::VARCHAR AS value, count(*) AS n FROM documents WHERE n_chars >= 100 GROUP BY 2 UNION ALL SELECT 'height', '1', count(*) FROM documents WHERE n_chars >= 100 UNION ALL
SELECT 'corrupt', doc_id::VARCHAR, count(*) FROM documents WHERE n_chars < 100 GROUP BY 2 UNION ALL SELECT 'invalid', doc_id::VARCHAR, count(*) FROM labels WHERE quality = 0 GROUP BY 2""")
def raw_set_details(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") - 100).alias("width")).withColumn("height", F.when(F.col("width") >= 0, 1))
    return A.raw_set_details(i, table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "bad").alias("error")), "doc_id", "doc_id")


@query("""SELECT source, 'corrupt' AS kind, doc_id::VARCHAR AS name, NULL AS value FROM documents WHERE n_chars < 500 UNION ALL SELECT source, 'hash', doc_id::VARCHAR, md5(text) FROM documents UNION ALL
SELECT source, 'size', n_chars::VARCHAR, count(*)::VARCHAR FROM documents WHERE n_chars >= 500 GROUP BY source, n_chars""")
def manifest_details(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("hash", F.md5("text"))
    return A.manifest_details(d, "source", "doc_id", "n_chars", "hash", F.col("n_chars") < 500)


@query("""SELECT count(*) AS images, count(*) FILTER (n_chars < 100) AS corrupt, count(DISTINCT CASE WHEN n_chars >= 100 THEN n_chars - 100 END) AS widths, count(DISTINCT CASE WHEN n_chars >= 100 THEN 1 END) AS heights,
(SELECT count(*) FROM labels) AS annotations, (SELECT count(*) FROM labels WHERE quality = 0) AS invalid FROM documents""")
def raw_set_summary(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "documents").select((F.col("n_chars") - 100).alias("width")).withColumn("height", F.when(F.col("width") >= 0, 1))
    return A.raw_set_summary(i, table(spark, sf, "labels").select(F.when(F.col("quality") == 0, "bad").alias("error")))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(1000 / avg(value), 6) AS throughput, round(1000 / avg(value), 6) AS fps FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = A.latency_summary(table(spark, sf, "events"), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms", "throughput", "fps")])


@query("""SELECT count(*) AS sent, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS auto_pass, count(*) FILTER (event_type = 'click') AS review, count(*) FILTER (event_type = 'signup') AS repeats,
round(avg(value) FILTER (event_type <> 'error'), 3) AS mean_ms, (SELECT round(list_sort(list(value))[round_even((count(value) - 1) * 0.95::DOUBLE, 0)::BIGINT + 1], 3) FROM events WHERE event_type <> 'error') AS p95_ms FROM events""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("status", F.when(F.col("event_type") == "view", "PASS").otherwise("DEFECT"))
    t = F.col("event_type")
    return A.run_summary(e, t != "error", "status", t == "click", t == "signup", "value")


SCORED = "s AS (SELECT doc_id, quality, lang, n_chars::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"
RANKED = f"WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid FROM s)"
AUROC = "(sum(mid) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0))"
CONFUSION = f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (score >= 1500 AND quality = 1) AS tp, count(*) FILTER (score >= 1500 AND quality = 0) AS fp, count(*) FILTER (score < 1500 AND quality = 1) AS fn, count(*) FILTER (score < 1500 AND quality = 0) AS tn FROM s),
m AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, fp / greatest(fp + tn, 1) AS fpr, fn / greatest(fn + tp, 1) AS fnr FROM c)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "quality", "lang", F.col("n_chars").cast("double").alias("score"))


@query(f"{RANKED} SELECT round({AUROC}, 6) AS auroc FROM r")
def auroc(spark: SparkSession, sf: str) -> DataFrame:
    return A.auroc(_scored(spark, sf), "quality", "score").select(F.round("auroc", 6).alias("auroc"))


@query(f"WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS mid FROM s) SELECT lang, round({AUROC}, 6) AS auroc FROM r GROUP BY 1")
def auroc_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return A.auroc(_scored(spark, sf), "quality", "score", ["lang"]).select("lang", F.round("auroc", 6).alias("auroc"))


@query(f"{RANKED} SELECT DISTINCT score, mid AS mid_rank FROM r")
def mid_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return A.mid_ranks(_scored(spark, sf), "score").select("score", "mid_rank")


@query(CONFUSION + " SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / greatest(precision + recall, 1e-12), 6) AS f1, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr FROM m")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    out = A.confusion(_scored(spark, sf), "quality", "score", 1500.0)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr", "fnr")])


@query(f"{RANKED}, a AS (SELECT round({AUROC}, 6) AS auroc FROM r), c AS (SELECT count(*) FILTER (score >= 1500 AND quality = 1) AS tp, count(*) FILTER (score >= 1500 AND quality = 0) AS fp FROM s) SELECT auroc, tp, fp FROM a, c")
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return A.evaluate(_scored(spark, sf), "quality", "score", 1500.0).select(F.round("auroc", 6).alias("auroc"), "tp", "fp")


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN score >= 1500 THEN 'false_positive' ELSE 'false_negative' END AS kind FROM s WHERE (score >= 1500) <> (quality = 1)")
def failure_cases(spark: SparkSession, sf: str) -> DataFrame:
    return A.failure_cases(_scored(spark, sf), "quality", "score", 1500.0).select("doc_id", "kind")


MODEL = f"WITH {VECTORS}, model AS (SELECT pos, avg(x) AS mean, greatest(stddev_pop(x), 0.0001) AS std FROM vectors WHERE label = 0 GROUP BY 1), deep AS (SELECT id, v.pos, sqrt(((x - mean) / std) ^ 2) AS score FROM vectors v JOIN model m ON v.pos = m.pos), scores AS (SELECT id, max(score) AS score FROM deep GROUP BY 1)"


def _model(spark: SparkSession, sf: str) -> DataFrame:
    return A.fit_normal_model(vectors(spark, sf).where("label = 0"), "pos", "channel", "x")


@query(MODEL + " SELECT pos, round(mean, 6) AS mean, round(std, 6) AS std FROM model")
def normal_model(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf).select(F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(MODEL + " SELECT id, round(score, 6) AS score FROM scores")
def anomaly_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = A.anomaly_scores(vectors(spark, sf), _model(spark, sf), "id", "pos", "channel", "x")
    return out.select("id", F.round("score", 6).alias("score"))


@query(MODEL + " SELECT (SELECT round(quantile_cont(score, 0.95), 6) FROM scores) AS image_threshold, (SELECT round(quantile_cont(score, 0.99), 6) FROM deep) AS position_threshold")
def score_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    deep = A.position_scores(vectors(spark, sf), _model(spark, sf), "id", "pos", "channel", "x")
    out = A.thresholds(deep.groupBy("id").agg(F.max("score").alias("score")), deep, 0.95, 0.99)
    return out.select(F.round("image_threshold", 6).alias("image_threshold"), F.round("position_threshold", 6).alias("position_threshold"))


@query(f"WITH {VECTORS}, e AS (SELECT id, min(x) AS lo, max(x) AS hi FROM vectors GROUP BY 1) SELECT v.id, pos, CASE WHEN hi > lo THEN floor(255 * (x - lo) / (hi - lo)) ELSE 0 END::INT AS scaled FROM vectors v JOIN e ON v.id = e.id")
def scaled_maps(spark: SparkSession, sf: str) -> DataFrame:
    return A.minmax_255(vectors(spark, sf), "id", "x").select("id", F.col("pos").cast("long").alias("pos"), "scaled")


@query("""SELECT source, count(*) AS images, count(DISTINCT lang) AS labels, count(*) FILTER (n_chars < 500) AS corrupt, (SELECT count(*) FROM labels l JOIN documents d2 USING (doc_id) WHERE d2.source = d.source) AS masks FROM documents d GROUP BY 1""")
def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return A.dataset_manifest(d, d.join(table(spark, sf, "labels"), "doc_id"), "source", "lang", "n_chars", F.col("n_chars") < 500).select("source", "images", "labels", "corrupt", "masks")


@query("SELECT event_type, count(*) AS n, round(greatest(100 * count(*) / max(count(*)) OVER (), 4), 6) AS width FROM events GROUP BY 1")
def class_bars(spark: SparkSession, sf: str) -> DataFrame:
    return A.class_bars(table(spark, sf, "events"), "event_type").withColumn("width", F.round("width", 6))


@query("""WITH h AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT p_brand, p_size, sum(n) OVER u AS n0, sum(n * p_size) OVER u AS s0, sum(n) OVER (PARTITION BY p_brand) AS nt, sum(n * p_size) OVER (PARTITION BY p_brand) AS st FROM h WINDOW u AS (PARTITION BY p_brand ORDER BY p_size)),
v AS (SELECT *, CASE WHEN nt > n0 THEN round(n0::DOUBLE * (nt - n0) * (s0 / n0 - (st - s0) / (nt - n0)) * (s0 / n0 - (st - s0) / (nt - n0)) / (nt::DOUBLE * nt), 9) ELSE 0 END AS v FROM s)
SELECT p_brand, arg_min(p_size, {'v': -v, 'p': p_size}) AS threshold, round(max(v), 6) AS variance FROM v GROUP BY 1""")
def otsu_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return A.otsu_threshold(table(spark, sf, "part"), "p_brand", "p_size").withColumn("variance", F.round("variance", 6))


REPORT = "'{\"summary\": {\"total_images\": ' || n_chars || ', \"issue_count\": ' || (doc_id % 5) || ', \"overexposed_count\": \"' || (doc_id % 7) || '\", \"corrupt_count\": true}, \"issues\": [{\"path\": \"a\"}, {\"path\": \"b\"}, {\"path\": \"a\"}], \"created_at\": \"' || lang || '\"}'"


@query("""SELECT doc_id, n_chars::DOUBLE AS total_images, n_chars::DOUBLE AS valid_images, CASE WHEN doc_id % 5 <= 3 THEN 2 END::INT AS problem_image_count, doc_id % 5 > 3 AS issues_truncated, round(CASE WHEN n_chars > 0 THEN (doc_id % 7) / n_chars END, 6) AS bright_ratio, doc_id % 5 = 0 AS valid, lang AS generated_at FROM documents""")
def quality_report_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = files.parse_reports(table(spark, sf, "documents").select("doc_id", F.expr(REPORT).alias("json")), "json")
    return A.quality_metrics(r, "report").select("doc_id", "total_images", "valid_images", "problem_image_count", "issues_truncated", F.round("bright_ratio", 6).alias("bright_ratio"), "valid", "generated_at")


BENCH = "'{\"results\": [{\"average_latency_ms\": 0, \"fps\": 1, \"provider\": \"none\"}, {\"avg_ms\": \"' || (event_id % 50 + 1) || '\", \"p50_ms\": ' || user_id || ', \"provider\": \"cpu\", \"batch_size\": 4}], \"percentiles\": {\"95\": ' || event_id || '}' || CASE WHEN event_id % 2 = 0 THEN ', \"summary\": {\"success_count\": 3, \"total_count\": 4}' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '' ELSE '}' END"


@query("""SELECT event_id, (event_id % 50 + 1)::DOUBLE AS average_latency_ms, user_id::DOUBLE AS p50_latency_ms, event_id::DOUBLE AS p95_latency_ms, CASE WHEN event_id % 2 = 0 THEN 0.75 ELSE 1 END::DOUBLE AS success_rate, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 0 END::DOUBLE AS error_rate, 'cpu' AS selected_provider, 4::DOUBLE AS selected_batch_size FROM events WHERE event_id % 3 <> 0""")
def benchmark_report_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = files.parse_reports(table(spark, sf, "events").select("event_id", F.expr(BENCH).alias("json")), "json")
    return A.benchmark_metrics(r, "report").select("event_id", "average_latency_ms", "p50_latency_ms", "p95_latency_ms", "success_rate", "error_rate", "selected_provider", "selected_batch_size")


SPELL = """CASE l_orderkey % 4 WHEN 0 THEN '{"bounding_box": {"left": ' || l_linenumber || ', "top": 2, "xmax": 9, "bottom": "12"}}' WHEN 1 THEN '{"bbox": {"x": ' || l_linenumber || ', "y": 2, "w": 5, "height": 6}}' WHEN 2 THEN '{"xywh": [' || l_linenumber || ', 2, 5, 6], "area": 7}' ELSE '{"box": true}' END"""


@query("""SELECT l_orderkey, l_partkey, CASE WHEN l_orderkey % 4 < 3 THEN l_linenumber END::DOUBLE AS x1, CASE l_orderkey % 4 WHEN 0 THEN 9 WHEN 1 THEN l_linenumber + 5 WHEN 2 THEN l_linenumber + 5 END::DOUBLE AS x2, CASE l_orderkey % 4 WHEN 0 THEN CASE WHEN l_linenumber < 9 THEN (9 - l_linenumber) * 10 END WHEN 1 THEN 30 WHEN 2 THEN 7 END::DOUBLE AS area, round(CASE l_orderkey % 4 WHEN 0 THEN CASE WHEN l_linenumber < 9 THEN (9 - l_linenumber) / 10 END WHEN 1 THEN 5 / 6 WHEN 2 THEN 5 / 6 END, 6) AS ratio FROM lineitem""")
def normalized_boxes(spark: SparkSession, sf: str) -> DataFrame:
    v = F.try_parse_json(F.expr(SPELL))
    b = variants.normalize_box(v)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", b["x1"].alias("x1"), b["x2"].alias("x2"), variants.region_area(v).alias("area"), F.round(variants.region_ratio(v), 6).alias("ratio"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 640 END::INT AS side, CASE WHEN event_id % 3 = 0 THEN 'fp16' ELSE 'fp32' END AS precision, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'none' END AS found, (event_id % 5)::DECIMAL(9, 1)::VARCHAR || ' / - / ' || user_id::DECIMAL(9, 1)::VARCHAR AS range FROM events""")
def model_metadata(spark: SparkSession, sf: str) -> DataFrame:
    json = F.expr("""'{"a": {' || CASE WHEN event_id % 2 = 0 THEN '"x": "' || event_type || '"' ELSE '' END || '}, "b": {"x": "none"}, "amp": ' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END || CASE WHEN event_id % 2 = 0 THEN ', "imgsz": ' || user_id ELSE '' END || '}'""")
    v = F.parse_json(json)
    m = variants.model_row(v)
    shown = variants.range_text((F.col("event_id") % 5).cast("double"), F.lit(None).cast("double"), F.col("user_id").cast("double"))
    return table(spark, sf, "events").select("event_id", m["input_size"][0].alias("side"), m["precision"].alias("precision"), variants.first_defined(v, "x", ("a", "b")).cast("string").alias("found"), shown.alias("range"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'test' END AS part, CASE WHEN doc_id % 5 = 0 THEN lang ELSE 'good' END AS defect, (doc_id % 5 = 0)::INT AS label FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 = 0)""")
def anomaly_layout(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("set/"), F.when(F.col("doc_id") % 3 == 0, "train/").otherwise("test/"), F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise("good"), F.lit("/"), "doc_id", F.lit(".png"))
    return files.scan_anomaly_layout(d.select("doc_id", path.alias("path")), "path").select("doc_id", "part", "defect", "label")


@query("""WITH i AS (SELECT doc_id % 400 AS path, min(n_chars) AS w FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY doc_id % 400 ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1 GROUP BY 1)
SELECT path, substr(sha1(path::VARCHAR), 1, 12) || '.jpg' AS name, greatest(floor(w * least(240 / w, 180 / 300, 1)), 1)::INT AS thumb_width, greatest(floor(300 * least(240 / w, 180 / 300, 1)), 1)::INT AS thumb_height FROM i""")
def thumbnail_plan(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select((F.col("doc_id") % 400).cast("string").alias("path"), "doc_id", F.col("n_chars").alias("w"), F.lit(300).alias("h"))
    return U.thumbnail_plan(d, "path", ["doc_id"], "w", "h").withColumn("path", F.col("path").cast("long"))


@query("SELECT '1.0' AS schema_version, count(*) AS total_images, (SELECT count(*) FROM documents WHERE n_chars < 1000) AS issue_count, min(n_chars) AS width_min, max(n_chars) AS width_max, round(avg(n_chars), 2) AS width_mean, 1 AS height_min, 1 AS height_max, 1.0::DOUBLE AS height_mean FROM documents")
def quality_report_row(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("width"), F.lit(1).alias("height"))
    issues = d.where("width < 1000").select("doc_id", F.lit("SMALL").alias("code"))
    return sinks.flatten_report(sinks.quality_report(d, issues, ["doc_id"]))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) AS score, CASE WHEN vec_id % 97 = 5 THEN 'failed' END AS error FROM embeddings WHERE vec_id % 97 <> 5 UNION ALL SELECT vec_id, NULL, 'failed' FROM embeddings WHERE vec_id % 97 = 5")
def predicted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer through the batch contract; it fails on some rows, which become data."""

    def scorer():
        def score(part: pd.DataFrame) -> pd.DataFrame:
            if (part["vec_id"] % 97 == 5).any():
                raise ValueError("failed")
            return pd.DataFrame({"score": [float((np.asarray(x, "float64") ** 2).sum()) for x in part["embedding"]]})

        return score

    return U.predict_batch(table(spark, sf, "embeddings").select("vec_id", "embedding"), scorer, "score double").select("vec_id", F.round("score", 4).alias("score"), "error")


def _stream(spark: SparkSession, sf: str, columns: list[str]) -> tuple[DataFrame, str]:
    schema = table(spark, sf, "events").schema
    return R.inspection_stream(spark, sf, schema, 10, "events.parquet").select(*columns), f"{shared_folder(spark)}/stream-{np.random.default_rng().integers(1 << 60):x}"


def _landed(stream: DataFrame, at: str) -> DataFrame:
    R.to_parquet(stream, f"{at}/checkpoint", f"{at}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


@query("SELECT event_id, event_type FROM events")
def inspection_feed(spark: SparkSession, sf: str) -> DataFrame:
    return _landed(*_stream(spark, sf, ["event_id", "event_type"]))


@query("SELECT DISTINCT user_id, event_type FROM events")
def deduplicated_feed(spark: SparkSession, sf: str) -> DataFrame:
    """First events of user and type through a stream whose watermark spans the data."""
    stream, at = _stream(spark, sf, ["user_id", "event_type", "ts"])
    stream = stream.withColumn("key", F.concat_ws("-", "user_id", "event_type"))
    return _landed(R.dedup_stream(stream, "key", "ts", "60 days"), at).select("user_id", "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts::DATE < (SELECT max(ts)::DATE FROM events) GROUP BY 1, 2")
def daily_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of the days that the stream has closed: all but the last."""
    stream, at = _stream(spark, sf, ["event_type", "ts"])
    return _landed(R.daily_counts(stream, "ts", "event_type", "0 seconds"), at).select(F.col("day").cast("string").alias("day"), "event_type", "n")


def _actions(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    stream, at = _stream(spark, sf, ["user_id", "event_id", "event_type", "ts"])
    kinds = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "click", "correct").otherwise("reject")
    return stream.where(F.col("event_type").isin("purchase", "click", "error")).select(F.col("user_id").alias("review_id"), F.col("event_id").alias("action_id"), kinds.alias("action"), F.col("ts").cast("timestamp").alias("ts")), at


def _with_rocksdb(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, R.ROCKSDB)
    try:
        return work()
    finally:
        spark.conf.set(name, before)


@query(f"WITH {ACTIONS} SELECT action_id, row_number() OVER (PARTITION BY review_id ORDER BY ts, action_id) = 1 AS accepted FROM actions")
def streamed_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The review state machine over the stream of actions; one batch here, so its order is the batch's."""
    acts, at = _actions(spark, sf)
    return _with_rocksdb(spark, lambda: _landed(R.review_stream(acts), at)).select("action_id", "accepted")


CLOSED = "closed AS (SELECT * FROM actions WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM actions) - INTERVAL 6 HOUR)"


@query(f"WITH RECURSIVE {ACTIONS}, {CLOSED}, opened AS (SELECT review_id, min(ts) AS at FROM closed GROUP BY 1 UNION ALL SELECT o.review_id, min(c.ts) FROM opened o JOIN closed c ON c.review_id = o.review_id AND c.ts > o.at + INTERVAL 2 DAY GROUP BY 1) SELECT c.action_id, o.at IS NOT NULL AND row_number() OVER (PARTITION BY c.review_id, c.ts ORDER BY c.action_id) = 1 AS accepted FROM closed c LEFT JOIN opened o ON o.review_id = c.review_id AND o.at = c.ts")
def review_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of two days over the stream of actions, settled six hours behind the newest."""
    acts, at = _actions(spark, sf)
    return _with_rocksdb(spark, lambda: _landed(R.review_rounds(acts, "6 hours", timedelta(days=2)), at)).select("action_id", "accepted")


@query("SELECT event_id, event_type FROM events")
def resumed_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The feed run twice with one checkpoint: the second run finds nothing new."""
    stream, at = _stream(spark, sf, ["event_id", "event_type"])
    _landed(stream, at)
    return _landed(stream, at)


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN n_chars >= 1500 THEN 'false_positive' ELSE 'false_negative' END AS kind FROM documents JOIN labels USING (doc_id) WHERE (n_chars >= 1500) <> (quality = 1)) GROUP BY 1 UNION ALL SELECT 'metrics', 1")
def written_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """An evaluation written to a folder and read again."""
    s, path = _scored(spark, sf), f"{shared_folder(spark)}/evaluation-{np.random.default_rng().integers(1 << 60):x}"
    sinks.write_evaluation(A.evaluate(s, "quality", "score", 1500.0), A.failure_cases(s, "quality", "score", 1500.0), path)
    cases = spark.read.parquet(f"{path}/false_positives", f"{path}/false_negatives")
    return A.class_distribution(cases, "kind").unionByName(spark.read.json(f"{path}/metrics").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("metrics")))


SCENE = "(SELECT vec_id, list_transform(embedding[1:64], lambda x: (floor(least(greatest((x + 3) * 40, 0), 255)))::INT) AS g FROM embeddings)"


@query(f"SELECT vec_id::VARCHAR AS origin, round(len(list_filter(g, lambda x: x >= 160)) / 64, 6) AS bright_ratio, round(len(list_filter(g, lambda x: x <= 80)) / 64, 6) AS dark_ratio FROM {SCENE}")
def brightness_features(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as grey images of 8 by 8 pixels through the image job."""
    level = F.transform(F.slice("embedding", 1, 64), lambda x: F.lower(F.lpad(F.hex(F.floor(F.least(F.greatest((x + F.lit(3).cast("float")) * 40, F.lit(0)), F.lit(255))).cast("long")), 2, "0")))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.array_join(level, "")).alias("data"))
    return U.image_features(e, 160, 80).select("origin", F.round("bright_ratio", 6).alias("bright_ratio"), F.round("dark_ratio", 6).alias("dark_ratio"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'good' ELSE 'bad' END AS sink FROM events")
def split_feed(spark: SparkSession, sf: str) -> DataFrame:
    stream, at = _stream(spark, sf, ["event_id", "event_type"])
    R.run(stream, f"{at}/checkpoint", R.split_sink(F.col("event_type") != "error", f"{at}/good", f"{at}/bad")).awaitTermination()
    read = lambda k: spark.read.schema(stream.schema).parquet(f"{at}/{k}").select("event_id", F.lit(k).alias("sink"))
    return read("good").unionByName(read("bad"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'INFERENCE_FAILED' WHEN value / 10 >= 8.35 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS final_status FROM events")
def decided_feed(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.decisions import Rules

    stream, at = _stream(spark, sf, ["event_id", "event_type", "value", "ts"])
    none = F.array().cast("array<struct<class_name:string,confidence:double>>")
    rows = stream.withColumns({"issues": F.array().cast("array<string>"), "regions": none, "score": F.col("value") / 10, "flag": F.lit(False), "failed": F.col("event_type") == "error"})
    each = R.decide_stream(rows, {k: k for k in ("issues", "regions", "score", "flag", "failed")}, Rules(), "event_id", "ts", f"{at}/out", f"{at}/audit")
    R.run(rows, f"{at}/checkpoint", each).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "final_status")
