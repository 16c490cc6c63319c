"""Queries on decisions, checks, reviews and the dashboard."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text, variants
from ..functions.text import iso_z
from ..operators import aggregates as A
from ..operators import checks as C
from ..operators import decisions as D
from ..operators import joins as J
from ..operators import windows as W
from ..operators import workflow as M
from ..sources import files, sinks, versions
from .registry import query
from .standins import ACTIONS, DECISION, DOCUMENTS, INSPECTIONS, LABELS, MODELS, actions, documents, inspections, label_texts, models, shared_folder, table


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return D.decide(inspections(spark, sf), **DECISION)


@query(f"WITH {INSPECTIONS} SELECT inspection_id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS requires_review, round(top, 6) AS max_confidence, status AS final_status FROM decided")
def decide(spark: SparkSession, sf: str) -> DataFrame:
    return decided(spark, sf).select("inspection_id", F.array_join("review_reasons", ",").alias("reasons"), "requires_review", F.round("max_confidence", 6).alias("max_confidence"), "final_status")


@query(f"WITH {INSPECTIONS} SELECT status AS final_status, count(*) AS n, round(avg(top), 6) AS mean_confidence FROM decided GROUP BY 1")
def decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    return decided(spark, sf).groupBy("final_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("max_confidence"), 6).alias("mean_confidence"))


@query(f"WITH {INSPECTIONS} SELECT coalesce(r, 'none') AS reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['none'] ELSE reasons END) AS r FROM decided) GROUP BY 1")
def reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    each = decided(spark, sf).select(F.explode_outer("review_reasons").alias("reason"))
    return A.class_distribution(each.select(F.coalesce("reason", F.lit("none")).alias("reason")), "reason")


MODE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'detection' WHEN '2-HIGH' THEN 'anomaly' WHEN '3-MEDIUM' THEN 'classical' ELSE 'hybrid' END"


@query(f"""WITH {INSPECTIONS}, moded AS (SELECT *, {MODE} AS mode, CASE WHEN {MODE} = 'detection' THEN 0 ELSE score END AS sc FROM inspections),
re AS (SELECT *, list_sort(list_distinct(list_filter([issue, CASE WHEN failed THEN 'INFERENCE_FAILED' END, CASE WHEN n > 0 AND top < 0.5 THEN 'YOLO_LOW_CONFIDENCE' END,
  CASE WHEN n = 0 AND sc >= 8.35 THEN 'YOLO_NONE_ANOMALY_HIGH' END, CASE WHEN n > 0 AND sc >= 8.35 THEN 'MODEL_CONFLICT_OR_UNKNOWN_ANOMALY' END,
  CASE WHEN risky THEN 'HIGH_RISK_DEFECT' END, CASE WHEN sc >= 8.35 THEN 'UNKNOWN_ANOMALY' END], lambda x: x IS NOT NULL))) AS reasons FROM moded)
SELECT inspection_id, mode, CASE WHEN mode = 'classical' THEN 'CLASSICAL_MODE_NOT_CONFIGURED_FOR_AUTO_PASS' ELSE array_to_string(reasons, ',') END AS reasons, (mode = 'classical' OR len(reasons) > 0) AS requires_review,
CASE WHEN mode = 'classical' THEN 'REVIEW_REQUIRED' WHEN mode = 'anomaly' AND len(reasons) = 0 THEN 'PASS' WHEN list_contains(reasons, 'CORRUPT_IMAGE') THEN 'IMAGE_QUALITY_FAILED' WHEN failed THEN 'INFERENCE_FAILED'
  WHEN len(reasons) > 0 THEN 'REVIEW_REQUIRED' WHEN n > 0 THEN 'DEFECT' WHEN sc >= 8.35 THEN 'ANOMALY' ELSE 'PASS' END AS final_status FROM re""")
def decide_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    df = inspections(spark, sf).withColumn("mode", F.expr(MODE))
    return D.apply_mode(df, "mode", **DECISION).select("inspection_id", "mode", F.array_join("review_reasons", ",").alias("reasons"), "requires_review", "final_status")


@query(f"""WITH {INSPECTIONS} SELECT inspection_id, CASE WHEN n > 0 THEN list_filter(regions, lambda x: x.c = top)[1].k WHEN status = 'ANOMALY' THEN 'unknown_anomaly' WHEN status = 'PASS' THEN 'normal' END AS predicted_class FROM decided""")
def predicted_classes(spark: SparkSession, sf: str) -> DataFrame:
    return decided(spark, sf).select("inspection_id", D.predicted_class(F.col("regions"), F.col("flag"), F.col("final_status")).alias("predicted_class"))


@query("""SELECT o_orderkey, coalesce(array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'YOLO_FAILED: ' || o_orderpriority END, CASE WHEN o_orderkey % 5 = 0 THEN 'ANOMALY_FAILED: ' || o_orderstatus END], lambda x: x IS NOT NULL), '; '), '') AS errors,
(o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AS inference_failed FROM orders""")
def folded_errors(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("y", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority"))).withColumn("a", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")))
    return D.fold_errors(o, {"yolo": "y", "anomaly": "a"}).select("o_orderkey", F.array_join("errors", "; ").alias("errors"), "inference_failed")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS name FROM pages), s AS (SELECT *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS suffix FROM p)
SELECT page_id, suffix, CASE WHEN suffix NOT IN ('.html', '.png') THEN 'UNSUPPORTED_IMAGE_FORMAT' END AS issue FROM s""")
def extension_check(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_by_extension(table(spark, sf, "pages"), "url", (".html", ".png")).select("page_id", "suffix", "issue")


def image_measures(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    share = lambda m: F.pmod(F.col("n_chars") * m, F.lit(101)) / 100
    return d.select("doc_id", F.col("n_chars").alias("width"), F.pmod("n_chars", F.lit(500)).alias("height"), (F.col("n_chars") / 20).alias("blur"), share(7).alias("bright"), share(13).alias("dark"))


MEASURES = "m AS (SELECT doc_id, n_chars AS width, n_chars % 500 AS height, n_chars / 20 AS blur, ((n_chars * 7) % 101) / 100 AS bright, ((n_chars * 13) % 101) / 100 AS dark FROM documents)"


@query(f"""WITH {MEASURES}, i AS (SELECT doc_id, list_filter([CASE WHEN width < 64 OR height < 64 THEN 'RESOLUTION_TOO_SMALL' END, CASE WHEN blur < 30 THEN 'BLURRY_IMAGE' END,
CASE WHEN bright >= 0.85::DOUBLE THEN 'OVEREXPOSED_IMAGE' END, CASE WHEN dark >= 0.85::DOUBLE THEN 'UNDEREXPOSED_IMAGE' END], lambda x: x IS NOT NULL) AS issues FROM m)
SELECT doc_id, array_to_string(issues, ',') AS issues, len(issues) = 0 AS valid FROM i""")
def image_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return C.quality_gate(image_measures(spark, sf), "width", "height", "blur", "bright", "dark").select("doc_id", F.array_join("issues", ",").alias("issues"), "valid")


@query(f"""WITH {MEASURES} SELECT doc_id AS path, 'BLURRY_IMAGE' AS code, round(blur, 4) AS value FROM m WHERE blur < 80 UNION ALL
SELECT doc_id, 'OVEREXPOSED_IMAGE', round(bright, 4) FROM m WHERE bright >= 0.8::DOUBLE UNION ALL SELECT doc_id, 'UNDEREXPOSED_IMAGE', round(dark, 4) FROM m WHERE dark >= 0.8::DOUBLE""")
def exposure_scan(spark: SparkSession, sf: str) -> DataFrame:
    return C.exposure_issues(image_measures(spark, sf), "doc_id", "blur", "bright", "dark")


OUT = "(w <= 0 OR h <= 0 OR cx - w / 2 < 0 OR cy - h / 2 < 0 OR cx + w / 2 > 1 OR cy + h / 2 > 1)"


@query(f"""WITH {LABELS}, t AS (SELECT *, CASE WHEN kind = 'nan' THEN false ELSE {OUT} END AS outside, CASE WHEN kind = 'nan' THEN 0.1::DOUBLE ELSE w END AS ww, CASE WHEN kind = 'nan' THEN 0.1::DOUBLE ELSE h END AS hh FROM lines),
i AS (SELECT *, CASE WHEN kind = 'bad' THEN ['MALFORMED_ANNOTATION'] ELSE list_filter([CASE WHEN cls NOT BETWEEN 0 AND 5 THEN 'INVALID_CLASS' END, CASE WHEN outside THEN 'OUT_OF_BOUNDS_BOX' END,
  CASE WHEN NOT outside AND (ww * 100 < 4 OR hh * 100 < 4 OR ww * 100 * (hh * 100) < 16) THEN 'TINY_BOX' END], lambda x: x IS NOT NULL) END AS issues FROM t)
SELECT array_to_string(issues, ',') AS issues, (kind <> 'bad' AND cls BETWEEN 0 AND 5) AS counted, count(*) AS n FROM i GROUP BY 1, 2""")
def label_line_issues(spark: SparkSession, sf: str) -> DataFrame:
    lines = label_texts(spark, sf).withColumn("width", F.lit(100)).withColumn("height", F.lit(100))
    out = C.label_issues(lines, "value", "width", "height", 6)
    return out.groupBy(F.array_join("issues", ",").alias("issues"), "counted").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LABELS} SELECT CASE WHEN kind = 'bad' THEN 'MALFORMED_LABEL' WHEN cls NOT BETWEEN 0 AND 5 THEN 'INVALID_CLASS' WHEN kind = 'ok' AND {OUT} THEN 'OUT_OF_BOUNDS_BOX' ELSE 'valid' END AS error, count(*) AS n FROM lines GROUP BY 1""")
def label_validation(spark: SparkSession, sf: str) -> DataFrame:
    out = C.validate_labels(label_texts(spark, sf), "value", 6)
    return A.class_distribution(out.select(F.coalesce("error", F.lit("valid")).alias("error")), "error")


@query("""SELECT l_orderkey, count(*) AS n, max(line) AS last_line FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS line FROM lineitem) GROUP BY 1""")
def label_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Whole label texts, with blank lines between, cut into lines again."""
    texts = label_texts(spark, sf).groupBy("l_orderkey").agg(F.concat_ws("\n \n", F.array_sort(F.collect_list("value"))).alias("text"))
    return C.scan_label_lines(texts, "text").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("line").cast("long").alias("last_line"))


VOC_ROWS = """voc AS (SELECT l_orderkey, l_linenumber, l_returnflag AS name, round(l_quantity * 10) AS xmin, round(l_discount * 1000) AS ymin, round(l_quantity * 10 + l_tax * 1000 - 20) AS xmax, round(l_discount * 1000 + 40) AS ymax,
  l_orderkey % 13 = 0 AS broken, CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE 500 END AS width FROM lineitem)"""


def voc_texts(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem")
    r = lambda c: F.round(c).cast("int").cast("string")
    xml = F.concat(F.lit("<annotation><filename>"), F.col("l_orderkey").cast("string"), F.lit("</filename><size><width>"), F.when(F.col("l_orderkey") % 17 == 0, "0").otherwise("500"), F.lit("</width><height>400</height><depth>3</depth></size><object><name>"),
        F.col("l_returnflag"), F.lit("</name><bndbox><xmin>"), r(F.col("l_quantity") * 10), F.lit("</xmin><ymin>"), r(F.col("l_discount") * 1000), F.lit("</ymin><xmax>"), r(F.col("l_quantity") * 10 + F.col("l_tax") * 1000 - 20), F.lit("</xmax><ymax>"),
        r(F.col("l_discount") * 1000 + 40), F.lit("</ymax></bndbox></object></annotation>"))
    return i.select("l_orderkey", F.when(F.col("l_orderkey") % 13 == 0, "<annotation><filename>x</file").otherwise(xml).alias("xml"))


@query(f"""WITH {VOC_ROWS}, known AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(error, 'valid') AS error, count(*) AS n FROM (SELECT CASE WHEN broken THEN 'INVALID_XML' WHEN k.o_orderkey IS NULL THEN 'IMAGE_NOT_FOUND' WHEN width <= 0 THEN 'INVALID_IMAGE_SIZE' WHEN name NOT IN ('A', 'N') THEN 'UNKNOWN_CLASS'
  WHEN xmax <= xmin OR ymax <= ymin THEN 'INVALID_BOX' WHEN xmin < 0 OR ymin < 0 OR xmax > width OR ymax > 400 THEN 'OUT_OF_BOUNDS_BOX' END AS error FROM voc LEFT JOIN known k ON l_orderkey = k.o_orderkey) GROUP BY 1""")
def voc_annotation_issues(spark: SparkSession, sf: str) -> DataFrame:
    objects = files.parse_voc(voc_texts(spark, sf), "xml")
    known = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("filename"))
    out = C.voc_issues(objects, known, ("A", "N"))
    return A.class_distribution(out.select(F.coalesce("error", F.lit("valid")).alias("error")), "error")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR octet_length(encode(text)) > 4000 OR octet_length(encode(text)) = 0 OR doc_id % 7 = 0 THEN 'INVALID_IMAGE' END AS error FROM documents""")
def upload_check(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("f"), "doc_id", F.lit(".txt"))).otherwise(F.concat(F.lit("f"), "doc_id", F.lit(".PNG")))
    content = F.when(F.col("doc_id") % 7 == 0, F.lit("***")).otherwise(F.base64(F.encode("text", "UTF-8")))
    return C.decode_upload(d.select("doc_id", name.alias("name"), content.alias("content")), "name", "content", 4000).select("doc_id", "error")


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice < 5000 THEN 'o_totalprice:min' END, CASE WHEN o_totalprice > 400000 THEN 'o_totalprice:max' END, CASE WHEN length(o_orderpriority) > 8 THEN 'o_orderpriority:max_length' END,
CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus:one_of' END, CASE WHEN o_custkey > o_orderkey THEN 'o_custkey:at_most' END], lambda x: x IS NOT NULL), ',') AS violations FROM orders""")
def constraint_check(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("o_totalprice", "min", 5000), ("o_totalprice", "max", 400000), ("o_orderpriority", "max_length", 8), ("o_orderstatus", "one_of", ("F", "O")), ("o_custkey", "at_most", "o_orderkey")]
    return C.check_constraints(table(spark, sf, "orders"), rules).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND contains(lower(concat_ws(' ', c_name, o_orderpriority)), 'urgent')")
def record_search(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return C.search(o, "F", "URGENT", ["c_name", "o_orderpriority"], None, "o_orderstatus").select("o_orderkey", "c_name")


@query(f"WITH {INSPECTIONS} SELECT inspection_id FROM decided WHERE status = 'REVIEW_REQUIRED' AND contains(lower(array_to_string(reasons, ' ')), 'anomaly')")
def review_search(spark: SparkSession, sf: str) -> DataFrame:
    return C.search_reviews(decided(spark, sf), "REVIEW_REQUIRED", "anomaly", "final_status").select("inspection_id")


@query("""WITH f AS (SELECT doc_id, source, CASE WHEN doc_id % 9 = 0 THEN '.hidden/' ELSE 'a/' END || (doc_id % 300) || CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.png' END AS path, n_chars FROM documents),
k AS (SELECT *, (doc_id % 9 <> 0 AND doc_id % 4 <> 0) AS image FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY source, image, path ORDER BY doc_id) AS nth FROM k),
p AS (SELECT *, sum(CASE WHEN image AND nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS place FROM n)
SELECT doc_id, CASE WHEN NOT image THEN 'ignored' WHEN nth > 1 THEN 'duplicated' WHEN place > 8 THEN 'limited' ELSE 'accepted' END AS outcome, n_chars > 5000 AS oversize FROM p""")
def batch_admission(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    path = F.concat(F.when(F.col("doc_id") % 9 == 0, ".hidden/").otherwise("a/"), (F.col("doc_id") % 300).cast("string"), F.when(F.col("doc_id") % 4 == 0, ".txt").otherwise(".png"))
    d = d.select("doc_id", "source", "n_chars", path.alias("path"), F.lit(1).alias("size"), F.lit(1).alias("mtime"))
    out = C.admit_batch(d, "path", "size", "mtime", ["doc_id"], cap=8, batch="source")
    return out.select("doc_id", "outcome", (F.col("n_chars") > 5000).alias("oversize"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, round(o_totalprice / 1000, 6) AS thousands FROM orders")
def record_list(spark: SparkSession, sf: str) -> DataFrame:
    return C.project(table(spark, sf, "orders"), {"id": "o_orderkey", "status": "o_orderstatus", "thousands": "round(o_totalprice / 1000, 6)"})


@query(f"WITH {MODELS} SELECT model_id, version FROM models WHERE model_type = 'Brand#11'")
def models_of_type(spark: SparkSession, sf: str) -> DataFrame:
    return C.of_type(models(spark, sf), "Brand#11").select("model_id", "version")


@query(f"""WITH {INSPECTIONS}, d AS (SELECT *, o_orderdate::DATE = DATE '1995-06-01' AS today FROM decided)
SELECT count(*) FILTER (today) AS today, count(*) FILTER (today AND status IN ('DEFECT', 'ANOMALY')) AS defects, round(count(*) FILTER (today AND status IN ('DEFECT', 'ANOMALY')) / greatest(count(*) FILTER (today), 1), 6) AS defect_rate,
count(*) FILTER (today AND status = 'PASS') AS auto_pass, count(*) FILTER (today AND len(reasons) > 0) AS pending, count(*) FILTER (today AND status = 'REVIEW_REQUIRED' AND len(reasons) = 0) AS reviewed,
round(coalesce(avg(score) FILTER (today AND score <> 0), 0), 6) AS mean_latency, (SELECT string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)) AS distribution FROM d""")
def dashboard_overview(spark: SparkSession, sf: str) -> DataFrame:
    out = A.overview(decided(spark, sf), "1995-06-01", "o_orderdate", "final_status", "review_reasons", "score", "o_orderstatus")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("distribution")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("today", "defects", F.round("defect_rate", 6).alias("defect_rate"), "auto_pass", "pending", "reviewed", F.round("mean_latency", 6).alias("mean_latency"), told.alias("distribution"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def latest_inspections(spark: SparkSession, sf: str) -> DataFrame:
    return W.latest(table(spark, sf, "orders"), "o_orderdate", "o_orderkey", 200).select("o_orderkey", iso_z(F.col("o_orderdate")).alias("created"))


@query(f"WITH {INSPECTIONS} SELECT inspection_id, array_to_string(reasons, ',') AS reasons FROM decided WHERE len(reasons) > 0 ORDER BY o_orderdate DESC, inspection_id LIMIT 100")
def latest_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return W.latest(decided(spark, sf).where("requires_review"), "o_orderdate", "inspection_id", 100).select("inspection_id", F.array_join("review_reasons", ",").alias("reasons"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10")
def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    return W.latest(table(spark, sf, "events"), "ts", "event_id", 10).select("event_id", "event_type")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part")
def newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """The whole list, newest first, with its place; places come from range partitions."""
    rows = table(spark, sf, "part").select("p_partkey", (-F.col("p_size")).alias("minus"))
    return W.numbered(rows, ["minus", "p_partkey"]).select("p_partkey", (F.col("at") + 1).alias("place"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def table_page(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_table(spark, sf, "orders", ["o_totalprice", "o_orderkey"], 100, 50).select("o_orderkey")


@query(f"WITH {MEASURES}, i AS (SELECT 1 AS phase, doc_id, 'BLURRY_IMAGE' AS code FROM m WHERE blur < 80 UNION ALL SELECT 2, doc_id, 'OVEREXPOSED_IMAGE' FROM m WHERE bright >= 0.8::DOUBLE) SELECT phase, doc_id, code FROM i ORDER BY phase, doc_id, code LIMIT 200")
def capped_issues(spark: SparkSession, sf: str) -> DataFrame:
    i = C.exposure_issues(image_measures(spark, sf), "doc_id", "blur", "bright", "dark").where("code <> 'UNDEREXPOSED_IMAGE'")
    return W.cap_issues(i.select(F.when(F.col("code") == "BLURRY_IMAGE", 1).otherwise(2).alias("phase"), F.col("path").alias("doc_id"), "code"), ["phase", "doc_id", "code"])


@query("SELECT event_id, round(value, 6) AS value FROM events WHERE value IS NOT NULL ORDER BY value, event_id LIMIT 1")
def best_event(spark: SparkSession, sf: str) -> DataFrame:
    return W.best_row(table(spark, sf, "events").select("event_id", "value"), "value", ["event_id"]).select("event_id", F.round("value", 6).alias("value"))


@query(f"WITH {INSPECTIONS} SELECT 'review-' || inspection_id AS review_id, inspection_id, 'pending' AS status, array_to_string(reasons, ',') AS reasons FROM decided WHERE len(reasons) > 0")
def opened_reviews(spark: SparkSession, sf: str) -> DataFrame:
    d = decided(spark, sf).withColumn("predicted_class", D.predicted_class(F.col("regions"), F.col("flag"), F.col("final_status")))
    return M.open_reviews(d).select("review_id", "inspection_id", "status", F.array_join("review_reasons", ",").alias("reasons"))


REVIEWED = f"""WITH {ACTIONS}, reviews AS (SELECT DISTINCT user_id AS review_id FROM events WHERE user_id % 10 <> 3), ranked AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ts, action_id) AS nth FROM actions)"""


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("user_id % 10 <> 3").select(F.col("user_id").alias("review_id"), F.lit("pending").alias("status")).distinct()


@query(REVIEWED + """ SELECT r.review_id, CASE a.action WHEN 'approve' THEN 'approved' WHEN 'correct' THEN 'corrected' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status, a.action_id AS decided_by
FROM reviews r LEFT JOIN ranked a ON a.review_id = r.review_id AND nth = 1""")
def finalized_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return M.finalize_reviews(_reviews(spark, sf), actions(spark, sf))[0].select("review_id", "status", "decided_by")


@query(REVIEWED + """ SELECT action_id, CASE WHEN r.review_id IS NULL THEN 'REVIEW_NOT_FOUND' ELSE 'REVIEW_STATE_CONFLICT' END AS error FROM ranked a LEFT JOIN reviews r ON a.review_id = r.review_id WHERE r.review_id IS NULL OR nth > 1""")
def refused_actions(spark: SparkSession, sf: str) -> DataFrame:
    return M.finalize_reviews(_reviews(spark, sf), actions(spark, sf))[1].select("action_id", "error")


@query(f"""WITH {INSPECTIONS} SELECT inspection_id, CASE WHEN inspection_id % 4 = 0 THEN 'relabelled' WHEN n > 0 THEN list_filter(regions, lambda x: x.c = top)[1].k WHEN status = 'PASS' THEN 'normal' ELSE 'unknown' END AS label, n AS boxes FROM decided WHERE inspection_id % 3 = 0""")
def feedback_samples(spark: SparkSession, sf: str) -> DataFrame:
    d = decided(spark, sf).withColumn("predicted_class", D.predicted_class(F.col("regions"), F.col("flag"), F.col("final_status")))
    k = F.col("inspection_id")
    reviews = d.select(k.alias("review_id"), "inspection_id", F.when(k % 3 == 0, "corrected").otherwise("approved").alias("status"), F.when(k % 4 == 0, "relabelled").otherwise("").alias("corrected_label"), F.lit(None).cast(d.schema["regions"].dataType).alias("corrected_boxes"))
    return M.make_feedback(reviews, d).select("inspection_id", "label", F.size("boxes").cast("long").alias("boxes"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem")
    c = F.struct(F.lit(0.0).alias("x1"), (F.col("l_discount")).alias("y1"), F.lit(0.5).alias("x2"), (F.col("l_discount") + 0.4).alias("y2"), F.col("l_returnflag").alias("class_name"))
    rows = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", c.alias("c")))).alias("_r"))
    return rows.select(F.col("l_orderkey").alias("review_id"), F.when(F.col("l_orderkey") % 2 == 0, "normal").otherwise("defect").alias("label"), F.transform("_r", lambda x: x["c"]).alias("boxes"), F.when(F.col("l_orderkey") % 5 == 0, "exported").otherwise("pending").alias("export_status"), F.concat(F.lit("m"), (F.col("l_orderkey") % 3).cast("string")).alias("model_version"))


@query("""WITH b AS (SELECT l_orderkey AS review_id, l_returnflag AS cls, l_discount AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS box FROM lineitem WHERE l_orderkey % 5 <> 0),
f AS (SELECT cls, row_number() OVER (ORDER BY min({'r': review_id, 'b': box})) - 1 AS class_id FROM b GROUP BY cls)
SELECT review_id, box, b.cls, class_id, printf('%d %.6f %.6f %.6f %.6f', class_id, 0.5::DOUBLE, (d + 0.5::DOUBLE), 1.0::DOUBLE, 1.0::DOUBLE) AS line FROM b JOIN f USING (cls)""")
def exported_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label lines of pending feedback; boxes smaller than a pixel grow to one, as all of these do."""
    versions = spark.createDataFrame([("v0",)], "version string")
    error, lines, _ = M.export_feedback(_samples(spark, sf), versions, "v1", ["review_id"])
    if error:
        raise ValueError(error)
    return lines.select("review_id", F.col("box").cast("long").alias("box"), "cls", F.col("class_id").cast("long").alias("class_id"), "line")


@query("""WITH s AS (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'normal' ELSE 'defect' END AS label FROM lineitem GROUP BY 1)
SELECT 'v1' AS dataset_version, count(*) AS sample_count, (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM s GROUP BY 1)) AS classes, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT 'm' || l_orderkey % 3 AS m FROM s)) AS models FROM s""")
def export_manifest(spark: SparkSession, sf: str) -> DataFrame:
    told = F.array_join(F.transform(F.array_sort(F.map_entries("class_distribution")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return sinks.manifest(_samples(spark, sf), "v1", "operator").select("dataset_version", "sample_count", told.alias("classes"), F.array_join("source_model_versions", ",").alias("models"))


@query(f"""WITH {MODELS}, e AS (SELECT DISTINCT model_name, version FROM models WHERE model_id % 10 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY model_name, version ORDER BY model_id) AS nth FROM models WHERE model_id % 10 <> 0)
SELECT model_id, CASE WHEN nth > 1 OR EXISTS (SELECT 1 FROM e WHERE e.model_name = n.model_name AND e.version = n.version) THEN 'conflict' ELSE 'accepted' END AS outcome FROM n""")
def registered_versions(spark: SparkSession, sf: str) -> DataFrame:
    m = models(spark, sf)
    good, bad = M.register(m.where("model_id % 10 = 0"), m.where("model_id % 10 <> 0"), ["model_name", "version"], ["model_id"])
    return good.select("model_id", F.lit("accepted").alias("outcome")).unionByName(bad.select("model_id", F.lit("conflict").alias("outcome")))


@query(f"""WITH {MODELS}, a AS (SELECT 1 + event_id % (SELECT count(*) FROM part) AS model_id, ts, event_id FROM events WHERE event_type = 'signup'), w AS (SELECT model_type, arg_max(a.model_id, {{'t': ts, 'e': event_id}}) AS winner FROM a JOIN models USING (model_id) GROUP BY 1)
SELECT model_id, CASE WHEN winner IS NULL THEN active ELSE model_id = winner END AS active FROM models LEFT JOIN w USING (model_type)""")
def activated_models(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    a = table(spark, sf, "events").where("event_type = 'signup'").join(F.broadcast(n), F.lit(True)).select((1 + F.col("event_id") % F.col("n")).alias("model_id"), "ts", F.col("event_id").alias("activation_id"))
    return M.activate(models(spark, sf), a).select("model_id", "active")


@query("SELECT coalesce(n.k, e.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.size ELSE e.size END AS size FROM (SELECT p_partkey AS k, p_size AS size FROM part WHERE p_partkey % 3 <> 0) e FULL JOIN (SELECT p_partkey AS k, p_size + 100 AS size FROM part WHERE p_partkey % 2 = 0) n ON e.k = n.k")
def upserted_models(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    return M.upsert(p.where("k % 3 <> 0"), p.where("k % 2 = 0").withColumn("size", F.col("size") + 100), ["k"])


@query("SELECT DISTINCT p_name, p_size FROM part a WHERE p_partkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 3 <> 0 AND a.p_name = b.p_name AND a.p_size = b.p_size)")
def inserted_seeds(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return M.insert_absent(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 = 0"), ["p_name", "p_size"]).select("p_name", "p_size")


@query("""WITH seen AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
first AS (SELECT coalesce(k, c_custkey) AS k, coalesce(n, c_nationkey) AS n FROM (SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer) FULL JOIN seen ON c_custkey = k)
SELECT k, n, 3 AS version FROM first UNION ALL SELECT -1 - s_suppkey, s_nationkey, 3 FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 1 FROM customer""")
def changed_table(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a table of buckets, changed by their orders and then by suppliers that it lacks; its last and first version."""
    root = f"{shared_folder(spark)}/changed-{uuid.uuid4().hex}"
    rows = lambda name, k, n: table(spark, sf, name).select(F.expr(k).cast("long").alias("k"), F.expr(n).cast("long").alias("n"))
    customers = rows("customer", "c_custkey", "c_nationkey")
    versions.create_table(customers, root, ["k"], 16)
    versions.change_table(table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), root, ["k"])
    both = customers.unionByName(rows("supplier", "-1 - s_suppkey", "s_nationkey"))
    last = versions.change_table(both, root, ["k"], replace=False)
    at = lambda v: versions.read_version(spark, root, v).withColumn("version", F.lit(v))
    return at(last).unionByName(at(1))


@query("SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY 1")
def current_states(spark: SparkSession, sf: str) -> DataFrame:
    return M.current_state(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


KEYED = "k AS (SELECT event_id, ts, CASE WHEN event_type = 'view' THEN NULL ELSE user_id || '-' || strftime(ts, '%Y-%m-%d') END AS key FROM events)"


@query(f"WITH {KEYED} SELECT event_id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS nth FROM k) WHERE key IS NULL OR nth = 1 AND key NOT LIKE '7-%'")
def idempotent_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_type") != "view", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd"))).alias("key"))
    return W.first_by_key(e, "key", ["ts", "event_id"], e.where("key LIKE '7-%'").select("key").distinct()).select("event_id", "key")


@query("SELECT 'event.' || event_type AS action, event_id::VARCHAR AS entity_id, user_id::VARCHAR AS operator, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events")
def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return sinks.audit_rows(e, F.concat(F.lit("event."), "event_type"), F.col("event_id"), F.col("user_id"), iso_z(F.col("ts")))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def workflow_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.state_counts(table(spark, sf, "orders"), "o_orderstatus")


@query("""SELECT e.user_id AS review_id, o.o_orderstatus, count(*) AS n, arg_min(e.event_id, {'t': e.ts, 'e': e.event_type, 'i': e.event_id}) IS NOT NULL AS has_first, count(DISTINCT e.event_type) AS kinds
FROM events e JOIN orders o ON o.o_orderkey = e.user_id GROUP BY 1, 2""")
def review_history(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = table(spark, sf, "orders").select(F.concat(F.lit("i"), "o_orderkey").alias("inspection_id"), "o_orderkey", "o_orderstatus")
    reviews = e.select(F.col("user_id").alias("key")).distinct().select(F.concat(F.lit("r"), "key").alias("review_id"), F.concat(F.lit("i"), "key").alias("inspection_id"))
    logs = e.select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r"), "user_id")).otherwise(F.concat(F.lit("i"), "user_id")).alias("entity_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    out = J.review_detail(reviews, i, logs)
    return out.select(F.col("o_orderkey").alias("review_id"), "o_orderstatus", F.size("history").cast("long").alias("n"), F.col("history")[0].isNotNull().alias("has_first"), F.size(F.array_distinct(F.transform("history", lambda x: x["action"]))).cast("long").alias("kinds"))


@query("""SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, replace(lower(trim(source || ' ' || lang)), ' ', '_') AS cls, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS language FROM documents""")
def document_scalars(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", hashing.content_hash(F.col("text")).alias("md5"), hashing.content_hash(F.col("text"), "sha256").alias("sha256"), text.canonical_class(F.concat_ws(" ", "source", "lang")).alias("cls"), text.label_of(F.col("lang"), {"en": "English", "de": "German"}).alias("language"))


@query("""SELECT event_id, 'sim-' || substr(sha256('b|' || event_type || '|' || user_id || '|' || event_id), 1, 32) AS key, 'b-' || lpad(event_id::VARCHAR, greatest(3, length(event_id::VARCHAR))::INT, '0') AS place, CASE WHEN floor(value) <= 1 THEN printf('%.1f%%', floor(value) * 100) ELSE printf('%.1f%%', floor(value)) END AS shown FROM events""")
def event_scalars(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    key = hashing.stable_key(F.lit("b"), F.col("event_type"), F.col("user_id"), F.col("event_id"))
    place = F.regexp_extract(hashing.batch_row_key(F.lit("b"), F.col("event_id"), F.col("event_type")), "^(b-[0-9]+)-", 1)
    return e.select("event_id", key.alias("key"), place.alias("place"), text.percent_text(F.floor("value").cast("double")).alias("shown"))


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events")
def report_numbers(spark: SparkSession, sf: str) -> DataFrame:
    r = files.parse_reports(table(spark, sf, "events").select("event_id", "props"), "props")
    return r.select("event_id", variants.tolerant_number(F.col("report"), "$.missing", "$.k").alias("k"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'k: ' || o_custkey || ' / n: ' || o_orderkey AS shown, o_totalprice AS total FROM orders")
def order_scalars(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    m = F.create_map(F.lit("n"), F.col("o_orderkey"), F.lit("k"), F.col("o_custkey"))
    return o.select("o_orderkey", text.utc_day(F.col("o_orderdate")).cast("string").alias("day"), text.map_text(m).alias("shown"), text.total_ms(F.create_map(F.lit("a"), "o_totalprice", F.lit("b"), F.lit(float("nan")))).alias("total"))
