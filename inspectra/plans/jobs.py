"""Queries on whole jobs: each runs one of the composites and shows what it gives as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import EDGES, box, to_pixels
from ..functions.hashing import rolling_hash36
from ..operators import composites as X
from .dataset import BENCH, IOU, KEY, NUM, REPORT
from .inspection import MEASURES, decided, image_measures
from .registry import query
from .standins import ACTIONS, BOXES, DOCUMENTS, INSPECTIONS, ORDER, VECTORS, actions, boxes, documents, inspections, table, vectors


def shown(*parts: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    """Rows (part, key, value) of several tables; values are doubles of 6 places."""
    each = [df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), F.round(value.cast("double"), 6).alias("value")) for part, df, key, value in parts]
    return reduce(lambda a, b: a.unionByName(b), each)


def _labels(spark: SparkSession, sf: str, bad: str) -> DataFrame:
    """Labels of documents as label texts: of low quality ones `bad`, else a box of class 0, or 9 for toxic ones."""
    d = documents(spark, sf).select("doc_id", "split")
    text = F.when(F.col("quality") == 0, bad).otherwise(F.concat((F.col("toxic") * 9).cast("string"), F.lit(" 0.5 0.5 0.1 0.1")))
    return table(spark, sf, "labels").join(d, "doc_id").select("split", F.col("doc_id").cast("string").alias("stem"), text.alias("text"))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as images; the hashes of an even document and the next one differ in a bit."""
    pair = F.md5(F.floor(F.col("doc_id") / 2).cast("long").cast("string"))
    dhash = F.conv(F.substring(pair, 1, 15), 16, 10).cast("long").bitwiseXOR(F.col("doc_id") % 2)
    d = documents(spark, sf).select("doc_id", "split", F.col("hash").alias("md5"), F.col("lang").alias("class"), dhash.alias("dhash"))
    stem = F.col("doc_id").cast("string")
    return image_measures(spark, sf).join(d, "doc_id").withColumns({"stem": stem, "path": F.concat(stem, F.lit(".png"))})


NEAR = """hashed AS (SELECT doc_id, split, hash, xor(('0x' || substr(md5((doc_id // 2)::VARCHAR), 1, 15))::BIGINT, doc_id % 2) AS d FROM images),
near AS (SELECT a.split AS s1, b.split AS s2 FROM hashed a JOIN hashed b ON a.doc_id < b.doc_id AND a.hash <> b.hash WHERE bit_count(xor(a.d, b.d)) <= 4)"""
TINY = "0.1::DOUBLE * width < 4 OR 0.1::DOUBLE * height < 4 OR 0.1::DOUBLE * width * (0.1::DOUBLE * height) < 16"


@query(f"""WITH {DOCUMENTS}, {MEASURES}, {NEAR}, x AS (SELECT 'BLURRY_IMAGE' AS code FROM m WHERE blur < 80 UNION ALL SELECT 'OVEREXPOSED_IMAGE' FROM m WHERE bright >= 0.8::DOUBLE UNION ALL SELECT 'UNDEREXPOSED_IMAGE' FROM m WHERE dark >= 0.8::DOUBLE
UNION ALL SELECT 'MISSING_ANNOTATION' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'EMPTY_ANNOTATION' FROM labels WHERE quality = 0
UNION ALL SELECT 'INVALID_CLASS' FROM labels WHERE quality = 1 AND toxic = 1 UNION ALL SELECT 'TINY_BOX' FROM labels JOIN m USING (doc_id) WHERE quality = 1 AND ({TINY})
UNION ALL SELECT 'EXACT_DUPLICATE' FROM (SELECT row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS nth FROM images) WHERE nth > 1
UNION ALL SELECT 'SPLIT_LEAKAGE' FROM (SELECT count(*) OVER (PARTITION BY hash) - count(*) OVER (PARTITION BY hash, split) AS links FROM images) WHERE links > 0
UNION ALL SELECT 'NEAR_DUPLICATE' FROM near UNION ALL SELECT 'POTENTIAL_SPLIT_LEAKAGE' FROM near WHERE s1 <> s2)
SELECT 'issues' AS part, code AS key, count(*)::DOUBLE AS value FROM x GROUP BY code UNION ALL SELECT 'classes', '0', count(*) FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT 'summary', 'invalid_annotation_count', count(*) FROM x WHERE code IN ('MISSING_ANNOTATION', 'EMPTY_ANNOTATION', 'INVALID_CLASS', 'TINY_BOX')
UNION ALL SELECT 'sizes', 'width_mean', round(avg(width), 2) FROM m""")
def scan_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = X.scan_quality(_images(spark, sf), _labels(spark, sf, " "), 6)
    counts = out["issues"].groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return shown(
        ("issues", counts, F.col("code"), F.col("n")), ("classes", out["classes"], F.col("class_id"), F.col("n")),
        ("summary", out["summary"], F.lit("invalid_annotation_count"), F.col("invalid_annotation_count")), ("sizes", out["sizes"], F.lit("width_mean"), F.col("width_mean")),
    )


XML = """'<annotation><filename>' || p_partkey || '.png</filename><size><width>100</width><height>80</height><depth>3</depth></size><object><name>c' || (p_size % 4) || '</name><bndbox><xmin>' || p_size || '</xmin><ymin>1</ymin><xmax>' || (CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size + 20 END) || '</xmax><ymax>41</ymax></bndbox></object></annotation>'"""


@query("""WITH known AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 7), a AS (SELECT p_partkey || '.png' AS filename, p_size, p_size % 4 AS c, CASE WHEN p_partkey NOT IN (SELECT l_partkey FROM known) THEN 'IMAGE_NOT_FOUND' WHEN p_size % 4 = 3 THEN 'UNKNOWN_CLASS' WHEN p_partkey % 7 = 0 THEN 'INVALID_BOX' END AS error FROM part)
SELECT filename, 'label' AS kind, printf('%d %.6f %.6f %.6f %.6f', c, (p_size + p_size + 20) / 2 / 100, 21 / 80, 20 / 100, 40 / 80) AS value FROM a WHERE error IS NULL UNION ALL SELECT filename, 'invalid', error FROM a WHERE error IS NOT NULL UNION ALL SELECT filename, 'missing', NULL FROM a WHERE error = 'IMAGE_NOT_FOUND'""")
def convert_annotations(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "lineitem").where("l_linenumber = 7").select(F.concat(F.col("l_partkey").cast("string"), F.lit(".png")).alias("filename")).distinct()
    out = X.convert_annotations(table(spark, sf, "part").select(F.expr(XML).alias("xml")), "xml", known, ("c0", "c1", "c2"))
    labels = out["labels"].select("filename", F.lit("label").alias("kind"), F.col("text").alias("value"))
    invalid = out["invalid"].select("filename", F.lit("invalid").alias("kind"), F.col("error").alias("value"))
    return labels.unionByName(invalid).unionByName(out["missing"].select("filename", F.lit("missing").alias("kind"), F.lit(None).cast("string").alias("value")))


@query(f"""WITH {DOCUMENTS}, r AS (SELECT doc_id, hash, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY {KEY}, doc_id) AS nth FROM images WHERE doc_id IN (SELECT doc_id FROM labels)),
s AS (SELECT doc_id, hash, CASE WHEN nth <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN nth <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r)
SELECT doc_id, first_value(split) OVER (PARTITION BY hash ORDER BY doc_id) AS split FROM s""")
def prepare_splits(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select(F.col("doc_id").alias("path"), F.col("doc_id").alias("stem"), F.col("lang").alias("class"), F.col("hash").alias("md5"))
    out = X.prepare_splits(d, table(spark, sf, "labels").select(F.col("doc_id").alias("stem")))
    return out["splits"].select(F.col("path").alias("doc_id"), "split")


@query(f"""WITH {DOCUMENTS}, l AS (SELECT split, CASE WHEN quality = 0 THEN 'MALFORMED_LABEL' WHEN toxic = 1 THEN 'INVALID_CLASS' END AS code FROM labels JOIN images USING (doc_id)),
x AS (SELECT 'MISSING_LABEL' AS code, split FROM images WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT code, split FROM l WHERE code IS NOT NULL UNION ALL SELECT 'SPLIT_LEAKAGE', 'train' FROM images WHERE split = 'train' AND hash IN (SELECT hash FROM images WHERE split = 'val') UNION ALL SELECT 'MISSING_SPLIT', 'other')
SELECT code AS part, split AS key, count(*)::DOUBLE AS value FROM x GROUP BY 1, 2 UNION ALL SELECT 'summary', 'valid_boxes', count(*) FROM l WHERE code IS NULL""")
def validate_training_set(spark: SparkSession, sf: str) -> DataFrame:
    images = _images(spark, sf).select("path", "split", "stem", "md5")
    out = X.validate_training_set(images, _labels(spark, sf, "0 0.5 0.5"), 6, ("train", "val", "other"))
    counts = out["errors"].groupBy("code", "split").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counts.select(F.col("code").alias("part"), F.col("split").alias("key"), "value").unionByName(shown(("summary", out["summary"], F.lit("valid_boxes"), F.col("valid_boxes"))))


PLAIN = INSPECTIONS.replace("WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 0 THEN 'CORRUPT_IMAGE' ", "")


@query(f"""WITH {PLAIN}, f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY inspection_id) AS nth FROM decided)
SELECT inspection_id, array_to_string(reasons, ',') AS reasons, status AS final_status, len(reasons) > 0 AS opened FROM f WHERE nth = 1 OR o_orderstatus = 'P'""")
def inspect(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as requests; a customer's orders of one status share a key, those in status P have none."""
    i = inspections(spark, sf).drop("issues")
    one = F.lit(100)
    key = F.when(F.col("o_orderstatus") != "P", F.concat_ws("-", "o_custkey", "o_orderstatus"))
    blur = F.when(F.col("o_orderpriority") == "5-LOW", 10.0).otherwise(90.0)
    i = i.withColumns({"key": key, "mode": F.lit("hybrid"), "width": one, "height": one, "blur": blur, "bright": F.lit(0.0), "dark": F.lit(0.0), "why": F.when(F.col("failed"), "broken")})
    # the reason of a failed step is INFERENCE_FAILED, as for inspections that failed as a whole
    out = X.inspect(i, {"detector": "why"}, ["inspection_id"])
    opened = out["reviews"].select("inspection_id", F.lit(True).alias("opened"))
    return out["inspections"].join(opened, "inspection_id", "left").select("inspection_id", F.array_join("review_reasons", ",").alias("reasons"), "final_status", F.coalesce("opened", F.lit(False)).alias("opened"))


@query(f"""WITH {ACTIONS}, f AS (SELECT review_id, arg_min(action, {{'t': ts, 'a': action_id}}) AS action, count(*) AS tries FROM actions GROUP BY 1), u AS (SELECT user_id AS review_id, count(*) AS entries, arg_max(event_type, {{'t': ts, 'a': event_type}}) AS last_entry FROM events GROUP BY 1)
SELECT review_id, CASE action WHEN 'approve' THEN 'approved' WHEN 'correct' THEN 'corrected' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status, coalesce(tries - 1, 0) AS refused, CASE WHEN action = 'correct' THEN (CASE WHEN review_id % 3 = 0 THEN 'normal' ELSE 'c' || (review_id % 3) END) END AS label,
CASE WHEN action <> 'correct' OR action IS NULL THEN NULL WHEN review_id % 3 = 2 THEN 'dent,scratch' WHEN review_id % 5 = 0 THEN 'seen' WHEN review_id % 3 = 1 THEN 'c1' END AS classes,
CASE WHEN action <> 'correct' OR action IS NULL THEN 0 WHEN review_id % 3 = 2 THEN 2 WHEN review_id % 5 = 0 OR review_id % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS lines, CASE WHEN action = 'correct' THEN 'exported' END AS export_status, entries, last_entry FROM u LEFT JOIN f USING (review_id)""")
def review_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Users as reviews, their events as actions and as entries of the log. Corrected ones get a label from their id; every
    third has boxes of its own, one of them normal, every fifth else the regions that were seen."""
    events = table(spark, sf, "events")
    users = events.select(F.col("user_id").alias("review_id")).distinct()
    reviews = users.select("review_id", F.col("review_id").alias("inspection_id"), F.lit("pending").alias("status"))
    frame = lambda name: F.struct(*[F.lit(x).alias(e) for e, x in zip(EDGES, (0.0, 0.0, 0.5, 0.5))], F.lit(name).alias("class_name"))
    regions = F.when(F.col("review_id") % 5 == 0, F.array(frame("seen")))
    seen = users.select(F.col("review_id").alias("inspection_id"), F.lit(None).cast("string").alias("predicted_class"), regions.alias("regions"))
    label = F.when(F.col("review_id") % 3 == 0, "normal").otherwise(F.concat(F.lit("c"), (F.col("review_id") % 3).cast("string")))
    own = F.when(F.col("review_id") % 3 == 2, F.array(frame("scratch"), frame("normal"), frame("dent")))
    fixed = users.select("review_id", label.alias("corrected_label"), own.alias("corrected_boxes"))
    versions = spark.createDataFrame([("v0",)], "version string")
    logs = events.select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    out = X.review_loop(reviews, seen, actions(spark, sf), fixed, versions, "v1", logs)
    refused = out["refused"].groupBy("review_id").agg(F.count(F.lit(1)).alias("refused"))
    lines = out["lines"].groupBy("review_id").agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.array_sort(F.collect_list("cls")), ",").alias("classes"))
    told = out["history"].select("review_id", F.size("history").cast("long").alias("entries"), F.element_at("history", -1)["action"].alias("last_entry"))
    met = out["reviews"].select("review_id", "status").join(refused, "review_id", "left").join(out["samples"].select("review_id", "label", "export_status"), "review_id", "left").join(lines, "review_id", "left")
    return met.join(told, "review_id", "left").na.fill(0, ["refused", "lines"])


DEEP = f"""WITH {VECTORS}, model AS (SELECT pos, avg(x) AS mean, greatest(stddev_pop(x), 0.0001) AS std FROM vectors WHERE label = 0 GROUP BY 1), deep AS (SELECT id, v.pos, label, abs((x - mean) / std) AS score FROM vectors v JOIN model m ON v.pos = m.pos),
scores AS (SELECT id, max(score) AS score, (any_value(label) <> 0)::INT AS bad FROM deep GROUP BY 1), px AS (SELECT score, (pos % 8 = 0)::INT AS bad FROM deep)"""


def _area(rows: str) -> str:
    return f"(SELECT (sum(mid) FILTER (bad = 1) - count(*) FILTER (bad = 1) * (count(*) FILTER (bad = 1) + 1) / 2) / (count(*) FILTER (bad = 1) * count(*) FILTER (bad = 0)) FROM (SELECT bad, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid FROM {rows}))"


@query(f"""{DEEP} SELECT 'image' AS part, 'auroc' AS key, round({_area("scores")}, 6) AS value UNION ALL SELECT 'pixel', 'auroc', round({_area("px")}, 6) UNION ALL SELECT 'image', 'fp', count(*) FROM scores WHERE score >= 2.5 AND bad = 0 UNION ALL SELECT 'pixel', 'tp', count(*) FROM px WHERE score >= 1.5 AND bad = 1
UNION ALL SELECT 'failures', 'n', count(*) FROM scores WHERE (score >= 2.5) <> (bad = 1) UNION ALL SELECT 'latency', 'p95_ms', round(quantile_cont(value, 0.95), 6) FROM events UNION ALL SELECT 'latency', 'mean_ms', round(avg(value), 6) FROM events""")
def evaluate_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of label 0 train the model, all are scored and judged on images, pixels and latency."""
    v = vectors(spark, sf)
    model = X.train_normal_model(v.where("label = 0"))["model"]
    masks, labels = v.where("pos % 8 = 0").select("id", "pos"), v.select("id", (F.col("label") != 0).cast("int").alias("label")).distinct()
    out = X.evaluate(X.score(v, model), labels, (2.5, 1.5), masks, table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("ms")))
    level = lambda x: out["metrics"].where(F.col("level") == x)
    failures = out["failures"].agg(F.count(F.lit(1)).alias("n"))
    rows = [("image", level("image"), "auroc"), ("pixel", level("pixel"), "auroc"), ("image", level("image"), "fp"), ("pixel", level("pixel"), "tp"), ("failures", failures, "n"), ("latency", out["latency"], "p95_ms"), ("latency", out["latency"], "mean_ms")]
    return shown(*[(part, df, F.lit(k), F.col(k)) for part, df, k in rows])


@query(f"""WITH RECURSIVE {BOXES}, n AS (SELECT *{NUM} AS r FROM boxes WHERE conf >= 0.25), over AS (SELECT a.image, a.r AS r1, b.r AS r2 FROM n a JOIN n b ON a.image = b.image AND a.r < b.r WHERE {IOU} > 0.5), top AS (SELECT image, max(r) AS m FROM n GROUP BY 1),
walk AS (SELECT image, 0::BIGINT AS r, []::BIGINT[] AS kept FROM top UNION ALL SELECT w.image, w.r + 1, CASE WHEN EXISTS (SELECT 1 FROM over o WHERE o.image = w.image AND o.r2 = w.r + 1 AND list_contains(w.kept, o.r1)) THEN w.kept ELSE list_append(w.kept, w.r + 1) END FROM walk w JOIN top USING (image) WHERE w.r < top.m),
kept AS (SELECT n.* FROM n JOIN walk w ON w.image = n.image AND list_contains(w.kept, n.r) JOIN top ON top.image = w.image AND w.r = top.m),
t AS (SELECT image, cls, x1 + l_tax * 100 AS x1, y1, x2 + l_tax * 100 AS x2, y2, row_number() OVER (PARTITION BY image ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM boxes),
p AS (SELECT image, cls, x1, y1, x2, y2, row_number() OVER (PARTITION BY image ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM kept),
good AS (SELECT * FROM (SELECT a.image, a.r AS t, b.r AS p, a.cls = b.cls AS same, {IOU} AS iou FROM t a JOIN p b ON a.image = b.image) WHERE iou >= 0.5), last AS (SELECT image, max(r) AS m FROM t GROUP BY 1),
go AS (SELECT image, 0::BIGINT AS r, []::BIGINT[] AS used, []::VARCHAR[] AS outcomes FROM last UNION ALL
  SELECT w.image, w.r + 1, CASE WHEN g.p IS NULL THEN w.used ELSE list_append(w.used, g.p) END, list_append(w.outcomes, CASE WHEN g.p IS NULL THEN 'missed' WHEN g.same THEN 'hit' ELSE 'class_error' END)
  FROM go w JOIN last USING (image) LEFT JOIN LATERAL (SELECT arg_max(p, {{'i': iou, 'p': -p}}) AS p, arg_max(same, {{'i': iou, 'p': -p}}) AS same FROM good WHERE good.image = w.image AND good.t = w.r + 1 AND NOT list_contains(w.used, p)) g ON true WHERE w.r < last.m),
done AS (SELECT w.* FROM go w JOIN last ON w.image = last.image AND w.r = last.m), o AS (SELECT unnest(outcomes) AS outcome FROM done UNION ALL SELECT 'false_positive' FROM p JOIN done d ON p.image = d.image AND NOT list_contains(d.used, p.r))
SELECT 'errors' AS part, outcome AS key, count(*)::DOUBLE AS value FROM o WHERE outcome <> 'hit' GROUP BY ROLLUP (outcome) UNION ALL SELECT 'detections', 'n', count(*) FROM kept""")
def detection_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as raw detections (box, confidence, class by return flag) against boxes shifted by tax."""
    letters = F.ascii("cls")
    raw = boxes(spark, sf).withColumn("raw", F.array(*[F.col(f"box.{e}") for e in ("x1", "y1", "x2", "y2")], F.col("conf"), letters.cast("double")))
    x = F.col("l_tax") * 100
    truth = boxes(spark, sf).withColumn("box", box(F.col("box.x1") + x, F.col("box.y1"), F.col("box.x2") + x, F.col("box.y2"))).withColumn("cls", letters)
    out = X.detection_errors(raw.select("image", *ORDER, "raw"), F.col("raw"), truth, ORDER)
    return shown(("errors", out["by_type"], F.col("outcome"), F.col("n")), ("detections", out["detections"].agg(F.count(F.lit(1)).alias("n")), F.lit("n"), F.col("n")))


DAY = "1997-03-03"


@query(f"""WITH {INSPECTIONS}, t AS (SELECT * FROM decided WHERE o_orderdate::DATE = DATE '{DAY}') SELECT 'overview' AS part, 'today' AS key, count(*)::DOUBLE AS value FROM t UNION ALL SELECT 'overview', 'pending', count(*) FROM t WHERE len(reasons) > 0 UNION ALL SELECT 'overview', 'defect_rate', round(count(*) FILTER (status IN ('DEFECT', 'ANOMALY')) / greatest(count(*), 1), 6) FROM t
UNION ALL SELECT 'overview', 'mean_latency', round(coalesce(avg(o_totalprice), 0), 6) FROM t UNION ALL SELECT 'states', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'latest_inspections', inspection_id::VARCHAR, 1 FROM (SELECT inspection_id FROM decided ORDER BY o_orderdate DESC, inspection_id LIMIT 200)
UNION ALL SELECT 'latest_reviews', event_id::VARCHAR, 1 FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 100) UNION ALL SELECT 'latest_events', event_id::VARCHAR, 1 FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 10)""")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    i = decided(spark, sf).select("inspection_id", F.col("o_orderdate").alias("ts"), "final_status", "review_reasons", F.col("o_totalprice").alias("latency"), F.lit(None).cast("string").alias("predicted_class"))
    e = table(spark, sf, "events")
    out = X.dashboard(i, e.select(F.col("event_id").alias("review_id"), F.col("event_type").alias("status"), "ts"), e.select("event_id", "ts"), DAY)
    view = [("overview", out["overview"], F.lit(k), F.col(k)) for k in ("today", "pending", "defect_rate", "mean_latency")]
    one = F.lit(1)
    return shown(*view, ("states", out["states"], F.col("status"), F.col("n")), ("latest_inspections", out["latest_inspections"], F.col("inspection_id"), one), ("latest_reviews", out["latest_reviews"], F.col("review_id"), one), ("latest_events", out["latest_events"], F.col("event_id"), one))


#: The benchmark reports with two providers, three batch sizes and a rate each.
TIMED = BENCH.replace('"cpu", "batch_size": 4}', """"' || CASE WHEN user_id % 2 = 0 THEN 'cpu' ELSE 'gpu' END || '", "fps": ' || (event_id % 9 + 1) || ', "batch_size": ' || (user_id % 3 + 1) || '}""")


@query("""WITH e AS (SELECT user_id % 3 + 1 AS batch, user_id % 2 AS gpu, avg(event_id % 50 + 1) AS latency, avg(event_id % 9 + 1) AS rate FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2), c AS (SELECT 'gpu@' || a.batch AS name, b.latency / a.latency AS x, a.rate / b.rate AS y FROM e a LEFT JOIN e b ON a.batch = b.batch AND b.gpu = 0 WHERE a.gpu = 1)
SELECT 'd' || doc_id AS name, 'quality' AS kind, n_chars::DOUBLE AS value, lang AS generated_at FROM documents UNION ALL SELECT 'e' || event_id, 'benchmark', (event_id % 50 + 1)::DOUBLE, NULL FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT name, 'latency_speedup', round(x, 6), NULL FROM c UNION ALL SELECT name, 'throughput_speedup', round(y, 6), NULL FROM c""")
def reports(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), F.expr(REPORT).alias("json"))
    b = table(spark, sf, "events").select(F.concat(F.lit("e"), "event_id").alias("name"), F.expr(TIMED).alias("json"))
    out = X.reports(q, b, "json", "cpu")
    listed = out["all"].select("name", "kind", F.coalesce("total_images", "average_latency_ms").alias("value"), "generated_at")
    name = F.concat_ws("@", "selected_provider", F.col("selected_batch_size").cast("int"))
    each = [out["compared"].select(name.alias("name"), F.lit(k).alias("kind"), F.round(k, 6).alias("value"), F.lit(None).cast("string").alias("generated_at")) for k in ("latency_speedup", "throughput_speedup")]
    return reduce(lambda a, b: a.unionByName(b), [listed, *each])


@query(f"WITH {MEASURES} SELECT doc_id AS path, 'BLURRY_IMAGE' AS code FROM m WHERE blur < 80 UNION ALL SELECT doc_id, 'OVEREXPOSED_IMAGE' FROM m WHERE bright >= 0.8::DOUBLE UNION ALL SELECT doc_id, 'UNDEREXPOSED_IMAGE' FROM m WHERE dark >= 0.8::DOUBLE UNION ALL SELECT doc_id, 'LOW_QUALITY' FROM labels WHERE quality = 0")
def united_issues(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import checks as C
    from ..operators import windows as W

    seen = C.exposure_issues(image_measures(spark, sf), "doc_id", "blur", "bright", "dark")
    return W.union_issues(seen, table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("path"), F.lit("LOW_QUALITY").alias("code"))).select("path", "code")


@query("SELECT event_id, lower(to_base(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(event_type || event_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296), 36)) AS hash FROM events")
def rolling_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", rolling_hash36(F.concat("event_type", F.col("event_id").cast("string"))).alias("hash"))


@query(f"WITH {BOXES} SELECT image, l_partkey, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM boxes")
def pixel_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of odd lines are given as shares of the image, the others in pixels; both come out in pixels."""
    side = {"x": 700.0, "y": 500.0}
    odd = F.col("l_linenumber") % 2 == 1
    given = F.struct(*[F.when(odd, F.col(f"box.{e}") / side[e[0]]).otherwise(F.col(f"box.{e}")).alias(e) for e in EDGES])
    out = to_pixels(given, F.lit(700.0), F.lit(500.0))
    return boxes(spark, sf).select("image", "l_partkey", *[F.round(out[e], 4).alias(e) for e in EDGES])
