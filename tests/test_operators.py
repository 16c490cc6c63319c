"""Operators on hand-made rows: the semantic traps, files, images, sinks and streams."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inspectra.functions import boxes as B
from inspectra.functions import hashing, text, variants
from inspectra.operators import aggregates as A
from inspectra.operators import checks as C
from inspectra.operators import decisions as D
from inspectra.operators import images as U
from inspectra.operators import joins as J
from inspectra.operators import windows as W
from inspectra.operators import workflow as M
from inspectra.sources import files, sinks
from inspectra.streaming import feeds as R

REGIONS = "array<struct<class_name:string,confidence:double>>"
CASE = f"id int, issues array<string>, regions {REGIONS}, score double, flag boolean, failed boolean"
COLUMNS = {k: k for k in ("issues", "regions", "score", "flag", "failed")}


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_decision_cases(spark):
    rows = [
        (1, ["BLURRY_IMAGE"], [], 0.0, False, False), (2, [], [("crazing", 0.3)], 0.0, False, False), (3, [], [], 999.0, True, False), (4, [], [], None, None, True),
        (5, ["CORRUPT_IMAGE"], [], 0.0, False, True), (6, [], [("a", 0.9)], 0.0, False, False), (7, [], [], 0.0, False, False), (8, None, None, None, None, None), (9, [], [("R", 0.5), ("R", None)], 0.0, False, False),
    ]
    got = {r["id"]: r for r in D.decide(spark.createDataFrame(rows, CASE), **COLUMNS).collect()}
    assert got[1]["review_reasons"] == ["BLURRY_IMAGE"] and got[1]["final_status"] == "REVIEW_REQUIRED"
    assert got[2]["review_reasons"] == ["YOLO_LOW_CONFIDENCE"] and "YOLO_NONE_ANOMALY_HIGH" in got[3]["review_reasons"]
    assert [got[i]["final_status"] for i in (4, 5, 6, 7, 8)] == ["INFERENCE_FAILED", "IMAGE_QUALITY_FAILED", "DEFECT", "PASS", "PASS"]
    assert got[9]["review_reasons"] == ["HIGH_RISK_DEFECT"] and got[9]["max_confidence"] == 0.5
    forced = D.decide(spark.createDataFrame(rows[6:7], CASE), **COLUMNS, rules=D.Rules(force_review=True)).first()
    assert forced["review_reasons"] == ["FORCE_REVIEW"]


def test_label_line_traps(spark):
    lines = ["0 0.5 0.5 0.2 0.2", "1.0 0.5 0.5 0.2 0.2", "+1 0.5 0.5 0.2 0.2", "0 0.5 0.5 1.2 0.2", "99 0.5 0.5 1.2 0.2", "0 nan 0.5 0.2 0.2", "0 0.5 0.5 0.2", "0 0.5 0.5 0.01 0.2", "x 1 1 1 1", "0 5e-1 inf 0.2 0.2"]
    df = spark.createDataFrame([(i, x, 100, 100) for i, x in enumerate(lines)], "i int, v string, w int, h int")
    got = {r["i"]: r for r in C.label_issues(df, "v", "w", "h", 6).collect()}
    assert [got[i]["issues"] for i in range(10)] == [[], ["MALFORMED_ANNOTATION"], [], ["OUT_OF_BOUNDS_BOX"], ["INVALID_CLASS", "OUT_OF_BOUNDS_BOX"], [], ["MALFORMED_ANNOTATION"], ["TINY_BOX"], ["MALFORMED_ANNOTATION"], ["OUT_OF_BOUNDS_BOX"]]
    assert got[3]["counted"] and not got[4]["counted"]
    assert [r["error"] for r in C.validate_labels(df, "v", 6).orderBy("i").collect()][3:6] == ["OUT_OF_BOUNDS_BOX", "INVALID_CLASS", None]
    texts = spark.createDataFrame([("a\n\n  b \r\n\n",), ("",)], "t string")
    assert [(r["line"], r["value"]) for r in C.scan_label_lines(texts, "t").collect()] == [(1, "a"), (2, "b")]


def test_suppression_and_iou(spark):
    rows = [("i", 0, B_(10, 10, 30, 30), 0.9, "a"), ("i", 1, B_(11, 11, 31, 31), 0.8, "b"), ("i", 2, B_(1, 1, 2, 2), 0.25, "a"), ("i", 3, B_(50, 50, 60, 60), 0.3, "a")]
    df = spark.createDataFrame(rows, "image string, n int, box struct<x1:double,y1:double,x2:double,y2:double>, conf double, cls string")
    assert sorted(r["n"] for r in W.nms(df, "image", "box", "conf", ["n"], least=0.25).collect()) == [0, 3]
    pred = df.where("n > 0")
    got = sorted((r["outcome"], r["at"]) for r in J.match_boxes(df.where("n <> 3"), pred, "image", "box", "cls", ["n"]).collect())
    assert got == [("class_error", 1), ("false_positive", 3), ("hit", 3), ("missed", 2)]
    assert one(spark, B.iou(F.struct(*[F.lit(0.0).alias(e) for e in B.EDGES]), F.struct(*[F.lit(0.0).alias(e) for e in B.EDGES]))) == 0.0


def B_(*edges):
    return tuple(float(x) for x in edges)


def test_banded_join_equals_brute_force(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(-(2**63), 2**63 - 1, 40)
    values = [int(b) ^ sum(1 << int(k) for k in set(draw.integers(0, 63, draw.integers(0, 6)))) for b in np.repeat(base, 4)] + [int(base[0])] * 5
    rows = [(i, v, f"c{i if i < 160 else 160}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, h long, c string")
    got = {(r[0], r[1]) for r in J.near_duplicates(df, "id", "h", "c", 4).collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2] and bits(a[1], b[1]) <= 4}


@pytest.mark.parametrize(("t", "bits"), [(0, 64), (2, 64), (4, 63)])
def test_crowded_band_values_are_cut_again_without_loss(spark, t, bits):
    draw = np.random.default_rng(t)
    near = [0x0FF0_1234_5678_0000 | int(x) for x in draw.integers(0, 1 << 16, 250)]  # one value in most bands
    far = [int(x) for x in draw.integers(0, 1 << 62, 100)] + ([-5, -6, 1 << 62] if bits == 64 else [])
    hashes = sorted(set(near + far + [h ^ 1 << int(draw.integers(0, 62)) for h in near[:80]]))
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    met = J.hash_buckets(df, t, bits, crowd=12).collect()
    keys = {}
    for r in met:
        keys.setdefault(r["key"], set()).add(r["h"])
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    shared = {(a, b) for k in keys.values() for a in k for b in k if a < b and apart(a, b) <= t}
    assert shared == {(a, b) for a in hashes for b in hashes if a < b and apart(a, b) <= t} and (t == 0 or shared)
    assert all(len(k) <= 12 or max(apart(a, b) for a in k for b in k) <= t for k in keys.values())
    rows = [(i, h, str(h % 3)) for i, h in enumerate(hashes)] + [(9001, None, "x"), (9002, hashes[0], None), (9003, hashes[0], "other")]
    got = {tuple(r) for r in J.near_duplicates(spark.createDataFrame(rows, "i long, h long, c string"), "i", "h", "c", t, bits, crowd=12).collect()}
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    assert got == {(a[0], b[0], apart(a[1], b[1])) for a in known for b in known if a[0] < b[0] and a[2] != b[2] and apart(a[1], b[1]) <= t}


def test_near_duplicates_that_differ_in_every_wider_band(spark):
    for t, bits in ((14, 63), (16, 63), (0, 64)):
        size = -(-bits // (t + 1))
        other = sum(1 << i for i in range(0, bits, size)) if t else 0
        df = spark.createDataFrame([(1, 0, "a"), (2, other, "b"), (3, (1 << 63) - 1, "c")], "id long, h long, c string")
        got = [tuple(r) for r in J.near_duplicates(df, "id", "h", "c", t, bits).collect()]
        assert got == [(1, 2, bin(other).count("1"))] and got[0][2] <= t


def test_auroc_cases(spark):
    make = lambda pairs: spark.createDataFrame(pairs, "y int, s double")
    value = lambda pairs: A.auroc(make(pairs), "y", "s").first()["auroc"]
    assert value([(1, 1.0), (1, 2.0)]) is None and value([(1, 1.0), (0, 1.0)]) == 0.5
    assert value([(0, 1.0), (1, 2.0)]) == 1.0 and value([(1, 1.0), (0, 2.0)]) == 0.0
    assert A.nearest_rank(make([]), "s", 0.95).first()["value"] == 0.0
    assert A.nearest_rank(make([(0, float(i)) for i in range(1, 12)]), "s", 0.95).first()["value"] == 11.0
    c = A.confusion(make([(1, 1.0), (0, 0.5), (1, 0.4)]), "y", "s", 0.5).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["precision"]) == (1, 1, 1, 0, 0.5)


def test_splits(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"h{i // 2}") for i in range(50)], "id int, cls string, hash string")
    s = W.stratified_split(df, "id", "cls")
    assert {(r["cls"], r["split"]): r["count"] for r in s.groupBy("cls", "split").count().collect()} == {(c, k): n for c in "ab" for k, n in (("train", 18), ("val", 5), ("test", 2))}
    assert sorted(s.collect()) == sorted(W.stratified_split(df.repartition(3), "id", "cls").collect())
    assert W.align_duplicates(s, "id", "hash", "split").groupBy("hash").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert W.random_split(df.limit(2), "id", 0.0).where("split = 'val'").count() == 1
    assert W.random_split(df, "id", 0.2).where("split = 'val'").count() == 10


def test_variants(spark):
    v = lambda s: F.parse_json(F.lit(s))
    n = lambda s: one(spark, variants.tolerant_number(v(s), "$.a", "$.b"))
    assert n('{"a": true, "b": "2.5"}') == 2.5 and n('{"a": "x"}') is None and n('{"a": 0, "b": 3}') == 0 and n('{"a": null, "b": 3}') == 3
    box = lambda s: one(spark, variants.normalize_box(v(s)))
    assert tuple(box('{"x1": 1, "top": 2, "right": 3, "ymax": "4"}')) == (1, 2, 3, 4)
    assert tuple(box('{"bounding_box": {"x1": true}, "bbox": {"x": 1, "y": 1, "w": 2, "h": 3}}')) == (1, 1, 3, 4)
    assert tuple(box('{"xywh": [1, 2, 3, 4]}')) == (1, 2, 4, 6) and box('{"bbox": [1, 2]}') is None
    assert one(spark, variants.region_area(v('{"bbox": [5, 5, 5, 9]}'))) is None
    assert one(spark, variants.model_row(v('{"amp": true}'))["precision"]) == "fp16"


def test_scalars(spark):
    def rolling(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) % 2**32
        digits = ""
        while h:
            digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
        return digits or "0"

    assert one(spark, hashing.rolling_hash36(F.lit("a/b c-1234567890.png"))) == rolling("a/b c-1234567890.png")
    assert one(spark, hashing.batch_row_key(F.lit("B"), F.lit(1234), F.lit("x"))).startswith("B-1234-")
    assert one(spark, text.canonical_class(F.lit(" Rolled-In Scale "), {"rolled_in_scale": "scale"}, dash=True)) == "scale"
    assert one(spark, text.map_text(F.create_map(F.lit("b"), F.lit(2.0), F.lit("a"), F.lit(1.5)), 1, 3)) == "a: 1.500"
    assert one(spark, text.path_parts(F.lit("x/y/Archive.tar.GZ"))["suffix"]) == ".gz"
    assert one(spark, text.iso_z(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02T03:04:05Z"
    fit = B.letterbox(F.lit(200), F.lit(100), 640, 640)
    assert tuple(one(spark, fit)) == (3.2, 0.0, 160.0)
    assert one(spark, B.to_pixels(F.struct(*[F.lit(0.5).alias(e) for e in B.EDGES]), F.lit(10.0), F.lit(20.0)))["y2"] == 10.0


def test_workflow(spark):
    reviews = spark.createDataFrame([(1, "pending"), (2, "approved"), (3, "pending")], "review_id long, status string")
    acts = spark.createDataFrame([(1, 10, "correct", "a", 5), (1, 11, "reject", "b", 4), (2, 12, "reject", "a", 1), (9, 13, "approve", "a", 1)], "review_id long, action_id long, action string, reviewer string, ts int")
    done, bad = M.finalize_reviews(reviews, acts)
    assert {r["review_id"]: r["status"] for r in done.collect()} == {1: "rejected", 2: "approved", 3: "pending"}
    assert {r["action_id"]: r["error"] for r in bad.collect()} == {10: "REVIEW_STATE_CONFLICT", 12: "REVIEW_STATE_CONFLICT", 13: "REVIEW_NOT_FOUND"}
    schema = "review_id string, label string, boxes array<struct<x1:double,y1:double,x2:double,y2:double,class_name:string>>, export_status string"
    samples = spark.createDataFrame([("a", "scratch", [], "pending"), ("b", "normal", [], "pending"), ("c", "dent", [(0.0, 0.0, 1.0, 1.0, "dent")], "exported")], schema)
    versions = spark.createDataFrame([("v0",)], "version string")
    error, lines, after = M.export_feedback(samples, versions, "v1", ["review_id"])
    assert error is None and [r["line"] for r in lines.collect()] == ["0 0.500000 0.500000 1.000000 1.000000"]
    assert after.where("dataset_version = 'v1'").count() == 2
    assert M.export_feedback(samples, versions, "v0", ["review_id"])[0] == "DATASET_VERSION_EXISTS"
    assert M.export_feedback(after, versions, "v2", ["review_id"])[0] == "NO_FEEDBACK_TO_EXPORT"
    out = spark.createDataFrame([("a", "x", [(-5.0, 0.0, 1.0, 1.0, "x")], "pending")], schema)
    assert M.export_feedback(out, versions, "v2", ["review_id"])[0] == "INVALID_ANNOTATION"
    models = spark.createDataFrame([(1, "det", True), (2, "det", False), (3, "ano", True)], "model_id int, model_type string, active boolean")
    turns = spark.createDataFrame([(2, 1, 1), (1, 2, 2), (2, 3, 3)], "model_id int, ts int, activation_id int")
    assert {r["model_id"]: r["active"] for r in M.activate(models, turns).collect()} == {1: False, 2: True, 3: True}


def png(path, image):
    h, w = image.shape[:2]
    rgb = np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def image_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    draw = np.random.default_rng(2)
    png(root / "train/images/solid.png", np.full((64, 64), 128))
    noise = draw.integers(0, 256, (64, 64))
    png(root / "train/images/noise.png", noise)
    png(root / "val/images/copy.png", noise)
    png(root / "train/images/white.png", np.full((32, 32), 255))
    shape = np.full((160, 200), 220)
    shape[40:90, 30:75] = 20
    y, x = np.mgrid[:160, :200]
    shape[(x - 145) ** 2 + (y - 110) ** 2 <= 14**2] = 20
    png(root / "test/images/shape.png", shape)
    (root / "test/images/broken.png").write_text("not an image")
    (root / "test/images/anim.gif").write_bytes(b"GIF89a")
    return str(root)


def test_image_jobs(spark, image_dir):
    scan = files.scan_dataset(spark, image_dir)
    assert {r["split"]: r["n"] for r in scan.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {"train": 3, "val": 1, "test": 3}
    assert scan.where("not supported").count() == 1
    assert sorted((r["split"], r["links"]) for r in J.exact_leakage(scan, "path", "md5", "split").collect()) == [("train", 1), ("val", 1)]
    images = files.decode_images(spark, image_dir)
    assert images.where("issue = 'CORRUPT_IMAGE'").count() >= 1
    name = F.regexp_extract("origin", r"([^/]+)\.png$", 1).alias("name")
    f = {r["name"]: r for r in U.image_features(images).select("*", name).collect()}
    assert f["solid"]["blur"] == 0 and f["noise"]["blur"] > 1000 and f["white"]["bright_ratio"] == 1.0 and f["noise"]["dhash"] == f["copy"]["dhash"]
    regions = U.extract_regions(images.where(F.col("origin").endswith("shape.png")), 10).orderBy("x1").collect()
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in regions] == [(30, 40, 75, 90), (131, 96, 160, 125)]
    long = U.pixel_features(images.where("width = 64"), 8)
    assert long.groupBy("origin").count().where("count = 256").count() == 3


def test_score_maps(spark):
    rows = [("a", y * 20 + x, 5.0 if 4 <= y < 9 and 3 <= x < 8 else 0.1) for y in range(20) for x in range(20)]
    df = spark.createDataFrame(rows, "id string, pos int, score double")
    assert [tuple(r)[1:6] for r in U.mask_regions(df, 1.0, 20).collect()] == [(3, 4, 8, 9, 25)]
    smooth = U.smooth_map(df, 20, 20)
    assert smooth.agg(F.max("score")).first()[0] < 5 and abs(smooth.agg(F.avg("score")).first()[0] - df.agg(F.avg("score")).first()[0]) < 0.05


def test_components_of_masks():
    mask = np.zeros((6, 7), bool)
    mask[0, 0] = mask[1, 1] = mask[0, 3] = mask[5, 6] = mask[4, 6] = True
    assert U.labelled(mask).max() == 3 and U.labelled(mask)[0, 0] == U.labelled(mask)[1, 1]
    assert U.labelled(np.ones((9, 9), bool)).max() == 1 and U.labelled(np.zeros((2, 2), bool)).max() == 0


def test_voc_and_reports(spark):
    xml = "<annotation><filename>a.png</filename><size><width>10</width><height>10</height><depth>3</depth></size>{}</annotation>"
    box = "<object><name>{}</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>{}</xmax><ymax>5</ymax></bndbox></object>"
    texts = [xml.format(box.format("a", 5)), xml.format(box.format("a", 5) + box.format("zz", 5)), xml.format(""), "<annotation><filename>", xml.format(box.format("a", 0))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, xml string")
    known = spark.createDataFrame([("a.png",)], "filename string")
    got = sorted((r["i"], r["error"] or "") for r in C.voc_issues(files.parse_voc(df, "xml"), known, ("a",)).collect())
    assert got == [(0, ""), (1, ""), (1, "UNKNOWN_CLASS"), (2, "NO_VALID_BOXES"), (3, "INVALID_XML"), (4, "INVALID_BOX")]
    reports = spark.createDataFrame([(1, '{"results": [{"average_latency_ms": 0}, {"avg_ms": 5, "batch_size": 2}]}'), (2, "{broken")], "i int, j string")
    r = A.benchmark_metrics(files.parse_reports(reports, "j"), "report").collect()
    assert len(r) == 1 and r[0]["average_latency_ms"] == 5.0 and r[0]["success_rate"] == 1.0 and r[0]["selected_batch_size"] == 2


def test_sinks(spark, tmp_path):
    images = spark.createDataFrame([(i, 10 + i, 20) for i in range(5)], "id int, width int, height int")
    issues = spark.createDataFrame([(i, "BLURRY_IMAGE") for i in range(4)], "id int, code string")
    report = sinks.write_quality_report(sinks.quality_report(images, issues, ["id"], keep=2), str(tmp_path / "report"))
    back = spark.read.json(str(tmp_path / "report")).first()
    assert back["summary"]["issue_count"] == 4 and len(back["issues"]) == 2 and sinks.flatten_report(report).first()["width_max"] == 14
    sinks.append_audit(sinks.audit_rows(images, F.lit("x"), F.col("id"), F.lit("me"), F.current_timestamp()), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 5
    cases = spark.createDataFrame([(1, "false_positive"), (2, "false_negative")], "id int, kind string")
    sinks.write_evaluation(spark.createDataFrame([(1.0,)], "auroc double"), cases, str(tmp_path / "eval"))
    assert spark.read.parquet(str(tmp_path / "eval/false_positives")).count() == 1


def test_streams(spark, tmp_path):
    from datetime import datetime

    make = lambda first: [(u, first + i, a, datetime(2024, 1, 1 + i)) for i, (u, a) in enumerate([(1, "approve"), (1, "reject"), (2, "correct"), (None, "approve")])]
    schema = "user long, id long, action string, ts timestamp"
    src = str(tmp_path / "in")
    spark.createDataFrame(make(1), schema).write.parquet(src)
    feed = lambda: R.inspection_stream(spark, src, spark.createDataFrame([], schema).schema)
    history = str(tmp_path / "history")
    for _ in range(2):  # the second run finds nothing new: the checkpoint remembers
        R.run(feed(), str(tmp_path / "c1"), R.dedup_against(history, "user", ["ts"])).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(history).collect()) == [1, 3, 4]
    spark.createDataFrame(make(5), schema).write.mode("append").parquet(src)
    R.run(feed(), str(tmp_path / "c1"), R.dedup_against(history, "user", ["ts"])).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(history).collect()) == [1, 3, 4, 8]
    acts = feed().where("user is not null").select(F.col("user").alias("review_id"), F.col("id").alias("action_id"), "action", "ts")
    R.to_parquet(R.review_stream(acts), str(tmp_path / "c2"), str(tmp_path / "out")).awaitTermination()
    assert sorted(r["action_id"] for r in spark.read.parquet(str(tmp_path / "out")).where("accepted").collect()) == [1, 3]


@pytest.mark.parametrize("files", [1, 4])
def test_review_rounds_do_not_depend_on_the_cut_into_files(spark, tmp_path, files):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    draw = np.random.default_rng(3)
    minute = np.arange(400) + draw.integers(0, 20, 400)  # at most 20 minutes out of order
    acts = [(int(r), i, "approve", start + timedelta(minutes=int(m))) for i, (r, m) in enumerate(zip(draw.integers(0, 5, 400), minute))]
    acts += [(None, 900, "approve", start), (1, 901, "approve", None), (9, 902, "reject", start + timedelta(hours=9))]  # the last moves the watermark
    schema = spark.createDataFrame([], "review_id long, action_id long, action string, ts timestamp").schema
    bounds = np.linspace(0, len(acts), files + 1).astype(int)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        spark.createDataFrame(acts[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = R.inspection_stream(spark, str(tmp_path / "in"), schema, 1)
        R.to_parquet(R.review_rounds(stream, "30 minutes", timedelta(hours=1)), str(tmp_path / "c"), str(tmp_path / "out")).awaitTermination()
    opened, want = {}, []
    for r, i, _, ts in sorted((a for a in acts if a[0] is not None and a[3] is not None and a[0] != 9), key=lambda a: (a[3], a[1])):
        accepted = r not in opened or ts > opened[r] + timedelta(hours=1)
        opened[r] = ts if accepted else opened[r]
        want.append((i, r, accepted))
    got = sorted((r["action_id"], r["review_id"], r["accepted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(want) and 20 < sum(a for _, _, a in want) < 60


def test_review_rounds_keep_state_by_group(spark, tmp_path):
    from datetime import datetime, timedelta

    start, draw = datetime(2024, 1, 1), np.random.default_rng(5)
    acts = [(int(r), i, None if i % 9 == 0 else "approve", start + timedelta(minutes=int(m))) for i, (r, m) in enumerate(zip(draw.integers(0, 3000, 9000), draw.integers(0, 600, 9000)))]
    acts.append((9999, 9999, "reject", start + timedelta(hours=18)))  # settles all others, over three rounds of time
    schema = "review_id long, action_id long, action string, ts timestamp"
    spark.createDataFrame(acts, schema).write.parquet(str(tmp_path / "in"))
    stream = R.inspection_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    query = R.to_parquet(R.review_rounds(stream, "30 minutes", timedelta(hours=4)), str(tmp_path / "c"), str(tmp_path / "out"))
    query.awaitTermination()
    opened, want = {}, []
    for r, i, _, ts in sorted(acts[:-1], key=lambda a: (a[3], a[1])):
        accepted = r not in opened or ts > opened[r] + timedelta(hours=4)
        opened[r] = ts if accepted else opened[r]
        want.append((i, accepted))
    assert sorted((r["action_id"], r["accepted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)
    states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert 0 < max(states) <= R.GROUPS * 5 and states[-1] <= R.GROUPS + 1  # by group and slot, not by action or review


def test_predict_batch_keeps_failures(spark):
    def scorer():
        def score(part):
            if (part["x"] < 0).any():
                raise ValueError("negative")
            return pd.DataFrame({"y": part["x"] * 2.0})

        return score

    got = {r["x"]: (r["y"], r["error"]) for r in U.predict_batch(spark.createDataFrame([(1,), (-1,), (3,)], "x long"), scorer, "y double").collect()}
    assert got == {1: (2.0, None), -1: (None, "negative"), 3: (6.0, None)}
