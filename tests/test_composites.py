"""The whole jobs on small fixtures."""

from inspectra.operators import composites as X
from inspectra.operators.decisions import Rules
from pyspark.sql import functions as F


def test_scan_finds_what_is_planted(spark):
    images = [("train/a.png", "train", "a", 100, 90.0, 0.1, 0.1, "m1", 0b1111), ("train/b.png", "train", "b", 100, 10.0, 0.9, 0.1, "m1", 0b1111), ("val/a.png", "val", "a", 100, 90.0, 0.1, 0.1, "m1", 0b1111), ("val/c.gif", "val", "c", 100, 90.0, 0.1, 0.1, "m2", 0b1110), ("val/d.png", "val", "d", -1, None, None, None, "m3", None)]
    df = spark.createDataFrame(images, "path string, split string, stem string, width int, blur double, bright double, dark double, md5 string, dhash long").withColumn("height", F.col("width"))
    labels = spark.createDataFrame([("train", "a", "0 0.5 0.5 0.2 0.2\n1 0.5 0.5 1.2 0.2"), ("val", "a", " "), ("val", "c", "9 0.5 0.5 0.01 0.01")], "split string, stem string, text string")
    out = X.scan_quality(df, labels, 2, near=1)
    got = sorted((r["code"], r["path"]) for r in out["issues"].collect())
    assert got == sorted([
        ("UNSUPPORTED_IMAGE_FORMAT", "val/c.gif"), ("CORRUPT_IMAGE", "val/d.png"), ("BLURRY_IMAGE", "train/b.png"), ("OVEREXPOSED_IMAGE", "train/b.png"), ("MISSING_ANNOTATION", "train/b.png"), ("EMPTY_ANNOTATION", "val/a.png"),
        ("OUT_OF_BOUNDS_BOX", "train/a.png"), ("INVALID_CLASS", "val/c.gif"), ("TINY_BOX", "val/c.gif"), ("EXACT_DUPLICATE", "train/b.png"), ("EXACT_DUPLICATE", "val/a.png"),
        *[("SPLIT_LEAKAGE", p) for p in ("train/a.png", "train/b.png", "val/a.png")], *[("NEAR_DUPLICATE", "val/c.gif")] * 3, *[("POTENTIAL_SPLIT_LEAKAGE", "val/c.gif")] * 2,
    ])
    assert out["summary"].first()["issue_count"] == len(got) and out["report"].first()["summary"]["issue_count"] == len(got)
    assert {r["class_id"]: r["n"] for r in out["classes"].collect()} == {0: 1, 1: 1}


def test_annotations_become_labels_and_splits(spark):
    xml = "<annotation><filename>{0}.png</filename><size><width>128</width><height>96</height><depth>3</depth></size><object><name>{1}</name><bndbox><xmin>10</xmin><ymin>10</ymin><xmax>42</xmax><ymax>34</ymax></bndbox></object></annotation>"
    texts = spark.createDataFrame([(xml.format(i, "ab"[i % 2]),) for i in range(8)], "xml string")
    out = X.convert_annotations(texts, "xml", spark.createDataFrame([(f"{i}.png",) for i in range(8)], "filename string"), ("a", "b"))
    labels = out["labels"].collect()
    assert len(labels) == 8 and sorted(r["text"][0] for r in labels) == ["0"] * 4 + ["1"] * 4 and out["invalid"].count() == 0 and out["missing"].count() == 0
    assert labels[0]["text"][2:] == "0.203125 0.229167 0.250000 0.250000"
    images = spark.createDataFrame([(f"{i}.png", str(i), "ab"[i % 2], "same" if i < 2 else str(i)) for i in range(9)], "path string, stem string, class string, md5 string")
    got = X.prepare_splits(images, spark.createDataFrame([(str(i),) for i in range(8)], "stem string"), (0.5, 0.25))
    split = {r["path"]: r["split"] for r in got["splits"].collect()}
    assert len(split) == 8 and split["0.png"] == split["1.png"] and [r["stem"] for r in got["unmatched"].collect()] == ["8"]


def test_training_set_with_a_bad_line_and_a_leak(spark):
    images = spark.createDataFrame([("t/1", "train", "1", "x"), ("v/2", "val", "2", "x"), ("v/3", "val", "3", "y")], "path string, split string, stem string, md5 string")
    labels = spark.createDataFrame([("train", "1", "0 0.5 0.5 1.2 0.2"), ("val", "2", "1 0.5 0.5 0.2 0.2")], "split string, stem string, text string")
    out = X.validate_training_set(images, labels, 2)
    assert sorted((r["code"], r["path"]) for r in out["errors"].collect()) == [("MISSING_LABEL", "v/3"), ("OUT_OF_BOUNDS_BOX", "t/1"), ("SPLIT_LEAKAGE", "t/1")]
    assert tuple(out["summary"].first()) == (3, 1, False)


def test_inspection_to_export(spark):
    region = "array<struct<class_name: string, confidence: double>>"
    rows = [(1, "k", 100, 10.0, [], 0.0, None), (2, "k", 100, 90.0, [], 0.0, None), (3, None, 100, 90.0, [("crazing", 0.3)], 0.0, None), (4, "x", 100, 90.0, [], 999.0, None), (5, "y", 100, 90.0, [], 0.0, "down")]
    df = spark.createDataFrame(rows, f"inspection_id long, key string, width int, blur double, regions {region}, score double, why string")
    df = df.withColumns({"height": F.col("width"), "bright": F.lit(0.0), "dark": F.lit(0.0), "mode": F.lit("hybrid"), "flag": F.lit(False)})
    out = X.inspect(df, {"detector": "why"}, ["inspection_id"], Rules())
    got = {r["inspection_id"]: r for r in out["inspections"].collect()}
    assert set(got) == {1, 3, 4, 5} and got[5]["final_status"] == "INFERENCE_FAILED"
    assert got[1]["review_reasons"] == ["BLURRY_IMAGE"] and got[3]["review_reasons"] == ["YOLO_LOW_CONFIDENCE"] and "YOLO_NONE_ANOMALY_HIGH" in got[4]["review_reasons"]
    boxes = "array<struct<x1: double, y1: double, x2: double, y2: double, class_name: string>>"
    seen = out["inspections"].select("inspection_id", "predicted_class", F.lit(None).cast(boxes).alias("regions"))
    acts = spark.createDataFrame([("review-1", "approve", "me", 1, 1), ("review-3", "correct", "me", 2, 2), ("review-3", "reject", "me", 3, 3), ("nobody", "approve", "me", 4, 4)], "review_id string, action string, reviewer string, action_id long, ts long")
    fixed = spark.createDataFrame([("review-3", "scratch", None)], f"review_id string, corrected_label string, corrected_boxes {boxes}")
    loop = X.review_loop(out["reviews"], seen, acts, fixed, spark.createDataFrame([("old",)], "version string"), "new")
    assert {r["review_id"]: r["status"] for r in loop["reviews"].collect()} == {"review-1": "approved", "review-3": "corrected", "review-4": "pending", "review-5": "pending"}
    assert sorted(r["error"] for r in loop["refused"].collect()) == ["REVIEW_NOT_FOUND", "REVIEW_STATE_CONFLICT"]
    assert loop["outcome"].first()["error"] is None and [r["cls"] for r in loop["lines"].collect()] == ["scratch"]
    again = X.review_loop(out["reviews"], seen, acts, fixed, spark.createDataFrame([("new",)], "version string"), "new")
    assert again["outcome"].first()["error"] == "DATASET_VERSION_EXISTS" and again["lines"].count() == 0


def test_ranks_and_quantiles_over_range_partitions(spark):
    import numpy as np
    from inspectra.operators import aggregates as A

    draw = np.random.default_rng(3)
    rows = [("ab"[i % 2] if i % 7 else None, float(x)) for i, x in enumerate(draw.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "g string, x double")
    for r in A.quantiles(df, "x", {"lo": 0.05, "mid": 0.5, "hi": 0.99}, ["g"]).collect():
        own = [x for g, x in rows if g == r["g"]]
        assert np.allclose([r["lo"], r["mid"], r["hi"]], np.quantile(own, [0.05, 0.5, 0.99]))
    for r in A.mid_ranks(df, "x", ["g"]).collect():
        own = [x for g, x in rows if g == r["g"]]
        assert r["mid_rank"] == sum(x < r["x"] for x in own) + (own.count(r["x"]) + 1) / 2
    assert A.nearest_rank(df, "x", 0.95).first()["value"] == sorted(x for _, x in rows)[round(499 * 0.95)]
