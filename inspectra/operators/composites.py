"""Whole jobs: the entry points that put the operators together. Each takes tables and gives tables by name.

Column names are fixed here, so that a result of one job is an input of the next. Nothing is computed before a table is
used; what is not used costs nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import decode_detection, voc_to_center
from ..sources import files, sinks
from ..sources.shared import written
from . import aggregates as A
from . import checks as C
from . import decisions as D
from . import joins as J
from . import windows as W
from . import workflow as M

Tables = dict[str, DataFrame]
#: What a scan can find.
SCAN_CODES = (
    "UNSUPPORTED_IMAGE_FORMAT", "CORRUPT_IMAGE", "BLURRY_IMAGE", "OVEREXPOSED_IMAGE", "UNDEREXPOSED_IMAGE", "EXACT_DUPLICATE", "NEAR_DUPLICATE", "SPLIT_LEAKAGE", "POTENTIAL_SPLIT_LEAKAGE",
    "MISSING_ANNOTATION", "EMPTY_ANNOTATION", "MALFORMED_ANNOTATION", "INVALID_CLASS", "OUT_OF_BOUNDS_BOX", "TINY_BOX",
)


def scan_quality(images: DataFrame, labels: DataFrame, n_classes: int, near: int | None = 4, limits: C.ImageLimits = C.SCAN, keep: int = 200) -> Tables:
    """issues (code, path), summary, sizes, resolutions, classes and report of a data set.

    images: path, split, stem, width (below 0: cannot be decoded), height, blur, bright, dark, md5, dhash. labels: split,
    stem, text. near: bits in which near duplicates may differ; None leaves them out.
    """
    told = lambda df, code: df.select(F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), "path")
    good = images.where("width >= 0")
    lines = C.scan_label_lines(labels.join(good.select("split", "stem", "path", "width", "height"), ["split", "stem"]), "text")
    lines = C.label_issues(lines, "value", "width", "height", n_classes)
    found = [
        told(C.split_by_extension(images, "path").where("issue is not null"), F.col("issue")),
        told(images.where("width < 0"), "CORRUPT_IMAGE"),
        C.exposure_issues(good, "path", "blur", "bright", "dark", limits).select("code", "path"),
        told(J.annotation_presence(good, labels, ["split", "stem"], "text").where("annotation is not null"), F.col("annotation")),
        lines.select(F.explode("issues").alias("code"), "path"),
        told(W.exact_duplicates(good.select("path", "md5"), "path", "md5", ["path"]), "EXACT_DUPLICATE"),
        told(J.exact_leakage(good.select("path", "md5", "split"), "path", "md5", "split"), "SPLIT_LEAKAGE"),
    ]
    if near is not None:
        close = J.near_leakage(good, "path", "dhash", "md5", "split", near)
        found += [told(J.near_duplicates(good, "path", "dhash", "md5", near).withColumnRenamed("second_id", "path"), "NEAR_DUPLICATE"), told(close.withColumnRenamed("second_id", "path"), "POTENTIAL_SPLIT_LEAKAGE")]
    issues = W.union_issues(*found)
    return {
        "issues": issues, "summary": A.issue_summary(issues, "code", SCAN_CODES), "sizes": A.size_statistics(good, "width", "height"), "resolutions": A.resolutions(good, "width", "height"),
        "classes": A.class_distribution(lines.where("counted"), "class_id"), "report": sinks.quality_report(good, issues, ["path", "code"], keep),
    }


def convert_annotations(annotations: DataFrame, xml: str, images: DataFrame, classes: tuple[str, ...]) -> Tables:
    """labels (filename, text: a line per good box), invalid (filename, error) and missing (annotations without image).

    images: filename.
    """
    objects = C.voc_issues(files.parse_voc(annotations, xml), images, classes)
    number = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    pixel = F.struct(*[F.col(a).alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))])
    good = objects.where("error is null").withColumn("class_id", number[F.col("name")]).withColumn("center", voc_to_center(pixel, F.col("width"), F.col("height")))
    return {
        "labels": sinks.label_text(good, "filename", "class_id", "center", ["class_id", "xmin", "ymin", "xmax", "ymax"]), "invalid": objects.where("error is not null").select("filename", "error"),
        "missing": J.missing_images(objects.where("filename is not null"), images, "filename").select("filename").distinct(),
    }


def prepare_splits(images: DataFrame, annotations: DataFrame, ratios: tuple[float, float] = (0.7, 0.2), seed: int = 42) -> Tables:
    """splits (images that have one annotation, with split: stratified by class, copies together), distribution, pairs,
    unmatched and groups (of equal images).

    images: path, stem, class, md5. annotations: stem.
    """
    pairs = J.pair_by_stem(images, annotations, "stem")
    ready = images.join(pairs.where("state = 'matched'").select("stem"), "stem", "left_semi")
    split = W.align_duplicates(W.stratified_split(ready, "path", "class", ratios, seed), "path", "md5", "split")
    return {
        "splits": split, "distribution": A.split_distribution(split, "split", "class"), "pairs": pairs,
        "unmatched": W.unmatched(images, annotations, "stem"), "groups": A.hash_groups(split, "path", "md5", "split"),
    }


def validate_training_set(images: DataFrame, labels: DataFrame, n_classes: int, splits: tuple[str, ...] = ("train", "val")) -> Tables:
    """errors (code, split, path, line) and summary (one row: errors, valid_boxes, valid).

    images: path, split, stem, md5. labels: split, stem, text. Codes: MISSING_SPLIT, MISSING_LABEL, those of
    validate_labels and SPLIT_LEAKAGE; an empty label is no error.
    """
    named = labels.join(images.select("split", "stem", "path"), ["split", "stem"])
    lines = C.validate_labels(C.scan_label_lines(named, "text"), "value", n_classes)
    row = lambda df, code, split, path, line: df.select(code.alias("code"), split.alias("split"), path.alias("path"), line.alias("line"))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("int")
    leak = J.split_hash_leakage(images.where(F.col("split") == splits[0]), images.where(F.col("split") == splits[1]), "path", "md5")
    errors = W.union_issues(
        row(W.missing_values(images, "split", list(splits)), F.lit("MISSING_SPLIT"), F.col("split"), none, nothing),
        row(images.join(labels, ["split", "stem"], "left_anti"), F.lit("MISSING_LABEL"), F.col("split"), F.col("path"), nothing),
        row(lines.where("error is not null"), F.col("error"), F.col("split"), F.col("path"), F.col("line")),
        row(leak, F.lit("SPLIT_LEAKAGE"), F.lit(splits[0]), F.col("train_name"), nothing),
    )
    valid = lines.where("error is null").agg(F.count(F.lit(1)).alias("valid_boxes"))
    summary = errors.agg(F.count(F.lit(1)).alias("errors")).join(valid, F.lit(True)).withColumn("valid", F.col("errors") == 0)
    return {"errors": errors, "summary": summary}


def inspect(requests: DataFrame, steps: dict[str, str], order: list[str], rules: D.Rules = D.Rules(), gate: C.ImageLimits = C.GATE, history: DataFrame | None = None) -> Tables:
    """inspections and the reviews that they open.

    requests: inspection_id, key (idempotency, may be null), mode, width, height, blur, bright, dark, regions, score, flag,
    and an error text per step. A key that was seen before, or by an earlier request, is left out.
    """
    fresh = W.first_by_key(requests, "key", order, history)
    seen = C.quality_gate(fresh, "width", "height", "blur", "bright", "dark", gate)
    folded = D.fold_errors(seen, steps)
    done = D.apply_mode(folded, "mode", "issues", "regions", "score", "flag", "inference_failed", rules)
    done = done.withColumn("predicted_class", D.predicted_class(F.col("regions"), F.col("flag"), F.col("final_status")))
    return {"inspections": done, "reviews": M.open_reviews(done)}


def review_loop(reviews: DataFrame, inspections: DataFrame, actions: DataFrame, corrections: DataFrame, versions: DataFrame, version: str, logs: DataFrame | None = None) -> Tables:
    """reviews after the actions, refused actions, feedback of corrected reviews, exported label lines, samples after the
    export, outcome (one row: error) and, with logs, history.

    corrections: review_id, corrected_label, corrected_boxes.
    """
    done, refused = M.finalize_reviews(reviews, actions)
    feedback = M.make_feedback(done.join(corrections, "review_id", "left"), inspections)
    error, lines, samples = M.export_feedback(feedback, versions, version, ["review_id"])
    outcome = reviews.sparkSession.createDataFrame([(error,)], "error string")
    out = {"reviews": done, "refused": refused, "feedback": feedback, "lines": lines, "samples": samples, "outcome": outcome}
    return out | ({"history": J.review_detail(done.select("review_id", "inspection_id"), inspections, logs)} if logs is not None else {})


def train_normal_model(positions: DataFrame, image_q: float = 0.95, position_q: float = 0.99) -> Tables:
    """model and thresholds from the positions (id, pos, channel, x) of good images."""
    model = A.fit_normal_model(positions, "pos", "channel", "x")
    deep = A.position_scores(positions, model, "id", "pos", "channel", "x")
    return {"model": model, "thresholds": A.thresholds(deep.groupBy("id").agg(F.max("score").alias("score")), deep, image_q, position_q)}


def score(positions: DataFrame, model: DataFrame) -> Tables:
    """images (id, score) and positions (id, pos, score)."""
    deep = A.position_scores(positions, model, "id", "pos", "channel", "x")
    return {"images": deep.groupBy("id").agg(F.max("score").alias("score")), "positions": deep}


def evaluate(scored: Tables, labels: DataFrame, thresholds: tuple[float, float], masks: DataFrame | None = None, latencies: DataFrame | None = None) -> Tables:
    """metrics (level image and, with masks, pixel), failures and, with latencies, latency.

    labels: id, label. masks: id, pos of anomalous positions. latencies: id, ms.
    """
    images = scored["images"].join(labels, "id")
    levels = [A.evaluate(images, "label", "score", thresholds[0]).withColumn("level", F.lit("image"))]
    if masks is not None:
        marked = scored["positions"].join(masks.select("id", "pos", F.lit(1).alias("label")).distinct(), ["id", "pos"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
        levels.append(A.evaluate(marked, "label", "score", thresholds[1]).withColumn("level", F.lit("pixel")))
    out = {"metrics": reduce(lambda a, b: a.unionByName(b), levels), "failures": A.failure_cases(images, "label", "score", thresholds[0])}
    if latencies is not None:
        mean = latencies.agg(F.avg("ms").alias("mean_ms"))
        out["latency"] = mean.join(A.quantiles(latencies, "ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}), F.lit(True))
    return out


def detection_errors(raw: DataFrame, row: Column, truth: DataFrame, order: list[str], layout: str = "xyxy", confidence: float = 0.25, overlap: float = 0.5) -> Tables:
    """detections (decoded and suppressed; written once), matches, and errors by type, by image and by item.

    raw: image, columns of order and of `row` (an array per detection). truth: image, item, box, cls, columns of order.
    """
    found = raw.withColumn("d", decode_detection(row, layout, confidence)).where("d is not null")
    found = found.select("image", *order, F.col("d.box").alias("box"), F.col("d.confidence").alias("conf"), F.col("d.class_id").cast("string").alias("cls"))
    kept = written(W.nms(found, "image", "box", "conf", order, overlap), "detections")
    matches = J.match_boxes(truth, kept, "image", "box", "cls", order, overlap)
    return {"detections": kept, "matches": matches, "by_type": A.error_tally(matches), "by_image": A.error_tally(matches, by=["image"]), "by_item": A.error_items(matches)}


def dashboard(inspections: DataFrame, reviews: DataFrame, events: DataFrame, day: str) -> Tables:
    """overview of a day, states of reviews, and the latest inspections, reviews and events.

    inspections: inspection_id, ts, final_status, review_reasons, latency, predicted_class. reviews: review_id, status, ts.
    events: event_id, ts.
    """
    return {
        "overview": A.overview(inspections, day, "ts", "final_status", "review_reasons", "latency", "predicted_class"), "states": A.state_counts(reviews, "status"),
        "latest_inspections": W.latest(inspections, "ts", "inspection_id", 200), "latest_reviews": W.latest(reviews, "ts", "review_id", 100), "latest_events": W.latest(events, "ts", "event_id", 10),
    }


def reports(quality: DataFrame, benchmarks: DataFrame, json: str, base: str) -> Tables:
    """quality and benchmark metrics of report texts, both in one list, and benchmarks against a base provider.

    quality, benchmarks: name and a column of JSON text; what cannot be read is left out.
    """
    q = A.quality_metrics(files.parse_reports(quality, json), "report").drop(json, "report")
    b = A.benchmark_metrics(files.parse_reports(benchmarks, json), "report").drop(json, "report")
    kind = lambda df, name: df.withColumn("kind", F.lit(name))
    timed = b.where("selected_provider is not null and selected_batch_size is not null")
    return {
        "quality": q, "benchmarks": b, "all": W.union_reports(kind(q, "quality"), kind(b, "benchmark")),
        "compared": J.compare_configs(timed, "selected_provider", "selected_batch_size", "average_latency_ms", "throughput_images_per_second", base),
    }
