"""Joins between images, annotations, detections, reviews and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hamming
from ..sources.shared import written
from .overlaps import CELL, FEW, apart, assigned, busy, outcomes_of_lists, overlapping
from .windows import CROWDED, crowded


def annotation_presence(images: DataFrame, labels: DataFrame, keys: list[str], text: str | None = None) -> DataFrame:
    """images with annotation: MISSING_ANNOTATION, EMPTY_ANNOTATION (label text without a non-blank line) or null."""
    there = labels.select(*keys, F.lit(True).alias("_there"), (F.trim(F.coalesce(F.col(text), F.lit(""))) == "" if text else F.lit(False)).alias("_empty"))
    met = images.join(there.groupBy(*keys).agg(F.first("_there").alias("_there"), F.bool_and("_empty").alias("_empty")), keys, "left")
    return met.withColumn("annotation", F.when(F.col("_there").isNull(), "MISSING_ANNOTATION").when(F.col("_empty"), "EMPTY_ANNOTATION")).drop("_there", "_empty")


def missing_images(annotations: DataFrame, images: DataFrame, key: str) -> DataFrame:
    return annotations.join(images.select(key), key, "left_anti")


def pair_by_stem(images: DataFrame, annotations: DataFrame, stem: str) -> DataFrame:
    """A row per stem with n_images, n_annotations and state: matched, unmatched_image, unmatched_annotation or duplicate."""
    a, b = images.groupBy(stem).agg(F.count(F.lit(1)).alias("n_images")), annotations.groupBy(stem).agg(F.count(F.lit(1)).alias("n_annotations"))
    both = a.join(b, stem, "full_outer").na.fill(0, ["n_images", "n_annotations"])
    state = F.when((F.col("n_images") > 1) | (F.col("n_annotations") > 1), "duplicate").when(F.col("n_annotations") == 0, "unmatched_image").when(F.col("n_images") == 0, "unmatched_annotation").otherwise("matched")
    return both.withColumn("state", state)


def exact_leakage(df: DataFrame, id: str, hash: str, split: str) -> DataFrame:
    """The rows whose hash is in several splits: first_id, the smallest id of the hash (the class), and links, how many
    rows of other splits have the same hash. Linear in the rows: copies are not expanded into pairs.
    """
    each = df.groupBy(hash, split).agg(F.count(F.lit(1)).alias("here"), F.min(id).alias("first_id"))
    whole = each.groupBy(hash).agg(F.sum("here").alias("all"), F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("splits")).where("splits > 1")
    leaks = each.select(hash, split, "here").join(whole, hash).select(hash, split, "first_id", (F.col("all") - F.col("here")).alias("links"))
    return df.join(leaks, [hash, split])


def split_hash_leakage(train: DataFrame, val: DataFrame, name: str, hash: str) -> DataFrame:
    """Training rows whose hash is in validation, with the last validation name of that hash."""
    last = val.groupBy(hash).agg(F.max(name).alias("val_name"))
    return train.select(F.col(name).alias("train_name"), hash).join(last, hash)


def _low(n: Column) -> Column:
    """The n lowest bits, n from 0 to 64."""
    return F.when(n > 0, F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - n)).otherwise(F.lit(0).cast("long"))


def _banded(rows: DataFrame, t: int) -> DataFrame:
    """rows (h, key, rest, left) once for each of t + 1 bands of the left lowest bits of rest: key takes up the band and its
    value, rest keeps the other bits, moved together."""
    cut = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(t))))
    start = lambda i: F.floor(i * F.col("left") / (t + 1)).cast("int")
    cut = cut.withColumns({"a": start(F.col("i")), "b": start(F.col("i") + 1)})
    right = lambda x, n: F.call_function("shiftrightunsigned", F.col(x), n)
    value = right("rest", F.least("a", F.lit(63))).bitwiseAND(_low(F.col("b") - F.col("a")))
    above = F.when(F.col("b") < 64, F.call_function("shiftleft", right("rest", F.col("b")), F.col("a"))).otherwise(F.lit(0).cast("long"))
    return cut.select("h", F.xxhash64("key", "i", value).alias("key"), above.bitwiseOR(F.col("rest").bitwiseAND(_low(F.col("a")))).alias("rest"), (F.col("left") - F.col("b") + F.col("a")).alias("left"))


def hash_buckets(hashes: DataFrame, t: int, bits: int = 64, crowd: int = 2000) -> DataFrame:
    """h and key for distinct hashes h, such that two hashes that differ in at most t of the lowest bits share a key.

    t + 1 disjoint bands of bits: two such hashes agree in one band at least. A band value that more than crowd hashes have
    is cut again by t + 1 bands of its other bits, in which two such hashes differ in at most t bits as well, and so on. A
    key whose hashes have at most t bits left is not cut: all its pairs are within t. So no key holds more than crowd
    hashes but for pairs that are all results.
    """
    rows = _banded(hashes.select("h", F.lit(0).cast("long").alias("key"), F.col("h").bitwiseAND(_low(F.lit(bits))).alias("rest"), F.lit(bits).alias("left")), t)
    done: DataFrame | None = None
    while True:
        rows = written(rows, "bands")
        many = rows.where(F.col("left") > t).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key")
        if many.isEmpty():
            last = rows.select("h", "key")
            return last if done is None else done.unionByName(last)
        many = written(many, "crowded-bands")
        few = rows.join(many, "key", "left_anti").select("h", "key")
        done = few if done is None else done.unionByName(few)
        rows = _banded(rows.join(many, "key", "left_semi").select("h", "key", "rest", "left"), t)


def near_duplicates(df: DataFrame, id: str, hash64: str, content_hash: str, t: int, bits: int = 64, crowd: int = 2000) -> DataFrame:
    """Pairs (first_id < second_id) whose hashes differ in at most t bits and whose contents differ; distance.

    Distinct hashes meet through hash_buckets, which loses no pair and cuts crowded band values; the hashes' contents and
    rows are joined afterwards, so equal rows and contents cost their own size. Rows with a null hash or content pair with
    nothing.
    """
    kinds = df.select(F.col(hash64).alias("h"), F.col(content_hash).alias("c")).where("h is not null and c is not null").distinct()
    met = hash_buckets(kinds.select("h").distinct(), t, bits, crowd)
    close = met.toDF("h1", "key").join(met.toDF("h2", "key"), "key").where((F.col("h1") < F.col("h2")) & (hamming(F.col("h1"), F.col("h2")) <= t))
    hashes = close.select("h1", "h2").distinct()
    one, two = kinds.toDF("h1", "c1"), kinds.toDF("h2", "c2")
    unlike = hashes.join(one, "h1").join(two, "h2").where("c1 <> c2").select("h1", "c1", "h2", "c2")
    same = one.join(two, F.col("h1") == F.col("h2")).where("c1 < c2").select("h1", "c1", "h2", "c2")
    rows = df.select(F.col(id).alias("i"), F.col(hash64).alias("h"), F.col(content_hash).alias("c"))
    pairs = unlike.unionByName(same).join(rows.toDF("i1", "h1", "c1"), ["h1", "c1"]).join(rows.toDF("i2", "h2", "c2"), ["h2", "c2"])
    return pairs.select(F.least("i1", "i2").alias("first_id"), F.greatest("i1", "i2").alias("second_id"), hamming(F.col("h1"), F.col("h2")).alias("distance"))


def near_leakage(df: DataFrame, id: str, hash64: str, content_hash: str, split: str, t: int, bits: int = 64) -> DataFrame:
    """near_duplicates in different splits."""
    where = df.select(F.col(id).alias("i"), F.col(split).alias("s"))
    out = near_duplicates(df, id, hash64, content_hash, t, bits)
    out = out.join(where.toDF("first_id", "first_split"), "first_id").join(where.toDF("second_id", "second_split"), "second_id")
    return out.where("first_split <> second_split")


def match_boxes(
    truth: DataFrame, pred: DataFrame, image: str, box: str, cls: str, order: list[str], threshold: float = 0.5, cell: float = CELL, most: int = CROWDED, few: int = FEW
) -> DataFrame:
    """Greedy matching in truth order, blind to class, the first best prediction winning; a row per outcome.

    An image with `few` boxes at most on either side is settled in lists. The boxes of the others meet in grid cells of a side
    of `cell`, and only pairs of at least the threshold go into an image's greedy pass; an image with more than `most` of them is
    settled in rounds of joins. The result is the same. outcome: hit, class_error, missed (no prediction with IoU of at least the
    threshold left) or false_positive; at is the 1-based place of the truth, or of the prediction for a false positive. Images
    without truth rows are skipped.
    """
    w = Window.partitionBy(image).orderBy(*order)
    placed = lambda df: df.select(image, F.row_number().over(w).alias("at"), F.col(box).alias("box"), F.col(cls).cast("string").alias("cls"))
    many = busy(image, few, truth, pred)
    if many is None:
        return outcomes_of_lists(placed(truth), placed(pred), image, threshold)
    (small_t, large_t), (small_p, large_p) = apart(truth, image, many), apart(pred, image, many)
    settled = outcomes_of_lists(placed(small_t), placed(small_p), image, threshold)
    return settled.unionByName(_matched_in_cells(placed(large_t), placed(large_p), image, threshold, cell, most))


def _matched_in_cells(t: DataFrame, p: DataFrame, image: str, threshold: float, cell: float, most: int) -> DataFrame:
    met = overlapping(t.toDF(image, "t", "left_box", "t_cls"), p.toDF(image, "p", "right_box", "p_cls"), image, "box", None, cell)
    rated = met.where(F.col("iou") >= threshold).select(image, "t", "p", F.coalesce(F.col("t_cls") == F.col("p_cls"), F.lit(False)).alias("same"), "iou")
    rated, full = crowded(written(rated, "offers"), image, most)
    offers = rated.groupBy(image, "t").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("minus"), "p", "same"))).alias("offers"))
    lists = offers.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("t", "offers"))).alias("lists"))
    taken = "array<struct<t: int, p: int, same: boolean>>"

    def step(done: Column, x: Column) -> Column:
        free = F.filter(x["offers"], lambda o: ~F.exists(done, lambda d: d["p"] == o["p"]))
        return F.when(F.size(free) > 0, F.array_append(done, F.struct(x["t"].alias("t"), F.get(free, 0)["p"].alias("p"), F.get(free, 0)["same"].alias("same")))).otherwise(done)

    pairs = lists.select(image, F.explode(F.aggregate("lists", F.array().cast(taken), step)).alias("m")).select(image, "m.t", "m.p", "m.same")
    if full is not None:
        pairs = pairs.unionByName(assigned(full, image))
    outcome = F.when(F.col("same").isNull(), "missed").when(F.col("same"), "hit").otherwise("class_error")
    hits = t.withColumnRenamed("at", "t").join(pairs.select(image, "t", "same"), [image, "t"], "left").select(image, F.col("t").alias("at"), outcome.alias("outcome"))
    seen = p.join(t.select(image).distinct(), image, "left_semi").join(pairs.select(image, F.col("p").alias("at")), [image, "at"], "left_anti")
    return hits.unionByName(seen.select(image, "at", F.lit("false_positive").alias("outcome")))


def review_detail(reviews: DataFrame, inspections: DataFrame, logs: DataFrame) -> DataFrame:
    """reviews (review_id, inspection_id) with their inspection's columns and history: log entries of either id by time.

    logs: entity_id, action, created_at.
    """
    ids = reviews.select("review_id", F.explode(F.array_distinct(F.array("review_id", "inspection_id"))).alias("entity_id"))
    told = ids.join(logs, "entity_id").groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "action", "entity_id"))).alias("history"))
    return reviews.join(inspections, "inspection_id").join(told, "review_id", "left")


def pair_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images (image, defect, stem) with mask: that named <stem>_mask before <stem>, none for defect `good`. masks: mask, defect, stem."""
    named = masks.select("mask", F.col("defect").alias("_d"), F.regexp_replace("stem", "_mask$", "").alias("_s"), F.when(F.col("stem").endswith("_mask"), 0).otherwise(1).alias("_rank"))
    best = named.groupBy("_d", "_s").agg(F.min_by("mask", F.struct("_rank", "mask")).alias("mask"))
    return images.join(best, (F.col("defect") == F.col("_d")) & (F.col("stem") == F.col("_s")) & (F.col("defect") != "good"), "left").drop("_d", "_s")


def apply_model(long_df: DataFrame, model: DataFrame, pos: str, channel: str, x: str) -> DataFrame:
    """long_df with mean, std and z of its position and channel. The model has one row per position: Spark broadcasts it
    while it is small."""
    met = long_df.join(model.select(pos, channel, "mean", "std"), [pos, channel])
    return met.withColumn("z", (F.col(x) - F.col("mean")) / F.col("std"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose foreign key is set and has no parent."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def null_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """child with foreign keys that have no parent set to null."""
    known = parent.select(F.col(pk).alias(fk), F.lit(True).alias("_known")).distinct()
    return child.join(known, fk, "left").withColumn(fk, F.when(F.col("_known"), F.col(fk))).select(*child.columns)


def attach_models(df: DataFrame, models: DataFrame, kind: str, requested: str | None = None) -> DataFrame:
    """df with model_id of the active model of its kind; a requested version counts for kind `detection` only.

    models: model_type, version, model_id, active.
    """
    active = models.where("active").groupBy(F.col("model_type").alias(kind)).agg(F.min("model_id").alias("_active"))
    out = df.join(active, kind, "left")
    if requested:
        asked = models.where("model_type = 'detection'").groupBy(F.col("version").alias(requested)).agg(F.min("model_id").alias("_asked"))
        out = out.join(asked, requested, "left")
        return out.withColumn("model_id", F.when((F.col(kind) == "detection") & F.col(requested).isNotNull(), F.col("_asked")).otherwise(F.col("_active"))).drop("_active", "_asked")
    return out.withColumnRenamed("_active", "model_id")


def stamp_version(samples: DataFrame, versions: DataFrame) -> DataFrame:
    """samples with version_id, by version."""
    return samples.join(versions.select("version", "version_id"), "version", "left")


def compare_configs(df: DataFrame, config: str, batch: str, latency: str, throughput: str, base: str) -> DataFrame:
    """Mean latency and throughput of each configuration and batch against the base configuration: speed-ups."""
    each = df.groupBy(batch, config).agg(F.avg(latency).alias("latency"), F.avg(throughput).alias("throughput"))
    w = Window.partitionBy(batch)
    of_base = lambda c: F.max(F.when(F.col(config) == base, F.col(c))).over(w)
    out = each.withColumn("latency_speedup", of_base("latency") / F.col("latency")).withColumn("throughput_speedup", F.col("throughput") / of_base("throughput"))
    return out.where(F.col(config) != base)


def compare_outputs(a: DataFrame, b: DataFrame, keys: list[str], x: str, atol: float, rtol: float) -> DataFrame:
    """One row: rows of either side, whether shapes are equal, largest absolute difference, whether all are close."""
    met = a.select(*keys, F.col(x).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(*keys, F.col(x).alias("_b"), F.lit(1).alias("_in_b")), keys, "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return met.agg(
        F.count("_in_a").alias("n_a"), F.count("_in_b").alias("n_b"), F.coalesce(F.bool_and(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()), F.lit(True)).alias("same_shape"),
        F.max(gap).alias("max_abs_diff"), F.coalesce(F.bool_and(gap <= atol + rtol * F.abs(F.col("_b"))), F.lit(True)).alias("all_close"),
    )


def override_metrics(models: DataFrame, evaluations: DataFrame, name: str, requested: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Requested models (model_id) with metrics of the evaluation of that name before the registry's; error MODEL_NOT_FOUND."""
    told = evaluations.groupBy(name).agg(F.max(metrics).alias("_told"))
    met = requested.join(models, "model_id", "left").join(told, name, "left")
    return met.withColumn("error", F.when(F.col(name).isNull(), "MODEL_NOT_FOUND")).withColumn(metrics, F.coalesce("_told", metrics)).drop("_told")
