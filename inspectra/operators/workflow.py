"""Reviews, feedback, versions and activations: tables that change, as new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import EDGES, export_box
from .windows import class_ids

FINAL = {"approve": "approved", "correct": "corrected", "reject": "rejected"}


def open_reviews(inspections: DataFrame, id: str = "inspection_id") -> DataFrame:
    """One pending review per inspection that requires one, with its original prediction."""
    due = inspections.where("requires_review")
    return due.select(F.concat(F.lit("review-"), F.col(id).cast("string")).alias("review_id"), id, F.lit("pending").alias("status"), "review_reasons", "predicted_class")


def finalize_reviews(reviews: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews after the actions, refused actions with error).

    actions: review_id, action, reviewer, action_id, ts. The first action of a pending review by time, then id, decides;
    later ones, and those on a final review, are REVIEW_STATE_CONFLICT; unknown ids are REVIEW_NOT_FOUND. First actions come
    from an aggregate, so a busy review is no single task's sort.
    """
    first = actions.groupBy("review_id").agg(F.min(F.struct("ts", "action_id", "action", "reviewer")).alias("_f"))
    met = reviews.join(first, "review_id", "left")
    moves = (F.col("status") == "pending") & F.col("_f").isNotNull()
    names = F.create_map(*[F.lit(x) for kv in FINAL.items() for x in kv])
    done = met.withColumn("reviewer", F.when(moves, F.col("_f.reviewer"))).withColumn("decided_by", F.when(moves, F.col("_f.action_id"))).withColumn("status", F.when(moves, names[F.col("_f.action")]).otherwise(F.col("status"))).drop("_f")
    winners = done.select("review_id", F.lit(True).alias("_known"), F.col("decided_by").alias("_won"))
    tried = actions.join(winners, "review_id", "left")
    error = F.when(F.col("_known").isNull(), "REVIEW_NOT_FOUND").when(F.coalesce(F.col("action_id") != F.col("_won"), F.lit(True)), "REVIEW_STATE_CONFLICT")
    return done, tried.withColumn("error", error).where("error is not null").drop("_known", "_won")


def make_feedback(reviews: DataFrame, inspections: DataFrame, id: str = "inspection_id") -> DataFrame:
    """A pending sample per corrected review: its label, else the predicted class, else `unknown`; its boxes, else the
    inspection's regions. reviews: review_id, inspection id, status, corrected_label, corrected_boxes."""
    met = reviews.where("status = 'corrected'").drop("predicted_class", "regions").join(inspections.select(id, "predicted_class", "regions"), id)
    label = F.coalesce(F.nullif("corrected_label", F.lit("")), "predicted_class", F.lit("unknown"))
    return met.select("review_id", id, label.alias("label"), F.coalesce("corrected_boxes", "regions").alias("boxes"), F.lit("pending").alias("export_status"))


def export_feedback(samples: DataFrame, versions: DataFrame, version: str, order: list[str], id: str = "review_id") -> tuple[str | None, DataFrame, DataFrame]:
    """(error, label lines, samples after the export). Nothing is exported if error is set.

    samples: id, label, boxes (array of x1, y1, x2, y2 and class_name), export_status. Errors: DATASET_VERSION_EXISTS,
    NO_FEEDBACK_TO_EXPORT, INVALID_ANNOTATION (a box outside the image). Samples without boxes get one for the whole image,
    unless they are `normal`; `normal` boxes are left out. Class ids follow the first appearance in the order.
    """
    pending = samples.where("export_status = 'pending'")
    whole = F.array(F.struct(*[F.lit(x).alias(e) for e, x in zip(EDGES, (0.0, 0.0, 1.0, 1.0))], F.col("label").alias("class_name")))
    none = F.size(F.coalesce("boxes", F.array().cast(samples.schema["boxes"].dataType))) == 0
    boxes = F.when(none & (F.col("label") != "normal"), whole).otherwise(F.transform("boxes", lambda b: F.struct(*[b[e].cast("double").alias(e) for e in EDGES], b["class_name"].alias("class_name"))))
    each = pending.select(id, *[c for c in order if c != id], F.posexplode(boxes).alias("box", "b")).withColumn("cls", F.coalesce("b.class_name", F.lit("unknown"))).where("cls <> 'normal'")
    lines = each.withColumn("c", export_box(F.col("b"), F.lit(1), F.lit(1))).join(class_ids(each, "cls", [*order, "box"]), "cls")
    bad = F.least(*[F.col(f"c.{x}") for x in ("cx", "cy", "w", "h")]) < 0
    bad = bad | (F.greatest(*[F.col(f"c.{x}") for x in ("cx", "cy", "w", "h")]) > 1)
    lines = lines.withColumn("line", F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "c.cx", "c.cy", "c.w", "c.h"))
    error = None
    if versions.where(F.col("version") == version).limit(1).count():
        error = "DATASET_VERSION_EXISTS"
    elif not pending.limit(1).count():
        error = "NO_FEEDBACK_TO_EXPORT"
    elif lines.where(bad).limit(1).count():
        error = "INVALID_ANNOTATION"
    if error:
        return error, lines.limit(0).select(id, "box", "cls", "class_id", "line"), samples
    done = F.when(F.col("export_status") == "pending", "exported").otherwise(F.col("export_status"))
    stamped = samples.withColumn("dataset_version", F.when(F.col("export_status") == "pending", version)).withColumn("export_status", done)
    return None, lines.select(id, "box", "cls", "class_id", "line"), stamped


def register(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): rows whose key exists, or that repeat a key of the batch after its first row, conflict."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    known = existing.select(*key, F.lit(True).alias("_known")).distinct()
    tried = new.withColumn("_nth", nth).join(known, key, "left")
    refused = F.col("_known").isNotNull() | (F.col("_nth") > 1)
    return tried.where(~refused).drop("_nth", "_known"), tried.where(refused).drop("_nth", "_known")


def activate(models: DataFrame, activations: DataFrame, id: str = "model_id", kind: str = "model_type") -> DataFrame:
    """models with active: the last activation of a type wins, alone; types without one keep what they have.

    activations: id, ts, activation_id. Activating an older version again is the same operation.
    """
    named = activations.join(models.select(id, kind), id)
    last = named.groupBy(kind).agg(F.max_by(id, F.struct("ts", "activation_id")).alias("_winner"))
    return models.join(last, kind, "left").withColumn("active", F.when(F.col("_winner").isNotNull(), F.col(id) == F.col("_winner")).otherwise(F.col("active"))).drop("_winner")


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """existing with the columns of new where the key is there, and the rows of new where it is not; keys are unique."""
    rest = [c for c in existing.columns if c not in key]
    put = new.select(*key, F.struct(*[c for c in rest if c in new.columns]).alias("_new"))
    met = existing.join(put, key, "full_outer")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c)
    return met.select(*key, *[pick(c) for c in rest])


def insert_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new, one per key, whose key existing does not have."""
    return new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def current_state(history: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """The latest row of each entity."""
    last = history.groupBy(entity).agg(F.max_by(F.struct(*history.columns), F.struct(*order)).alias("_r"))
    return last.select("_r.*")
