"""Decision rules over detector regions, image quality issues and an anomaly result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    low_confidence: float = 0.5
    anomaly_threshold: float = 8.35
    high_risk: tuple[str, ...] = ("R",)
    force_review: bool = False


def decide(df: DataFrame, issues: str, regions: str, score: str, flag: str, failed: str, rules: Rules = Rules()) -> DataFrame:
    """df with review_reasons (sorted, distinct), requires_review, max_confidence and final_status.

    regions: array of structs with class_name and confidence. A missing confidence or score counts as 0.
    """
    r, low = F.coalesce(F.col(regions), F.array().cast(df.schema[regions].dataType)), F.lit(rules.low_confidence)
    confidence = lambda x: F.coalesce(x["confidence"], F.lit(0.0))
    highest = F.coalesce(F.array_max(F.transform(r, confidence)), F.lit(0.0))
    some, broken = F.size(r) > 0, F.coalesce(F.col(failed), F.lit(False))
    odd = F.coalesce(F.col(flag), F.lit(False)) | (F.coalesce(F.col(score), F.lit(0.0)) >= rules.anomaly_threshold)
    risky = F.exists(r, lambda x: x["class_name"].isin(*rules.high_risk) & (confidence(x) >= low)) if rules.high_risk else F.lit(False)
    given = [
        (broken, "INFERENCE_FAILED"), (some & (highest < low), "YOLO_LOW_CONFIDENCE"), (~some & odd, "YOLO_NONE_ANOMALY_HIGH"),
        (some & odd, "MODEL_CONFLICT_OR_UNKNOWN_ANOMALY"), (risky, "HIGH_RISK_DEFECT"), (odd, "UNKNOWN_ANOMALY"), (F.lit(rules.force_review), "FORCE_REVIEW"),
    ]
    told = F.filter(F.array(*[F.when(when, F.lit(name)) for when, name in given]), lambda x: x.isNotNull())
    reasons = F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col(issues), F.array().cast("array<string>")), told)))
    unusable = F.exists(F.col("review_reasons"), lambda x: x.isin("CORRUPT_IMAGE", "RESOLUTION_TOO_SMALL"))
    status = (
        F.when(unusable, "IMAGE_QUALITY_FAILED").when(broken, "INFERENCE_FAILED").when(F.size("review_reasons") > 0, "REVIEW_REQUIRED")
        .when(some, "DEFECT").when(odd, "ANOMALY").otherwise("PASS")
    )
    out = df.withColumn("review_reasons", reasons).withColumn("max_confidence", highest)
    return out.withColumn("requires_review", requires_review(F.col("review_reasons"))).withColumn("final_status", status)


def requires_review(reasons: Column) -> Column:
    return F.size(reasons) > 0


def apply_mode(df: DataFrame, mode: str, issues: str, regions: str, score: str, flag: str, failed: str, rules: Rules = Rules()) -> DataFrame:
    """decide under an inference mode: detection ignores the anomaly result, anomaly decides by it alone where no review
    is due, classical always asks for review."""
    alone = F.col(mode) == "detection"
    seen = df.withColumn("_score", F.when(~alone, F.col(score))).withColumn("_flag", F.when(~alone, F.col(flag)))
    out = decide(seen, issues, regions, "_score", "_flag", failed, rules)
    anomaly = (F.col(mode) == "anomaly") & ~F.col("requires_review")
    by_hand = F.col(mode) == "classical"
    status = F.when(by_hand, "REVIEW_REQUIRED").when(anomaly, F.when(F.col(flag), "ANOMALY").otherwise("PASS")).otherwise(F.col("final_status"))
    reasons = F.when(by_hand, F.array(F.lit("CLASSICAL_MODE_NOT_CONFIGURED_FOR_AUTO_PASS"))).otherwise(F.col("review_reasons"))
    return out.withColumns({"final_status": status, "review_reasons": reasons, "requires_review": by_hand | F.col("requires_review")}).drop("_score", "_flag")


def predicted_class(regions: Column, flag: Column, status: Column) -> Column:
    """Class of the most confident region, the first on ties; else by the anomaly flag and the status."""
    ranked = F.transform(regions, lambda x, i: F.struct(F.coalesce(x["confidence"], F.lit(0.0)).alias("c"), (-i).alias("i"), x["class_name"].alias("name")))
    odd = (status == "ANOMALY") | F.coalesce(flag, F.lit(False))
    return F.when(F.size(regions) > 0, F.array_max(ranked)["name"]).when(odd, "unknown_anomaly").when(status == "PASS", "normal")


def fold_errors(df: DataFrame, steps: dict[str, str]) -> DataFrame:
    """df with errors (`STEP_FAILED: text`, in the order of steps) and inference_failed. steps: name to column of error text."""
    told = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name.upper()}_FAILED: "), F.col(c))) for name, c in steps.items()]
    return df.withColumn("errors", F.filter(F.array(*told), lambda x: x.isNotNull())).withColumn("inference_failed", F.size("errors") > 0)
