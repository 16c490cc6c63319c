"""Summaries: distributions, latency, evaluation metrics, normal models, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variants import text_at, tolerant_number
from .joins import apply_model
from .windows import Ranges, _null_safe, counted_before, range_offsets


def class_distribution(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def split_distribution(df: DataFrame, split: str, cls: str) -> DataFrame:
    return df.groupBy(split, cls).agg(F.count(F.lit(1)).alias("n"))


INVALID_ANNOTATION = ("MISSING_ANNOTATION", "EMPTY_ANNOTATION", "MALFORMED_ANNOTATION", "INVALID_CLASS", "OUT_OF_BOUNDS_BOX", "TINY_BOX")


def issue_summary(issues: DataFrame, code: str, codes: tuple[str, ...]) -> DataFrame:
    """One row: issue_count, a count per code (lower case) and the sum of the annotation codes."""
    c = F.col(code)
    return issues.agg(F.count(F.lit(1)).alias("issue_count"), *[F.count_if(c == x).alias(x.lower()) for x in codes], F.count_if(c.isin(*INVALID_ANNOTATION)).alias("invalid_annotation_count"))


def resolutions(df: DataFrame, w: str, h: str) -> DataFrame:
    """A row per resolution: width, height and n."""
    return df.groupBy(F.col(w).alias("width"), F.col(h).alias("height")).agg(F.count(F.lit(1)).alias("n"))


def size_statistics(df: DataFrame, w: str, h: str) -> DataFrame:
    """One row: count, min, max and mean (2 decimals) of both sizes, and how many resolutions there are (see resolutions)."""
    at = resolutions(df, w, h)
    ends = [f(c).alias(f"{c}_{n}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))]
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 2)
    return at.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), *ends, mean("width").alias("width_mean"), mean("height").alias("height_mean"), F.count(F.lit(1)).alias("resolutions"))


def raw_set_summary(images: DataFrame, annotations: DataFrame, w: str = "width", h: str = "height", bad: str = "error") -> DataFrame:
    """One row: images, corrupt ones (width below 0), distinct widths and heights, annotations and invalid ones."""
    a = images.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col(w) < 0).alias("corrupt"), F.count_distinct(F.when(F.col(w) >= 0, F.col(w))).alias("widths"), F.count_distinct(F.when(F.col(h) >= 0, F.col(h))).alias("heights"))
    b = annotations.agg(F.count(F.lit(1)).alias("annotations"), F.count_if(F.col(bad).isNotNull()).alias("invalid"))
    return a.join(b, F.lit(True))


def raw_set_details(images: DataFrame, annotations: DataFrame, path: str, name: str, w: str = "width", h: str = "height", bad: str = "error") -> DataFrame:
    """The lists behind raw_set_summary, a row each: kind (width, height, corrupt or invalid), value and n."""
    good = images.where(F.col(w) >= 0)
    count = lambda df, kind, c: df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    parts = [count(good, "width", w), count(good, "height", h), count(images.where(F.col(w) < 0), "corrupt", path), count(annotations.where(F.col(bad).isNotNull()), "invalid", name)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def overview(inspections: DataFrame, day: str, ts: str, status: str, reasons: str, latency: str, cls: str) -> DataFrame:
    """One row for a day: counts, rates and mean latency; class counts of all days as `distribution`.

    pending: any reason, whatever was reviewed; reviewed: REVIEW_REQUIRED without reasons; the mean skips null and 0.
    """
    today, has = F.to_date(F.col(ts)) == F.lit(day).cast("date"), F.size(F.col(reasons)) > 0
    n = F.count_if(today)
    defects = F.count_if(today & F.col(status).isin("DEFECT", "ANOMALY"))
    timed = F.avg(F.when(today & (F.col(latency) != 0), F.col(latency)))
    by_class = inspections.groupBy(F.coalesce(F.col(cls), F.lit("unknown")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    held = by_class.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("distribution"))
    one = inspections.agg(
        n.alias("today"), defects.alias("defects"), (defects / F.greatest(n, F.lit(1))).alias("defect_rate"), F.count_if(today & (F.col(status) == "PASS")).alias("auto_pass"),
        F.count_if(today & has).alias("pending"), F.count_if(today & (F.col(status) == "REVIEW_REQUIRED") & ~has).alias("reviewed"), F.coalesce(timed, F.lit(0.0)).alias("mean_latency"),
    )
    return one.join(held, F.lit(True))


def quality_metrics(reports: DataFrame, report: str) -> DataFrame:
    """Metrics of quality reports (VARIANT column), a row each. valid_images subtracts corrupt and unsupported files from the
    total although it leaves them out already; the count of problem images is null when issues were cut."""
    v = F.col(report)
    n = lambda *p: tolerant_number(v, *p)
    zero = lambda *p: F.coalesce(n(*p), F.lit(0.0))
    total, found = n("$.summary.total_images", "$.total_images", "$.image_size_statistics.count"), n("$.summary.issue_count", "$.issue_count")
    rows = F.coalesce(F.try_variant_get(v, "$.issues", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(rows, lambda x: F.startswith(F.coalesce(F.schema_of_variant(x), F.lit("")), F.lit("OBJECT")))
    paths = F.array_distinct(F.filter(F.transform(objects, lambda x: F.try_variant_get(x, "$.path", "string")), lambda p: p.isNotNull() & (p != "")))
    cut = found.isNotNull() & (F.size(objects) < found)
    share = lambda p: F.when(total > 0, zero(p) / total)
    stats = {f"{a}_{b}": n(f"$.image_size_statistics.{a}.{b}") for a in ("width", "height") for b in ("min", "mean", "max")}
    return reports.select("*", total.alias("total_images"), F.when(total.isNotNull(), F.greatest(total - zero("$.summary.corrupt_count") - zero("$.summary.unsupported_format_count"), F.lit(0.0))).alias("valid_images"),
        F.when(~cut, F.size(paths)).alias("problem_image_count"), found.alias("issue_finding_count"), F.size(objects).alias("issue_sample_count"), cut.alias("issues_truncated"),
        *[c.alias(k) for k, c in stats.items()], n("$.summary.blurry_count").alias("blur_issue_count"), share("$.summary.overexposed_count").alias("bright_ratio"), share("$.summary.underexposed_count").alias("dark_ratio"),
        text_at(v, "$.created_at", "$.generated_at").alias("generated_at"), (found == 0).alias("valid"))


def benchmark_metrics(reports: DataFrame, report: str) -> DataFrame:
    """Normalised metrics of benchmark reports (VARIANT column), a row each; the row of results with the lowest latency
    counts, a latency of 0 as none, the first on ties."""
    v = F.col(report)
    rows = F.coalesce(F.try_variant_get(v, "$.results", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(rows, lambda x: F.startswith(F.coalesce(F.schema_of_variant(x), F.lit("")), F.lit("OBJECT")))
    ms = lambda x: tolerant_number(x, "$.average_latency_ms", "$.avg_ms")
    ranked = F.transform(objects, lambda x, i: F.struct(F.coalesce(F.nullif(ms(x), F.lit(0.0)), F.lit(float("inf"))).alias("ms"), i.alias("i")))
    best = F.get(objects, F.array_min(ranked)["i"])
    of = reports.withColumn("_rows", F.size(objects)).withColumn("_best", best)
    b = F.col("_best")
    n = lambda own, *p: F.coalesce(*[tolerant_number(b, f"$.{x}") for x in own], *[tolerant_number(v, f"$.{x}") for x in p])
    errors, good = n((), "metrics.error_count", "summary.error_count", "error_count"), n((), "metrics.success_count", "summary.success_count", "success_count")
    total = F.coalesce(n((), "metrics.total_count", "summary.total_count", "total_count", "image_count_used"), tolerant_number(b, "$.measured_iterations"))
    said_good, said_bad = n((), "metrics.success_rate", "summary.success_rate", "success_rate"), n((), "metrics.error_rate", "summary.error_rate", "error_rate")
    rate = lambda said, count: F.coalesce(said, F.when(total != 0, count / total))
    quiet = (F.col("_rows") > 0) & rate(said_good, good).isNull() & rate(said_bad, errors).isNull()
    return of.select(*reports.columns,
        n(("average_latency_ms", "avg_ms"), "metrics.average_latency_ms", "summary.average_latency_ms", "average_latency_ms", "latency.average_ms", "latency.mean_ms").alias("average_latency_ms"),
        n(("p50_latency_ms", "p50_ms"), "percentiles.p50", "percentiles['50']", "latency.p50_ms", "metrics.p50_latency_ms", "p50_latency_ms").alias("p50_latency_ms"),
        n(("p95_latency_ms", "p95_ms"), "percentiles.p95", "percentiles['95']", "latency.p95_ms", "metrics.p95_latency_ms", "p95_latency_ms").alias("p95_latency_ms"),
        n(("throughput_images_per_second", "throughput", "fps"), "metrics.throughput_images_per_second", "metrics.throughput", "summary.throughput_images_per_second", "throughput_images_per_second").alias("throughput_images_per_second"),
        F.when(quiet, 1.0).otherwise(rate(said_good, good)).alias("success_rate"), F.when(quiet, 0.0).otherwise(rate(said_bad, errors)).alias("error_rate"),
        text_at(v, "$.created_at", "$.generated_at").alias("generated_at"), F.try_variant_get(b, "$.provider", "string").alias("selected_provider"), tolerant_number(b, "$.batch_size").alias("selected_batch_size"))


def values_at(df: DataFrame, value: str, places: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """A row per group (or one) with the value at every 0-based place of its sorted values that are not null; places are
    columns of `_t`, the number of these values. Exact, by selection: values are dealt into ranges by constant split points,
    counts tell the ranges that hold the places, and only the distinct values of those are shuffled and sorted."""
    by = group or []
    gs = [f"_g{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, gs)], F.col(value).alias("_x"))
    dealt = rows.withColumn("_p", Ranges(rows, ["_x"]).of())
    offsets = range_offsets(dealt, F.lit(1), gs)
    holds = lambda k, lo, n: (lo <= k) & (k < lo + n)
    wanted = offsets.where(reduce(lambda a, b: a | b, [holds(k, F.col("_b"), F.col("_c")) for k in places.values()]))
    wanted = wanted.select(*[F.col(g).alias(f"{g}w") for g in gs], "_q", "_b", "_t")
    met = dealt.join(wanted, _null_safe([F.col(g) for g in gs], [F.col(f"{g}w") for g in gs]) & (F.col("_p") == F.col("_q")))
    each = met.groupBy(*gs, "_p", "_b", "_t", "_x").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*gs, "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("_b", F.col("_b") + upto - F.col("_n"))
    found = placed.groupBy(*gs).agg(F.max("_t").alias("_t"), *[F.max(F.when(holds(k, F.col("_b"), F.col("_n")), F.col("_x"))).alias(c) for c, k in places.items()])
    return found.select(*[F.col(g).alias(c) for c, g in zip(by, gs)], "_t", *places)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """A row per group (or one) with an interpolated quantile for every name; exact, by selection (see values_at)."""
    by, place = group or [], lambda share: (F.col("_t") - 1) * F.lit(share)
    ends = {f"{n}_{i}": f(place(q)) for n, q in shares.items() for i, f in enumerate((F.floor, F.ceil))}
    part = lambda n, q: F.col(f"{n}_0") + (F.col(f"{n}_1") - F.col(f"{n}_0")) * (place(q) - F.floor(place(q)))
    return values_at(df, value, ends, by).select(*by, *[part(n, q).alias(n) for n, q in shares.items()])


def latency_summary(df: DataFrame, group: str, ms: str, batch: Column | None = None) -> DataFrame:
    """Per group: mean, interpolated p50, p95 and p99, throughput for the batch size, fps for batches of 1 only."""
    size = F.lit(1) if batch is None else batch
    means = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean_ms"), F.max(size).alias("batch_size"))
    p = quantiles(df, ms, {f"p{q}_ms": q / 100 for q in (50, 95, 99)}, [group])
    out = means.join(p, F.col("_group").eqNullSafe(F.col(group)), "left")
    rate = F.when(F.col("mean_ms") > 0, 1000 * F.col("batch_size") / F.col("mean_ms"))
    return out.select(F.col("_group").alias(group), "n", "mean_ms", "p50_ms", "p95_ms", "p99_ms", rate.alias("throughput"), F.when(F.col("batch_size") == 1, rate).alias("fps"))


def nearest_rank(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row `value`: the element at half-even rounded (n - 1) q of the sorted values, 3 decimals, 0 without any."""
    at = values_at(df, value, {"x": F.bround((F.col("_t") - 1) * q).cast("long")})
    return at.agg(F.coalesce(F.round(F.max("x"), 3), F.lit(0.0)).alias("value"))


def run_summary(df: DataFrame, ok: Column, status: str, review: Column, repeat: Column, ms: str, q: float = 0.95) -> DataFrame:
    """One row: sent, ok, failed, auto_pass, review, repeats, mean_ms and nearest-rank p95_ms of the good rows."""
    one = df.agg(
        F.count(F.lit(1)).alias("sent"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.col(status) == "PASS")).alias("auto_pass"),
        F.count_if(ok & review).alias("review"), F.count_if(ok & repeat).alias("repeats"), F.coalesce(F.round(F.avg(F.when(ok, F.col(ms))), 3), F.lit(0.0)).alias("mean_ms"),
    )
    return one.join(nearest_rank(df.where(ok), ms, q).withColumnRenamed("value", "p95_ms"), F.lit(True))


def mid_ranks(df: DataFrame, score: str, group: list[str] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Distinct scores (per group) with n, sums and mid_rank; ranks are counted in ranges of constant split points."""
    by = group or []
    each = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in (sums or {}).items()])
    return counted_before(each, [score], "n", "_before", by).withColumn("mid_rank", F.col("_before") + (F.col("n") + 1) / 2).drop("_before")


def auroc(df: DataFrame, label: str, score: str, group: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with mid-ranks for ties, null where a class is missing; one row, or one per group.

    Scores are dealt into ranges by constant split points and ranked within them; a range's positives move up by the
    counts of the ranges before, which are few rows, so ranks are never joined back to scores.
    """
    by = group or []
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*by, F.col(score).alias("_x"), F.col(label).cast("long").alias("_y"))
    dealt = rows.withColumn("_p", Ranges(rows, ["_x"]).of())
    each = dealt.groupBy(*by, "_p", "_x").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p"))
    upto = F.sum("n").over(Window.partitionBy(*by, "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    twice = each.withColumn("r", 2 * upto - F.col("n") + 1)  # twice the mid-rank within the range: a whole number
    parts = twice.groupBy(*by, "_p").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("r") * F.col("p")).cast("decimal(38,0)").alias("r"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    moved = parts.withColumn("r", F.col("r") + 2 * before.cast("decimal(19,0)") * F.col("p").cast("decimal(18,0)"))
    pos, neg = F.sum("p").cast("double"), F.sum(F.col("n") - F.col("p")).cast("double")
    area = F.when((pos > 0) & (neg > 0), (F.sum("r").cast("double") / 2 - pos * (pos + 1) / 2) / (pos * neg))
    return moved.groupBy(*by).agg(area.alias("auroc"))


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, fpr, fnr; a score at the threshold is positive."""
    said, is_ = F.col(score) >= threshold, F.col(label) == 1
    c = df.agg(*[F.count_if(x).alias(n) for n, x in (("tp", said & is_), ("fp", said & ~is_), ("fn", ~said & is_), ("tn", ~said & ~is_))])
    share = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    c = c.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    return c.withColumn("f1", f1).withColumn("fpr", share("fp", "tn")).withColumn("fnr", share("fn", "tp"))


def fit_normal_model(long_df: DataFrame, pos: str, channel: str, x: str) -> DataFrame:
    """pos, channel, mean and population standard deviation of at least 1e-4."""
    return long_df.groupBy(pos, channel).agg(F.avg(x).alias("mean"), F.greatest(F.stddev_pop(x), F.lit(1e-4)).alias("std"))


def position_scores(long_df: DataFrame, model: DataFrame, id: str, pos: str, channel: str, x: str) -> DataFrame:
    """id, pos and score: root mean square of z over the channels."""
    z = apply_model(long_df, model, pos, channel, x)
    return z.groupBy(id, pos).agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("score"))


def anomaly_scores(long_df: DataFrame, model: DataFrame, id: str, pos: str, channel: str, x: str) -> DataFrame:
    """id and score: the largest position score."""
    return position_scores(long_df, model, id, pos, channel, x).groupBy(id).agg(F.max("score").alias("score"))


def thresholds(scores: DataFrame, positions: DataFrame, image_q: float, position_q: float, accuracy: int | None = None) -> DataFrame:
    """One row: image_threshold and position_threshold, interpolated quantiles; with accuracy, an approximate one for
    positions, in one pass."""
    deep = positions.agg(F.percentile_approx("score", position_q, accuracy).alias("position_threshold")) if accuracy else quantiles(positions, "score", {"position_threshold": position_q})
    return quantiles(scores, "score", {"image_threshold": image_q}).join(deep, F.lit(True))


def evaluate(scores: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row: auroc and the confusion metrics."""
    return auroc(scores, label, score).join(confusion(scores, label, score, threshold), F.lit(True))


def failure_cases(scores: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Rows that the threshold gets wrong, with kind: false_positive or false_negative."""
    said, is_ = F.col(score) >= threshold, F.col(label) == 1
    return scores.withColumn("kind", F.when(said & ~is_, "false_positive").when(~said & is_, "false_negative")).where("kind is not null")


def hash_groups(df: DataFrame, id: str, hash: str, split: str) -> DataFrame:
    """Groups of equal hashes: size, smallest and largest id, and n_splits (over 1: leakage). Ids are not collected."""
    out = df.groupBy(hash).agg(F.count(F.lit(1)).alias("size"), F.min(id).alias("first_id"), F.max(id).alias("last_id"), F.count_distinct(split).alias("n_splits"))
    return out.where("size > 1")


def dataset_manifest(images: DataFrame, masks: DataFrame, group: str, label: str, size: str, bad: Column) -> DataFrame:
    """Per group: images, distinct labels, corrupt images, sizes as text map in order, masks."""
    a = images.groupBy(group).agg(F.count(F.lit(1)).alias("images"), F.count_distinct(label).alias("labels"), F.count_if(bad).alias("corrupt"))
    sizes = images.groupBy(group, size).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.count(F.lit(1)).alias("sizes"), F.max("n").alias("most_of_a_size"))
    m = masks.groupBy(group).agg(F.count(F.lit(1)).alias("masks"))
    return a.join(sizes, group).join(m, group, "left").na.fill(0, ["masks"])


def manifest_details(images: DataFrame, group: str, path: str, size: str, hash: str, bad: Column) -> DataFrame:
    """The lists behind dataset_manifest, a row each: group, kind (corrupt, hash or size), name and value (hash or count)."""
    corrupt = images.where(bad).select(group, F.lit("corrupt").alias("kind"), F.col(path).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))
    hashes = images.select(group, F.lit("hash").alias("kind"), F.col(path).cast("string").alias("name"), F.col(hash).cast("string").alias("value"))
    sizes = images.where(~bad).groupBy(group, size).agg(F.count(F.lit(1)).alias("n")).select(group, F.lit("size").alias("kind"), F.col(size).cast("string").alias("name"), F.col("n").cast("string").alias("value"))
    return corrupt.unionByName(hashes).unionByName(sizes)


def error_tally(matches: DataFrame, outcome: str = "outcome", by: list[str] | None = None) -> DataFrame:
    """Errors by type and in total (type null); with `by`, by these columns (such as the image) and type."""
    errors = matches.where(F.col(outcome) != "hit")
    return (errors.groupBy(*by, outcome) if by else errors.rollup(outcome)).agg(F.count(F.lit(1)).alias("n"))


def error_items(matches: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Every single error: the place in its image and its type."""
    return matches.where(F.col(outcome) != "hit")


def state_counts(df: DataFrame, state: str) -> DataFrame:
    return df.groupBy(state).agg(F.count(F.lit(1)).alias("n"))


def class_bars(df: DataFrame, cls: str) -> DataFrame:
    """Counts with width: percent of the largest class, 4 at least."""
    n = class_distribution(df, cls)
    top = n.agg(F.max("n").alias("_top"))
    return n.join(F.broadcast(top), F.lit(True)).withColumn("width", F.greatest(100 * F.col("n") / F.col("_top"), F.lit(4.0))).drop("_top")


def otsu_threshold(df: DataFrame, group: str, level: str) -> DataFrame:
    """Per group: the level t that gives the largest between-class variance of levels <= t and > t, the first on ties."""
    h = df.groupBy(group, level).agg(F.count(F.lit(1)).alias("n"))
    whole, upto = Window.partitionBy(group), Window.partitionBy(group).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("n") * F.col(level)
    s = h.select(group, level, F.sum("n").over(upto).alias("n0"), F.sum(weight).over(upto).alias("s0"), F.sum("n").over(whole).alias("nt"), F.sum(weight).over(whole).alias("st"))
    n1 = F.col("nt") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / F.nullif(n1, F.lit(0))
    v = F.coalesce(F.round(F.col("n0") * n1 * gap * gap / (F.col("nt") * F.col("nt")), 9), F.lit(0.0))
    return s.withColumn("v", v).groupBy(group).agg(F.min_by(level, F.struct(-F.col("v"), F.col(level))).alias("threshold"), F.max("v").alias("variance"))


def minmax_255(df: DataFrame, image: str, x: str) -> DataFrame:
    """df with scaled: x from 0 to 255 within its image, 0 where flat. The bounds come from an aggregate and a join, so a
    large image is no single task's work."""
    ends = df.groupBy(image).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), F.floor(255 * (F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).otherwise(0).cast("int")
    return df.join(ends, image).withColumn("scaled", scaled).drop("_lo", "_hi")
