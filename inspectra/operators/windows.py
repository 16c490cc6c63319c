"""Ordered picks, splits, duplicates, top lists and set operations. Every order is an explicit, total one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .overlaps import CELL, FEW, apart, busy, kept_of_lists, overlapping, suppressed


def first_by_key(df: DataFrame, key: str, order: list, history: DataFrame | None = None) -> DataFrame:
    """The first row of each key that history does not have; rows with a null key all pass.

    A hot key is reduced before the shuffle (the least of its rows), not sorted in one task.
    """
    keyed = df.where(F.col(key).isNotNull())
    if history is not None:
        keyed = keyed.join(history.select(key), key, "left_anti")
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*df.columns), rank).alias("_row")).select("_row.*")
    return first.unionByName(df.where(F.col(key).isNull()))


def exact_duplicates(df: DataFrame, id: str, hash: str, order: list[str]) -> DataFrame:
    """All rows but the first of a hash group, with duplicate_of."""
    first = df.groupBy(hash).agg(F.min(F.struct(*order, F.col(id).alias("_first"))).alias("_f"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(hash, F.col("_f._first").alias("duplicate_of"))
    return df.join(first, hash).where(F.col(id) != F.col("duplicate_of"))


def _seeded(seed: int, id: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string")))


def stratified_split(df: DataFrame, id: str, cls: str, ratios: tuple[float, float] = (0.7, 0.2), seed: int = 42) -> DataFrame:
    """df with split: exact half-even counts of train and val per class, the rest test, in a seeded order.

    The membership is a function of seed and ids; it is not that of any library's shuffle. A class is placed by counts of
    its hash prefixes, so no task sorts a whole class.
    """
    h = df.withColumn("_h", _seeded(seed, id)).withColumn("_p", F.substring("_h", 1, 4))
    w = Window.partitionBy(cls)
    counts = h.groupBy(cls, "_p").agg(F.count(F.lit(1)).alias("_c"))
    upto, n = F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)), F.sum("_c").over(w)
    placed = counts.select(F.col(cls).alias("_k"), F.col("_p").alias("_q"), (upto - F.col("_c")).alias("_before"), F.bround(n * ratios[0]).alias("_train"), F.bround(n * ratios[1]).alias("_val"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy(cls, "_p").orderBy("_h", id))
    met = h.join(placed, F.col(cls).eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_q")))
    split = F.when(at <= F.col("_train"), "train").when(at <= F.col("_train") + F.col("_val"), "val").otherwise("test")
    return met.withColumn("split", split).drop("_h", "_p", "_k", "_q", "_before", "_train", "_val")


def align_duplicates(df: DataFrame, id: str, hash: str, split: str) -> DataFrame:
    """df with the split of the smallest id of its hash."""
    first = df.groupBy(hash).agg(F.min_by(split, id).alias("_split"))
    return df.join(first, hash).withColumn(split, F.col("_split")).drop("_split")


def random_split(df: DataFrame, id: str, ratio: float, seed: int = 42) -> DataFrame:
    """df with split train or val: half-even share of val, one row at least on each side.

    The cut is found from counts of hash prefixes, so no task sorts the whole table.
    """
    h = df.withColumn("_h", _seeded(seed, id)).withColumn("_p", F.substring("_h", 1, 4))
    counts = h.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(F.lit(0))
    upto = F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("_c").over(w)
    placed = counts.select("_p", (upto - F.col("_c")).alias("_before"), F.greatest(F.lit(1), F.least(n - 1, F.bround(n * ratio))).cast("long").alias("_cut"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", id))
    return h.join(placed, "_p").withColumn("split", F.when(at <= F.col("_cut"), "val").otherwise("train")).drop("_h", "_p", "_before", "_cut")


def top_k_per_class(df: DataFrame, cls: str, order: list, k: int) -> DataFrame:
    """The first k rows of each class with place, and short: how many rows the class lacks."""
    w = Window.partitionBy(cls)
    ranked = df.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= k)
    return ranked.withColumn("short", F.lit(k) - F.count(F.lit(1)).over(w))


#: Overlapping pairs from which an image's greedy choices are settled in rounds of joins instead of one fold.
CROWDED = 20_000


def crowded(pairs: DataFrame, image: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """pairs of the images with `most` of them at most, and those of the others, None where there are none."""
    full = pairs.groupBy(image).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(image)
    if not full.limit(1).count():
        return pairs, None
    full = written(full, "crowded")
    return pairs.join(full, image, "left_anti"), pairs.join(full, image, "left_semi")


def nms(
    df: DataFrame, image: str, box: str, conf: str, order: list[str], threshold: float = 0.5, least: float | None = None, cell: float = CELL, most: int = CROWDED, few: int = FEW
) -> DataFrame:
    """Greedy non-maximum suppression per image, across classes: rows kept, by falling confidence then order.

    least: scores must be above it (one exactly at it is dropped). An image with `few` boxes at most is settled in a list. The
    boxes of the others meet in grid cells of a side of `cell`; an image with more than `most` overlapping pairs is settled in
    rounds of joins, any other in one fold. The result is the same.
    """
    rows = df if least is None else df.where(F.col(conf) > least)
    place = lambda x: x.withColumn("_at", F.row_number().over(Window.partitionBy(image).orderBy(F.desc(conf), *order)))
    many = busy(image, few, rows)
    if many is None:
        return kept_of_lists(place(rows), image, box, "_at", threshold).select(*df.columns)
    small, large = apart(rows, image, many)
    settled = kept_of_lists(place(small), image, box, "_at", threshold).select(*df.columns)
    return settled.unionByName(_nms_in_cells(place(large), image, box, threshold, cell, most).select(*df.columns))


def _nms_in_cells(placed: DataFrame, image: str, box: str, threshold: float, cell: float, most: int) -> DataFrame:
    side = lambda x, at: placed.select(image, F.col("_at").alias(at), F.col(box).alias(f"{x}_box"))
    over = overlapping(side("left", "_i"), side("right", "_j"), image, "box", F.col("_i") < F.col("_j"), cell).where(F.col("iou") > threshold).select(image, "_i", "_j")
    over, full = crowded(written(over, "overlaps"), image, most)
    lists = over.groupBy(image, "_j").agg(F.collect_list("_i").alias("before")).groupBy(image).agg(F.array_sort(F.collect_list(F.struct("_j", "before"))).alias("lists"))
    stays = lambda gone, x: F.exists(x["before"], lambda i: ~F.array_contains(gone, i))
    gone = lists.select(image, F.explode(F.aggregate("lists", F.array().cast("array<int>"), lambda gone, x: F.when(stays(gone, x), F.array_append(gone, x["_j"])).otherwise(gone))).alias("_at"))
    if full is not None:
        gone = gone.unionByName(suppressed(full, image).withColumnRenamed("_j", "_at"))
    return placed.join(gone, [image, "_at"], "left_anti")


def number_regions(df: DataFrame, image: str, order: list) -> DataFrame:
    return df.withColumn("region", F.row_number().over(Window.partitionBy(image).orderBy(*order)))


def drop_repeated_boxes(df: DataFrame, image: str, cls: str, box: list[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct boxes, per image how many repeats went)."""
    keys = [image, cls, *box]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.select(*keys), counted.groupBy(image).agg(F.sum(F.col("_n") - 1).alias("removed"))


def class_ids(df: DataFrame, cls: str, order: list[str]) -> DataFrame:
    """Class and class_id, numbered by first appearance in the order; classes are few, rows are not sorted."""
    first = df.groupBy(cls).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("class_id", F.row_number().over(Window.orderBy("_first", cls)) - 1).drop("_first")


#: Rows of the sample behind each range, and the most ranges of an order: together they bound what the driver reads.
SAMPLE_PER_RANGE, MOST_RANGES = 48, 1024


class Ranges:
    """Split points of an order, found once and sent as constants.

    Every plan that deals rows by comparison with them agrees on a row's range, whatever its other columns, partitions or
    retries. The points are quantiles of a uniform sample of about SAMPLE_PER_RANGE rows a range, so ranges hold about the
    same number of rows; equal rows are in one range. Nulls come first, as in an ascending sort.
    """

    def __init__(self, df: DataFrame, order: list[str], ranges: int | None = None, seed: int = 42):
        ranges = min(MOST_RANGES, ranges or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.row = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
        keyed, most = df.select(self.row.alias("p")).where("p is not null"), ranges * SAMPLE_PER_RANGE
        rows = keyed.count()
        sample = (keyed if rows <= most else keyed.where(F.rand(seed) < most / rows)).agg(F.array_sort(F.collect_list("p")).alias("s"))
        cuts = F.sequence(F.lit(1), F.lit(max(ranges - 1, 1)))
        found = sample.select(F.array_distinct(F.filter(F.transform(cuts, lambda i: F.get("s", (F.size("s") * i / ranges).cast("int"))), lambda x: x.isNotNull())).alias("p"))
        self.kind = found.schema["p"].dataType
        self.count, self.points = found.select(F.size("p"), F.to_json("p")).first()

    def of(self) -> Column:
        """The range of a row: how many split points are at or before it. A binary search over constants, in as many steps
        as the logarithm of their number. (Text carries them into the plan at once; what matters is that all plans get the
        same.)"""
        points = F.from_json(F.lit(self.points), self.kind)
        steps = F.from_json(F.lit(str([1 << k for k in reversed(range(self.count.bit_length()))])), "array<int>")
        # beyond the last point get gives null, and nothing is at or before it
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) <= self.row, at + step).otherwise(at))


def _null_safe(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, [x.eqNullSafe(y) for x, y in zip(a, b)], F.lit(True))


def range_offsets(dealt: DataFrame, n: Column, by: list[str]) -> DataFrame:
    """For rows dealt into ranges (_p): a row per group and range with _g0, _g1 ..., _q (the range), _b (the sum of n in
    the ranges before), _c (its own) and _t (of the whole group). Summed before the shuffle; a group has few ranges."""
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    sums = dealt.groupBy(*keys, F.col("_p").alias("_q")).agg(F.sum(n).alias("_c"))
    w = Window.partitionBy(*[f"_g{i}" for i in range(len(by))])
    upto = F.sum("_c").over(w.orderBy("_q").rowsBetween(Window.unboundedPreceding, 0))
    return sums.select("*", (upto - F.col("_c")).alias("_b"), F.sum("_c").over(w).alias("_t"))


def numbered(df: DataFrame, order: list[str], at: str = "at") -> DataFrame:
    """df with its 0-based place in a total order. Rows are dealt by constant split points, sorted within their range and
    offset by the counts of the ranges before; no task holds the order."""
    dealt = df.withColumn("_p", Ranges(df, order).of())
    local = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    before = range_offsets(dealt, F.lit(1), []).select("_q", "_b")
    return local.join(before, F.col("_p") == F.col("_q")).withColumn(at, F.col("_b") + F.col("_n") - 1).drop("_p", "_q", "_n", "_b")


def counted_before(counts: DataFrame, order: list[str], n: str, before: str = "before", group: list[str] | None = None) -> DataFrame:
    """counts (distinct rows of group and order, with a count n) with the sum of n over the rows before, in their group.

    Rows are dealt by constant split points of the order, summed within their group and range and offset by the sums of
    the ranges before, so no task holds a group's order.
    """
    by = group or []
    dealt = counts.withColumn("_p", Ranges(counts, order).of())
    local = dealt.withColumn("_l", F.sum(n).over(Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n))
    ahead = range_offsets(dealt, F.col(n), by).drop("_c", "_t")
    same = _null_safe([F.col(c) for c in by], [F.col(f"_g{i}") for i in range(len(by))]) & (F.col("_p") == F.col("_q"))
    return local.join(ahead, same).withColumn(before, F.col("_b") + F.col("_l")).drop("_p", "_q", "_l", "_b", *[f"_g{i}" for i in range(len(by))])


def decimate(df: DataFrame, order: list[str], max_rows: int) -> DataFrame:
    """Every step-th row of the order, with the smallest step that leaves max_rows at most; a sampling operator."""
    step = F.greatest(F.ceil(F.col("_total") / max_rows), F.lit(1))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return numbered(df, order, "_at").join(F.broadcast(total), F.lit(True)).where(F.pmod("_at", step) == 0).drop("_at", "_total")


def cyclic_batches(df: DataFrame, order: list[str], size: int, count: int) -> DataFrame:
    """count batches of size rows, taken around the order again and again: batch, slot and the row."""
    rows = numbered(df, order, "_at")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    slots = df.sparkSession.range(count * size).join(F.broadcast(total), F.lit(True)).where("_total > 0")
    slots = slots.select((F.col("id") / size).cast("long").alias("batch"), F.pmod("id", F.lit(size)).alias("slot"), F.pmod("id", "_total").alias("_at"))
    return slots.join(rows, "_at").drop("_at")


def latest(df: DataFrame, ts: str, id: str, n: int | None = None) -> DataFrame:
    """Newest first, ties by id; the first n, if given."""
    out = df.orderBy(F.desc(ts), id)
    return out if n is None else out.limit(n)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def cap_issues(issues: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """The first n issues in emission order: a report's sample."""
    return issues.orderBy(*order).limit(n)


def best_row(df: DataFrame, metric: str, order: list[str]) -> DataFrame:
    """The one row with the smallest metric, ties to the first in order; rows without a metric do not count."""
    row = F.min_by(F.struct(*df.columns), F.struct(metric, *order))
    return df.where(F.col(metric).isNotNull()).agg(row.alias("_r")).where("_r is not null").select("_r.*")


def matched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with side left or right."""
    left, right = a.select(key), b.select(key)
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def unknown_values(df: DataFrame, col: str, expected: list[str]) -> DataFrame:
    """Distinct values that are not expected; null is not a value."""
    return df.where(~F.col(col).isin(expected)).select(col).distinct()


def missing_values(df: DataFrame, col: str, expected: list[str]) -> DataFrame:
    """Expected values, such as splits, that are not there."""
    return df.sparkSession.createDataFrame([(x,) for x in expected], f"{col} string").subtract(df.select(col))


def union_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def distinct_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs without order or repeats."""
    return df.select(F.least(left, right).alias(left), F.greatest(left, right).alias(right)).distinct()


def union_issues(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
