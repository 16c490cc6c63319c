"""Connected components over pairs of ids, in rounds of joins that Spark shuffles and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (the smallest id reachable) of every id in pairs; ids are longs without nulls.

    Alternates the large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, to its
    smallest neighbour, until all pairs point at a smallest id. Rounds grow with the log of the number of nodes.
    """
    ordered = pairs.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v > m").distinct()
    now = keep(ordered, "components")
    while True:
        both = now.select(F.col("v").alias("x"), F.col("m").alias("y")).union(now.select("m", "v"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("t"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("t").alias("m")).distinct()
        smallest = large.groupBy("v").agg(F.min("m").alias("t"))
        handed = large.join(smallest, "v").where("m > t").select(F.col("m").alias("v"), F.col("t").alias("m"))
        now = keep(handed.union(smallest).distinct(), "components")
        many = now.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not many and not now.join(now.select(F.col("v").alias("m")), "m", "left_semi").limit(1).count():
            tops = now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
            return now.select(F.col("v").alias("node"), F.col("m").alias("component")).union(tops)
