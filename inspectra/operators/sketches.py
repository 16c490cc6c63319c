"""Quantile sketches that are kept by day, model or machine and merged later, beside the exact quantiles.

A sketch (KLL) holds a few hundred values of any number; merging gives the sketch of all. A quantile's rank is off by at
most `rank_error(k)` of the number of values, in 99 of 100 sketches. No shuffle holds values, only sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 400


def rank_error(k: int = SIZE) -> float:
    """Error of a rank as a share of the values, at 99 % confidence, by the published fit for this sketch."""
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, value: str, by: list, k: int = SIZE) -> DataFrame:
    """A row per group with sketch (binary) and n, how many values it stands for; null and NaN values do not count."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, by: list, k: int = SIZE) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """sketches with a column per share instead of the sketch."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in shares.items()]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *found)


def sketch_rank(sketch: Column, value: Column) -> Column:
    """The share of a sketch's values that are at most value."""
    return F.kll_sketch_get_rank_double(sketch, value)
