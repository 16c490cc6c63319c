"""Mixing sources to target weights by Sainte-Lague apportionment, DataFrame functions only.

1. Words are counted once; sizes are summed by source.
2. Targets: the weights share the wanted total, no target exceeds `repeats` times its source's size, and what is above
   is reshared by weight (the water level of the uncapped sources is found from sums in order of size / weight).
3. Blocks of equal words are given to the sources by highest quotients target / (2k + 1), then in the same way to the
   shards of each source: integer quotas. Shards hold about `shard_words` words, so no task holds a whole source.
4. Within a shard the documents lie in a seeded order, cut into blocks. A quota of q over n blocks takes every block
   q div n times and the first q mod n blocks once more.

Defined cases: null text has no words and is taken 0 times; null sources form one source, last in order; repeated rows
count as rows; an empty table gives an empty table. The tables of sources and of shards (one row for a million words)
pass through one window each; documents never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BREAKS, keep, n_words, seeded

WEIGHTS, SHARE, REPEATS, BLOCK, SHARD_WORDS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 32, 1 << 20, "mix"


def highest_quotients(items: DataFrame, key: list[str], weight: str, seats: str, group: list[str] | None = None) -> DataFrame:
    """items with `won`: the seats of each item when its group's seats go to the highest weight / (2k + 1).

    seats: a column that is equal within a group; ties go to the smaller key. Each item's seats lie within
    q (1 +- n / 2S) +- 1/2 of its quota q (n items, S seats), so only the quotients between compete: 4n rows at most.
    """
    every = Window.partitionBy(*(group or [F.lit(0)]))
    s, w = F.col(seats), F.col(weight)
    quota = F.when(F.col("_w") > 0, s * w / F.col("_w")).otherwise(0.0)
    spread = F.when(s > 0, quota * F.col("_items") / (2 * s)).otherwise(0.0)
    ready = (
        items.withColumn("_w", F.sum(w).over(every)).withColumn("_items", F.count(F.lit(1)).over(every))
        .withColumn("_lo", F.greatest(F.floor(quota - spread - 0.5), F.lit(0)).cast("long"))
        .withColumn("_up", F.ceil(quota + spread + 0.5).cast("long"))
        .withColumn("_left", F.when(F.col("_w") > 0, s).otherwise(0) - F.sum("_lo").over(every))
    )
    tried = ready.withColumn("_k", F.explode(F.sequence("_lo", "_up"))).withColumn("_quotient", w / (2 * F.col("_k") + 1))
    rank = F.row_number().over(every.orderBy(F.desc("_quotient"), *key, "_k"))
    won = (F.col("_rank") <= F.col("_left")) & (F.col("_quotient") > 0)
    return tried.withColumn("_rank", rank).groupBy(*items.columns).agg((F.min("_lo") + F.count_if(won)).alias("won"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """sources (_none, _source, source_size) with rank and target."""
    order = Window.partitionBy(F.lit(0)).orderBy("_none", "_source")
    every = Window.partitionBy(F.lit(0))
    by_fill = every.orderBy("_fill", "_rank")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * repeats
    out = (
        sources.withColumn("_rank", F.row_number().over(order))
        .withColumn("_weight", weight)
        .withColumn("_fill", full / F.col("_weight"))
        .withColumn("_before", F.sum(full).over(by_fill.rowsBetween(Window.unboundedPreceding, 0)) - full)
        .withColumn("_open", F.sum("_weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (share * F.sum("source_size").over(every) - F.col("_before")) / F.col("_open"))
        .withColumn("_water", F.min(F.when(F.col("_fill") > F.col("_level"), F.struct("_fill", "_rank", "_level"))).over(every)["_level"])
    )
    level = F.when((F.col("_fill") <= F.col("_level")) | F.col("_water").isNull(), full).otherwise(F.col("_water") * F.col("_weight"))
    return out.select("_none", "_source", "source_size", F.least(level, full).alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE, repeats: float = REPEATS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the columns of `carry` as `_in` (struct).

    taken: words that the mix takes of the document; repeated words count as often as they are taken.
    """
    sized = keep(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("_none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
            n_words(F.col(text)).alias("size"), seeded(seed, F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))).alias("_order"), F.xxhash64(F.col(text)).alias("_tie"), *([F.struct(*carry).alias("_in")] if carry else []),
        ),
        "mix-sizes",
    )
    by = ["_none", "_source"]
    wanted = targets(sized.groupBy(*by).agg(F.sum("size").alias("source_size")), weights, share, repeats)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    sources = highest_quotients(wanted.withColumn("_seats", seats), by, "target", "_seats").select(*by, "source_size", "target", F.col("won").alias("_quota"))
    sources = keep(sources.withColumn("_shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")), "mix-sources")

    dealt = sized.join(sources, by).withColumn("_shard", F.pmod(F.floor(F.col("_order") / 64), F.col("_shards")))
    shards = dealt.groupBy(*by, "_shard", "_quota").agg(F.sum("size").alias("_held"))
    won = highest_quotients(shards, ["_shard"], "_held", "_quota", by).select(*by, "_shard", "_held", F.col("won").alias("_won"))
    line = Window.partitionBy(*by, "_shard").orderBy("_order", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("_from", F.sum("size").over(line) - F.col("size")).join(won, [*by, "_shard"])
    n = F.greatest(F.ceil(F.col("_held") / block), F.lit(1)).cast("long")
    times, more = F.floor(F.col("_won") / n), F.pmod(F.col("_won"), n)
    extra = F.greatest(F.least(F.least(more * block, F.col("_held")) - F.col("_from"), F.col("size")), F.lit(0))
    taken = F.least(times * F.col("size") + extra, F.floor(F.col("size") * repeats)).cast("long")
    return laid.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["_in"] if carry else []))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars", **params) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole copy taken, and one for the words of a part.

    A part holds the text from its beginning to the last word taken, white space and all; its n_chars is counted anew.
    """
    taken = mix(docs, doc_id, text, source, carry=tuple(docs.columns), **params)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.col("taken") - whole * F.col("size")
    rows = taken.withColumn("_part", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))))
    own = F.col("_in")[text]
    pieces = F.split(own, BREAKS, (F.col("_part") + 1 + own.rlike(f"^{BREAKS}").cast("int")).cast("int"))  # the last one is what is not taken
    cut = F.regexp_replace(F.substring(own, F.lit(1), F.length(own) - F.length(F.element_at(pieces, -1))), f"{BREAKS}$", "")
    now: dict[str, Column] = {c: F.col("_in")[c] for c in docs.columns}
    now[text] = F.when(F.col("_part") > 0, cut).otherwise(now[text])
    if n_chars in docs.columns:
        now[n_chars] = F.when(F.col("_part") > 0, F.length(cut).cast(docs.schema[n_chars].dataType)).otherwise(now[n_chars])
    return rows.select(*[c.alias(k) for k, c in now.items()])
