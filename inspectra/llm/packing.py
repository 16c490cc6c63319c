"""Variable-capacity best-fit packing of documents into training sequences.

Texts longer than the largest permitted length are cut into pieces. Pieces are dealt by hash into shards of about
`shard_pieces`; each shard is packed alone, so shards can be packed anywhere and again after a lost executor. In a shard,
pieces go in falling size, each to the open bin with the least room that still holds it; if none does, a bin of the
permitted length with the least cost per word it can still receive is opened. Every permitted length is tried as the
largest to open, the cheapest outcome is kept, and at the end each bin shrinks to the smallest length that holds it.

Defined cases: a null, empty or blank text gives one row with n_words 0 and null bin columns; null and repeated ids are
packed row by row; an empty table gives an empty table; other columns of the input are not returned.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, n_words, seeded

LENGTHS, SHARD_PIECES = (512, 1024, 2048, 4096, 8192), 20_000
#: Words of cost that every sequence has besides its length, and the length at which attention doubles the cost.
FIXED_COST, ATTENTION = 16.0, 65_536.0
RESULT = "doc_id long, piece long, n_words long, bin_id long, bin_length long, bin_offset long, bin_words long"


def cost(length: float) -> float:
    """Cost of a training sequence: fixed, linear in its length, and quadratic for attention."""
    return FIXED_COST + length + length * length / ATTENTION


def pack(sizes: Sequence[int], lengths: Sequence[int]) -> tuple[float, list[list[int]], list[int]]:
    """Best fit with several lengths: (cost, indices of each bin in order, length of each bin)."""
    best: tuple[float, list[list[int]], list[int]] | None = None
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for top in lengths:
        if order and sizes[order[0]] > top:
            continue
        allowed = [x for x in lengths if x <= top]
        room: list[tuple[int, int]] = []  # (room, bin), ascending
        bins: list[list[int]] = []
        rest = sum(sizes)
        for i in order:
            size = sizes[i]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left = min((x for x in allowed if x >= size), key=lambda x: (cost(x) / min(x, rest), x))
                b = len(bins)
                bins.append([])
            bins[b].append(i)
            if left > size:
                insort(room, (left - size, b))
            rest -= size
        final = [min(x for x in lengths if x >= sum(sizes[i] for i in b)) for b in bins]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, bins, final)
    return best or (0.0, [], [])


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row per piece: doc_id, piece, n_words, bin_id, bin_length, bin_offset, bin_words (of the whole bin)."""
    lengths, longest = tuple(sorted(lengths)), max(lengths)
    sizes = keep(docs.select(F.col(doc_id).cast("long").alias("doc_id"), n_words(F.col(text)).alias("size")), "pack-sizes")
    n = F.greatest(F.ceil(F.col("size") / longest), F.lit(1)).cast("int")
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn(
        "n_words", F.least(F.col("size") - F.col("piece") * longest, F.lit(longest)).cast("long")
    )
    count = pieces.where("n_words > 0").agg(F.count(F.lit(1))).first()[0]
    shards = max(1, -(-count // shard_pieces))
    spread = F.coalesce(seeded("pack", F.col("doc_id"), F.col("piece")), F.monotonically_increasing_id())
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(spread)
    dealt = pieces.where("n_words > 0").select(F.pmod(spread, F.lit(shards)).alias("shard"), "doc_id", "piece", "n_words")

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = rows["n_words"].tolist()
        _, bins, final = pack(sizes, lengths)
        out = np.zeros((4, len(rows)), "int64")
        for b, members in enumerate(bins):
            held = np.array([sizes[i] for i in members])
            out[:, members] = np.vstack([np.full(len(held), (int(rows["shard"][0]) << 32) + b), np.full(len(held), final[b]), held.cumsum() - held, np.full(len(held), held.sum())])
        ids = rows["doc_id"] if rows["doc_id"].notna().all() else rows["doc_id"].astype("Int64")
        return pd.DataFrame({"doc_id": ids, "piece": rows["piece"], "n_words": rows["n_words"], **dict(zip(("bin_id", "bin_length", "bin_offset", "bin_words"), out))})

    packed = dealt.groupBy("shard").applyInPandas(pack_shard, RESULT)
    nothing = F.lit(None).cast("long")
    blank = pieces.where("n_words = 0").select("doc_id", "piece", "n_words", *[nothing.alias(c) for c in ("bin_id", "bin_length", "bin_offset", "bin_words")])
    return packed.unionByName(blank)
