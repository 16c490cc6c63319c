"""Exact Jaccard join of documents on word shingles, with a token-group matrix.

1. Texts are turned to sets of shingle hashes in Arrow batches. Equal sets become one, with the smallest doc_id. A sketch
   of fixed size counts how often shingles occur, over all documents; any order of tokens is exact, rarest first is fast.
2. Two sets with enough overlap share a token within the first |x| - ceil(t|x|) + 1 tokens of each in one common order
   (prefix filter). Only tokens that two sets share are kept, with the set's size and the token's place in it.
3. Linking rounds: within a token, each set meets its few predecessors in a seeded order; pairs that can still reach the
   threshold are compared exactly and linked. Sets that are connected so far form a group.
4. Token-group matrix: per token and group, the bounds of its members. Pairs of different groups that some token lets
   through are opened: the larger group is cut into blocks, each block's token union bounds the overlap of every set of
   the smaller group, and only qualifying blocks are compared set by set. Pairs within a group need no further look.

No pair at the threshold is lost: step 4 sees every pair of groups that a shared prefix token can link.

Defined cases: a text with fewer words than the width is one shingle; null, empty or blank texts have n_shingles 0 and
are their own component; rows with a null id are counted and have a null component; rows with an equal id are one node,
linked by all their texts; an empty table gives an empty table; other columns of the input are not returned.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, keep, small_batches
from .graph import components
from .shingles import mixed, shingle_sets

WIDTH, PERCENT = 5, 75
#: Cells of the sketch (its size bounds what is broadcast, one byte each), cells of a slice.
CELLS, SLICE = 1 << 22, 1 << 16
#: Linking rounds, predecessors that a set meets in each, and sets in a block of an opened group.
ROUNDS, NEIGHBOURS, BLOCK = 2, 8, 256
#: Tokens of sets that a comparing task remembers.
REMEMBERED = 1 << 20


def set_id(tokens: np.ndarray) -> int:
    """One signed 64-bit id of a set of token hashes."""
    n = np.array([len(tokens)], np.uint64)
    twice = mixed(mixed(np.bitwise_xor.reduce(tokens, keepdims=True) + n) ^ tokens.sum(dtype=np.uint64, keepdims=True))
    return int(twice.view(np.int64)[0])


def measured(docs: DataFrame, width: int, cells: int) -> DataFrame:
    """doc_id, n and uid of every document, and rows with a slice of the task's sketch (slice, counts)."""

    def measure(batches):
        counts = np.zeros(cells, np.uint32)
        for part in batches:
            n, uid = [], []
            for tokens in shingle_sets(part.column("text"), width):
                n.append(len(tokens))
                uid.append(set_id(tokens) if len(tokens) else None)
                counts[(tokens & np.uint64(cells - 1)).astype(np.int64)] += 1  # two tokens of one text in a cell count once
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(uid, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "n", "uid", "slice", "counts"])
            give_back()
        few = np.minimum(counts, 255).astype(np.uint8).reshape(-1, min(SLICE, cells))
        for i, x in enumerate(few):
            if x.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["doc_id", "n", "uid", "slice", "counts"])
        del counts, few
        give_back()

    return docs.mapInArrow(measure, "doc_id long, n long, uid long, slice int, counts binary")


def sketch(slices: DataFrame, cells: int) -> np.ndarray:
    """How common the tokens of each cell are, on a scale of one byte; the only thing that passes through the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for i, x in zip(part["slice"], part["counts"]):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(x), np.uint8).astype(np.uint64)
        for i, x in sums.items():
            yield pd.DataFrame({"slice": [i], "counts": [np.minimum(8 * np.log2(1.0 + x), 255).astype(np.uint8).tobytes()]})

    out = np.zeros(cells, np.uint8)
    per = min(SLICE, cells)
    for i, x in slices.select("slice", "counts").repartition("slice").mapInPandas(add, "slice int, counts binary").collect():
        out[i * per : (i + 1) * per] = np.frombuffer(x, np.uint8)
    return out


def prefixes(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """token, uid, n and pos of the prefix tokens of each set; a set once per task."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def emit(batches):
        rank, seen = sent.value, set()
        names, held, size = ["token", "uid", "n", "pos"], [], 0

        def batch():
            columns = [np.concatenate(x) for x in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for part in batches:
            for tokens in shingle_sets(part.column("text"), width):
                n = len(tokens)
                if not n or (uid := set_id(tokens)) in seen:
                    continue
                seen.add(uid)
                take = n - (percent * n + 99) // 100 + 1
                first = tokens[np.argsort(rank[tokens & np.uint64(len(rank) - 1)], kind="stable")[:take]]
                held.append((first.view(np.int64), np.full(take, uid), np.full(take, n, np.int32), np.arange(take, dtype=np.int32)))
                size += take
                if size > 200_000:
                    yield batch()
                    held, size = [], 0
                    give_back()
        if held:
            yield batch()
        del seen, held
        give_back()

    return docs.select("text").mapInArrow(emit, "token long, uid long, n int, pos int")


def least_shared(a: Column, b: Column, percent: int) -> Column:
    """Tokens that sets of sizes a and b must share at least."""
    return F.ceil(percent * (a + b) / (100 + percent))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sets that first share a token at their places can reach the threshold."""
    na, nb, pa_, pb = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    indexed = lambda n: n - F.ceil(2 * percent * n / (100 + percent)) + 1
    small = F.when(na <= nb, pa_ < indexed(na)).otherwise(F.lit(False)) | F.when(nb <= na, pb < indexed(nb)).otherwise(F.lit(False))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & small & (1 + F.least(na - pa_ - 1, nb - pb - 1) >= least_shared(na, nb, percent))


class Sets:
    """Sets of packed texts; the last ones are remembered, REMEMBERED tokens at most."""

    def __init__(self, width: int):
        self.width, self.known, self.size = width, OrderedDict(), 0

    def of(self, uid: int, body: bytes) -> np.ndarray | None:
        """The set of a text, None if it is not the set of that id (another text with the same doc_id)."""
        if uid not in self.known:
            tokens = next(shingle_sets(pa.array([zlib.decompress(body).decode()]), self.width))
            if not len(tokens) or set_id(tokens) != uid:
                return None
            self.known[uid] = tokens
            self.size += len(tokens)
            while self.size > REMEMBERED and len(self.known) > 1:
                self.size -= len(self.known.popitem(last=False)[1])
        return self.known[uid]


def bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """uid and packed text of the wanted (doc_id, uid); an equal row is sent once per task."""

    def pack(batches):
        seen = set()
        for part in batches:
            ids, packed = [], []
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                if i is not None and text and (key := (i, hash(text))) not in seen:
                    seen.add(key)
                    ids.append(i)
                    packed.append(zlib.compress(text.encode(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "body"])
            give_back()

    return docs.mapInArrow(pack, "doc_id long, body binary").join(wanted, "doc_id").select("uid", "body")


def compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def check(batches):
        sets = Sets(width)
        for part in batches:
            rows = part.to_pydict()
            good = []
            for a, b, x, y in zip(rows["a"], rows["b"], rows["x"], rows["y"]):
                s, t = sets.of(a, x), sets.of(b, y)
                if s is not None and t is not None:
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        good.append((a, b))
            del rows
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["a", "b"])
        del sets
        give_back()

    met = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return met.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def promising(pairs: DataFrame, held: DataFrame, a: str, b: str, percent: int) -> DataFrame:
    """The pairs of sets (columns a and b) that can still link by the tokens that their prefixes share.

    The tokens behind the prefix of the set whose prefix ends first are all that the two can share beyond these, so
    shared + ceil(t n) - 1 bounds their overlap, with the larger n.
    """
    met = pairs.join(held.toDF(a, "_na", "_ta"), a).join(held.toDF(b, "_nb", "_tb"), b)
    most = F.size(F.array_intersect("_ta", "_tb")) + F.ceil(percent * F.greatest("_na", "_nb") / 100) - 1
    return met.where(most >= least_shared(F.col("_na"), F.col("_nb"), percent)).select(*pairs.columns)


def grouped(shared: DataFrame, links: DataFrame | None) -> DataFrame:
    """shared with gid, the smallest uid that a set is linked to so far."""
    if links is None:
        return shared.withColumn("gid", F.col("uid"))
    gids = keep(components(links, "a", "b"), "jaccard-gids").toDF("uid", "g")
    return shared.join(gids, "uid", "left").withColumn("gid", F.coalesce("g", "uid")).drop("g")


def linking_round(shared: DataFrame, texts: DataFrame, held: DataFrame, number: int, width: int, percent: int, neighbours: int) -> DataFrame:
    """Links found between sets of different groups that stand near each other within a token, in a seeded order."""
    line = Window.partitionBy("token").orderBy(F.xxhash64("uid", F.lit(number)), "uid").rowsBetween(-neighbours, -1)
    me = F.struct("uid", "gid", "n", "pos")
    near = shared.select(me.alias("p"), F.collect_list(me).over(line).alias("near"))
    met = near.select("p", F.explode("near").alias("q")).where((F.col("p.gid") != F.col("q.gid")) & may_link("p", "q", percent))
    pairs = met.select(F.least("p.uid", "q.uid").alias("a"), F.greatest("p.uid", "q.uid").alias("b")).distinct()
    return keep(compared(promising(pairs, held, "a", "b", percent), texts, width, percent), "jaccard-links")


def open_groups(shared: DataFrame, texts: DataFrame, held: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links between sets of different groups: one for each set of the smaller group and block of the larger."""
    rest, n = F.col("n") - F.col("pos") - 1, F.col("n")
    indexed = F.col("pos") < n - F.ceil(2 * percent * n / (100 + percent)) + 1
    matrix = shared.groupBy("token", "gid").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(rest).alias("rest"), F.max(indexed).alias("indexed"))
    p, q = matrix.alias("p"), matrix.alias("q")
    sizes = (100 * F.col("p.high") >= percent * F.col("q.low")) & (100 * F.col("q.high") >= percent * F.col("p.low"))
    reach = 1 + F.least("p.rest", "q.rest") >= least_shared(F.col("p.low"), F.col("q.low"), percent)
    met = p.join(q, (F.col("p.token") == F.col("q.token")) & (F.col("p.gid") < F.col("q.gid")) & sizes & reach & (F.col("p.indexed") | F.col("q.indexed")))
    pairs = met.select(F.col("p.gid").alias("g"), F.col("q.gid").alias("h")).distinct()

    members = keep(shared.select("uid", "gid").distinct(), "jaccard-members")
    count = members.groupBy("gid").agg(F.count(F.lit(1)).alias("size"))
    sized = keep(pairs.join(count.toDF("g", "gs"), "g").join(count.toDF("h", "hs"), "h"), "jaccard-pairs")
    alone = (F.col("gs") == 1) & (F.col("hs") == 1)  # then a group's id is its set's
    sized = keep(promising(sized.where(alone), held, "g", "h", percent).unionByName(sized.where(~alone)), "jaccard-pairs")
    larger = F.col("gs") >= F.col("hs")
    asks = sized.select(F.when(larger, F.col("g")).otherwise(F.col("h")).alias("target"), F.when(larger, F.col("h")).otherwise(F.col("g")).alias("gid"), F.greatest("gs", "hs").alias("size"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    queries = asks.join(members, "gid").select("target", "uid", blocks.alias("blocks")).distinct()
    queries = queries.join(texts, "uid").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("target", "block", "uid", "body")])
    opened = asks.select(F.col("target").alias("gid"), blocks.alias("blocks")).distinct().join(members, "gid").join(texts, "uid")
    opened = opened.select(F.col("gid").alias("target"), F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("block"), "uid", "body")

    def compare(group: pa.Table, asked: pa.Table) -> pa.Table:
        sets = Sets(width)
        held = [(u, s) for u, b in zip(group["uid"].to_pylist(), group["body"].to_pylist()) if (s := sets.of(u, b)) is not None]
        links: list[tuple[int, int]] = []
        if held:
            tokens = np.concatenate([s for _, s in held])
            order = np.argsort(tokens, kind="stable")
            owner, tokens = np.repeat(np.arange(len(held)), [len(s) for _, s in held])[order], tokens[order]
            lengths = np.array([len(s) for _, s in held])
            for u, b in zip(asked["q_uid"].to_pylist(), asked["q_body"].to_pylist()):
                s = sets.of(u, b)
                if s is None:
                    continue
                low, high = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
                if 100 * (high > low).sum() < percent * len(s):  # the union of the block bounds the overlap
                    continue
                at = np.concatenate([np.arange(x, y) for x, y in zip(low, high) if y > x])
                both = np.bincount(owner[at], minlength=len(held))
                good = np.flatnonzero(100 * both >= percent * (lengths + len(s) - both))
                if len(good):
                    links.append((held[good[0]][0], u))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    met = opened.groupBy("target", "block").cogroup(queries.groupBy("q_target", "q_block"))
    return keep(met.applyInArrow(compare, "a long, b long"), "jaccard-links")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = WIDTH, percent: int = PERCENT, cells: int = CELLS, rounds: int = ROUNDS, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = keep(measured(docs, width, cells), "jaccard-sets")
    rows = every.where("slice is null").select("doc_id", "n", "uid")
    common = sketch(every.where("slice is not null"), cells)
    entries = prefixes(docs.where("doc_id is not null"), width, percent, common).repartition("token")
    single = entries.groupBy("token", "uid").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    shared = keep(single.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("held > 1").drop("held"), "jaccard-shared")
    named = rows.where("doc_id is not null and uid is not null")
    reps = named.groupBy("uid").agg(F.min("doc_id").alias("doc_id"))
    held = keep(shared.groupBy("uid").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")), "jaccard-prefixes")
    texts = keep(bodies(docs, shared.select("uid").distinct().join(reps, "uid")), "jaccard-texts")
    twice = named.groupBy("doc_id").agg(F.min("uid").alias("a"), F.max("uid").alias("b")).where("a < b")
    links = named.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("uid").alias("b")).where("a <> b")
    found: DataFrame | None = None
    for i in range(rounds):
        more = linking_round(grouped(shared, found), texts, held, i, width, percent, neighbours)
        found = more if found is None else found.union(more)
    last = open_groups(keep(grouped(shared, found), "jaccard-grouped"), texts, held, width, percent, block)
    parts = components(links.union(last) if found is None else links.union(found).union(last), "a", "b").toDF("uid", "part")
    ends = reps.join(parts, "uid", "left").withColumn("part", F.coalesce("part", "uid"))
    smallest = ends.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    placed = ends.join(smallest, "part").select("uid", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(placed, "uid", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
