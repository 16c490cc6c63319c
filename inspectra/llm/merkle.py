"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

A row's leaf is the hash of its fields. The leaves of a source ascend by id; runs of three become the hash of their
digests, level by level, until the source has one node, and the sources' nodes become one root in the same way. Runs are
built 27 at a time, so one shuffle serves three levels.

Proofs: every node holds the siblings on its way to its parent. A self-join appends what the ancestor holds and takes over
its pointer, so distances double: 1, 2, 4, 8. At 8 no more than 3^8 nodes share an ancestor; the nodes that far up, 3^8
times fewer, go on alone until they reach the root, and one join hands their way to the nodes below. No key ever stands
for a source, so a source with most of the rows is dealt like the others.

Places: rows are ranked within source and range of constant split points and offset by the counts of the ranges before.

Defined cases: null fields hash as `-`; ids that are null come first; rows with one id stand in the order of their leaves,
equal rows next to each other, each with a proof of its own; a null source is a source, the first; a source with one row
has its leaf as subroot; an empty table gives an empty table; columns besides the fields are not read, result columns keep
the id's name only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import Ranges, numbered, range_offsets
from .common import KEPT, clear, keep

ARITY, CHUNK, HOPS = 3, 27, 3
#: Most copies of one row that one array holds while they are set apart.
COPIES = 100_000
NODE = ["t", "l", "p"]
NEXT = ["nt", "nl", "np"]
HELD = ["seg", "codes", "sub"]


def digest(fields: list[Column]) -> Column:
    """Lower-case hex sha256 of fields: each `-` if null, else its UTF-8 length, a colon and itself."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def levels(n: int) -> int:
    """Runs above n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves (source, doc_id, leaf, bad) with t, p and n: rank of the source, place in it and its rows; and the sources."""
    alike = leaves.groupBy("source", "doc_id", "leaf").agg(F.count(F.lit(1)).alias("copies"), F.first("bad").alias("bad"))
    alike = keep(alike, "merkle-leaves")
    dealt = alike.withColumn("_p", Ranges(alike, ["doc_id", "leaf"]).of())
    offsets = keep(range_offsets(dealt, F.col("copies"), ["source"]), "merkle-offsets")
    sources = keep(numbered(offsets.groupBy("_g0").agg(F.first("_t").alias("n")), ["_g0"], "t"), "merkle-sources")
    known = offsets.join(sources.select(F.col("_g0").alias("_s"), "t"), F.col("_g0").eqNullSafe(F.col("_s")))
    upto = F.sum("copies").over(Window.partitionBy("source", "_p").orderBy("doc_id", "leaf").rowsBetween(Window.unboundedPreceding, 0))
    local = dealt.withColumn("_l", upto - F.col("copies"))
    met = local.join(known.select("_g0", "_q", "_b", "_t", "t"), F.col("source").eqNullSafe(F.col("_g0")) & (F.col("_p") == F.col("_q")))
    row = met.select("t", (F.col("_b") + F.col("_l")).alias("p"), F.col("_t").alias("n"), "doc_id", F.col("leaf").alias("h"), "bad", "copies")
    each = row.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    each = each.withColumn("b", F.explode(F.sequence("a", F.least(F.col("a") + COPIES, F.col("copies")) - 1)))
    return each.select("t", (F.col("p") + F.col("b")).alias("p"), "n", "h", F.struct("doc_id", F.unhex("h").alias("leaf"), F.unhex("bad").alias("bad")).alias("own")), sources


def above(hs: Column) -> Column:
    """Digests of the runs of three of an array of digests."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hs) - 1) / ARITY).cast("int")), lambda i: F.sha2(F.array_join(F.slice(hs, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def chunks(nodes: DataFrame, label: str) -> DataFrame:
    """nodes (t, p, n, h, own) by 27: c (their places and own columns), h0 to h3 (digests of four levels), n0 to n3 (how
    many nodes the tree has on each)."""
    q = F.floor(F.col("p") / CHUNK).cast("long")
    met = nodes.groupBy("t", "n", q.alias("q")).agg(F.array_sort(F.collect_list(F.struct("p", "h", "own"))).alias("c"))
    out = met.withColumn("h0", F.col("c.h")).withColumn("h1", above(F.col("h0"))).withColumn("h2", above(F.col("h1"))).withColumn("h3", above(F.col("h2")))
    return keep(out.select("*", *[F.ceil(F.col("n") / ARITY**k).cast("long").alias(f"n{k}") for k in range(4)]), label)


def hops(made: DataFrame, base: int, top: int | None) -> DataFrame:
    """Node rows of chunks whose lowest level is base: siblings to the parent, and the parent. Below, the node of a whole
    source is the leaf of the upper tree at level top; in the upper tree (top null) the node of all is the root."""
    whole = F.lit(None).cast("long")

    def level(k: int) -> Column:
        hs = F.col(f"h{k}")

        def row(i: Column) -> Column:
            run, own = F.slice(hs, F.floor(i / ARITY).cast("int") * ARITY + 1, F.lit(ARITY)), F.pmod(i, F.lit(ARITY))
            others = F.filter(run, lambda _, j: j != own)
            p = F.col("q") * (CHUNK // ARITY**k) + i
            last = F.col(f"n{k + 1}") == 1
            to = (F.lit(0), F.lit(top), F.col("t")) if top is not None else (whole, whole, whole)
            inside = (F.col("t"), F.lit(base + k + 1), F.floor(p / ARITY))
            return F.struct(
                F.lit(base + k).alias("l"), p.cast("long").alias("p"), *[F.when(last, a.cast("long")).otherwise(b.cast("long")).alias(c) for a, b, c in zip(to, inside, NEXT)],
                F.unhex(F.array_join(others, "")).alias("seg"), F.concat(own.cast("string"), (F.size(run) - own - 1).cast("string")).alias("codes"),
                F.when(last & F.lit(top is not None), F.unhex(F.get(F.col(f"h{k + 1}"), 0))).alias("sub"), (F.get(F.col("c"), i)["own"] if k == 0 else F.lit(None).cast(OWN)).alias("own"),
            )

        there = F.transform(F.sequence(F.lit(0), F.size(hs) - 1), row)
        return F.when(F.col(f"n{k}") > 1, there).otherwise(F.array().cast(ROWS))

    return made.select("t", F.explode(F.flatten(F.array(*map(level, range(3))))).alias("x")).select("t", "x.*")


OWN = "struct<doc_id: bigint, leaf: binary, bad: binary>"
ROWS = f"array<struct<l: int, p: bigint, nt: bigint, nl: bigint, np: bigint, seg: binary, codes: string, sub: binary, own: {OWN}>>"


def grown(nodes: DataFrame, base: int, top: int | None, largest: int, label: str) -> tuple[list[DataFrame], DataFrame | None]:
    """Node rows of all levels of trees with several nodes, and the last digest of each tree (t, h)."""
    rows, ends = [], []
    while largest > 1:
        made = chunks(nodes, label)
        rows.append(hops(made, base, top))
        end = F.when(F.col("n1") == 1, F.get("h1", 0)).when(F.col("n2") == 1, F.get("h2", 0)).otherwise(F.get("h3", 0))
        ends.append(made.where("n3 = 1").select("t", end.alias("h")))
        nodes = made.where("n3 > 1").select("t", F.col("q").alias("p"), F.col("n3").alias("n"), F.get("h3", 0).alias("h"), F.lit(None).cast(OWN).alias("own"))
        base, largest = base + 3, -(-largest // CHUNK)
    last = None
    for e in ends:
        last = e if last is None else last.unionByName(e)
    return rows, last


def appended(rows: DataFrame, ancestors: DataFrame) -> DataFrame:
    """rows that point at an ancestor, with what it holds appended and its pointer."""
    up = ancestors.select(*[F.col(a).alias(b) for a, b in zip(NODE, NEXT)], *[F.col(c).alias(f"_{c}") for c in NEXT + HELD])
    met = rows.where("nt is not null").join(up, NEXT)
    held = [F.concat("seg", "_seg").alias("seg"), F.concat("codes", "_codes").alias("codes"), F.coalesce("sub", "_sub").alias("sub")]
    return met.select(*NODE, *[F.col(f"_{c}").alias(c) for c in NEXT], *held, "own").unionByName(rows.where("nt is null"))


def to_root(rows: DataFrame, needed: Callable[[int], Column], floor: int, highest: int) -> DataFrame:
    """rows (closed under their pointers, of level floor and more) with all that stands between them and the root."""
    spark = rows.sparkSession
    for i in range(HOPS):
        before = len(KEPT)
        rows = keep(appended(rows, rows).where(needed(i + 1)), "merkle-hops")
        clear(spark, [x for x in KEPT[:before] if i and "/merkle-hops-" in x][-1:])
    far = floor + 2**HOPS
    if far > highest:
        return rows
    own = KEPT[-1]
    upper = to_root(rows.where(F.col("l") >= far), lambda i: F.lit(True), far, highest)
    whole = keep(appended(rows.where("own is not null" if not floor else "true"), upper), "merkle-paths")
    clear(spark, [x for x in KEPT if "/merkle-hops-" in x and KEPT.index(x) >= KEPT.index(own)])
    return whole


def folded(start: Column, seg: Column, codes: Column) -> Column:
    """The root that a leaf and its siblings give: for every level the digests left of it, its own and those right of it."""
    digests = lambda at, n: F.lower(F.hex(F.substr(seg, at * 32 + 1, n * 32)))
    code = lambda i, k: F.substr(codes, 2 * i + k, F.lit(1)).cast("int")

    def step(a: Column, i: Column) -> Column:
        left, right = code(i, 1), code(i, 2)
        h = F.sha2(F.concat(digests(a["at"], left), a["h"], digests(a["at"] + left, right)), 256)
        return F.struct(h.alias("h"), (a["at"] + left + right).alias("at"))

    n = (F.length(codes) / 2).cast("int")
    begun = F.struct(start.alias("h"), F.lit(0).alias("at"))
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), begun, step, lambda a: a["h"])


def proofs(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: Callable[[list[Column]], tuple[Column, list[Column]]] | None = None) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root (hex), siblings (binary digests, level by level, left to right),
    codes (per level how many stand left and right of the own node) and bad, the leaf of the changed document or null.

    changed: from the fields' columns to a condition and the fields as they then are, to try the proofs.
    """
    spark = docs.sparkSession
    cols = [F.col(f) for f in fields]
    leaf = digest(cols)
    bad = F.lit(None).cast("string")
    if changed:
        when, other = changed(cols)
        bad = F.when(when, digest(other))
    leaves = docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).cast("long").alias("doc_id"), leaf.alias("leaf"), bad.alias("bad"))
    nodes, sources = placed(leaves)
    count, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    top = levels(largest)
    rows, ends = grown(nodes.where("n > 1"), 0, top, largest, "merkle-chunks")
    alone = nodes.where("n = 1").select("t", "h", "own")
    subroots = alone if ends is None else alone.unionByName(ends.select("t", "h", F.lit(None).cast(OWN).alias("own")))
    subroots = keep(subroots, "merkle-subroots")
    upper = subroots.select(F.lit(0).cast("long").alias("t"), F.col("t").alias("p"), F.lit(count).cast("long").alias("n"), "h", "own")
    more, last = grown(upper, top, None, count, "merkle-upper")
    if count < 2:
        empty = [F.lit(None).cast("long").alias(c) for c in NEXT]
        more = [upper.select("t", F.lit(top).alias("l"), "p", *empty, F.lit(b"").alias("seg"), F.lit("").alias("codes"), F.lit(None).cast("binary").alias("sub"), "own")]
    every = None
    for r in rows + more:
        r = r.select(*NODE, *NEXT, *HELD, "own")
        every = r if every is None else every.unionByName(r)
    done = to_root(every, lambda i: (F.col("l") % 2**i == 0) | (F.col("l") >= top), 0, top + levels(count))
    root = (subroots if last is None else last).agg(F.max("h").alias("root"))
    found = done.where("own is not null").select("own.doc_id", F.lower(F.hex("own.leaf")).alias("leaf"), F.lower(F.hex(F.coalesce("sub", "own.leaf"))).alias("subroot"), F.col("seg").alias("siblings"), "codes", F.lower(F.hex("own.bad")).alias("bad"))
    return found.join(F.broadcast(root), F.lit(True))  # one row


def manifest(docs: DataFrame) -> DataFrame:
    """Proofs of documents, tried on a tampered copy: where crc32 of the id is even, the text has lost its line ends."""

    def changed(cols: list[Column]) -> tuple[Column, list[Column]]:
        return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, [*cols[:-1], F.translate(cols[-1], "\n", "")]

    found = proofs(docs, changed=changed)
    out = found.withColumn("folded_root", folded(F.coalesce("bad", "leaf"), F.col("siblings"), F.col("codes")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
