"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised; in each of `tables` tables, `projections` random Gaussian projections, shifted and cut into steps
of `width`, give a vector's bucket. Vectors that meet in a bucket are compared exactly, by cosine in double precision.
Buckets larger than `block` vectors are cut into blocks by hash, and every pair of blocks is one task's work, so no
bucket is cut short. A pair that meets in several tables counts in the first of them only. Equal vectors are collapsed to
one before hashing and count by their number.

At the production parameters a pair at the threshold meets in some table with probability above 0.97, one at 0.95 above 0.99 (see `recall`).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
id, link with nothing and are their own component; vectors of different length never link; repeated rows count as other
vectors; an empty table gives an empty table; columns of the input besides id, vector and label are not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .graph import components

THRESHOLD, TABLES, PROJECTIONS, WIDTH, BLOCK, SEED = 0.93, 32, 14, 2.0, 400, 7


def recall(cosine: float, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> float:
    """Probability that two unit vectors at this cosine share a bucket in at least one table."""
    c = width / math.sqrt(max(2 - 2 * cosine, 1e-12))
    one = math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))
    return 1 - (1 - one**projections) ** tables


def bucket_codes(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One 32-bit bucket code per vector and table; codes that meet by chance only add exact checks."""
    draw = np.random.default_rng(seed)
    steps = np.floor((unit @ draw.standard_normal((unit.shape[1], tables * projections)) + draw.uniform(0, width, tables * projections)) / width)
    factors = np.random.default_rng(seed + 1).integers(1, 1 << 62, (1, 1, projections)) | 1
    return ((steps.astype("int64").reshape(len(unit), tables, projections) * factors).sum(axis=2) >> 31).astype("int32")


def unit_rows(vectors) -> np.ndarray:
    """Vectors as rows of length 1, in double precision."""
    rows = np.stack([np.asarray(v, "float64") for v in vectors])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def hashed(vectors: DataFrame, tables: int, projections: int, width: float, seed: int) -> DataFrame:
    """vectors (rep, label, dims, weight, vector) with the codes of their directions."""

    def codes(batches):
        for part in batches:
            for _, rows in part.groupby("dims"):
                yield rows.assign(codes=list(bucket_codes(unit_rows(rows["vector"]), tables, projections, width, seed)))

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.mapInPandas(codes, f"rep long, label string, dims int, weight long, vector {kind}, codes array<int>")


def linked(similar: np.ndarray) -> np.ndarray:
    """Smallest reachable position of each row of a symmetric boolean matrix."""
    root = np.arange(len(similar))
    while True:
        least = np.where(similar, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(unit: np.ndarray, codes: np.ndarray, ids: np.ndarray, weight: np.ndarray, block: np.ndarray, table: int, within: bool, threshold: float):
    """Links within one block or between two: (ids, weight of the vectors first met here, a root that each reaches)."""
    similar = unit @ unit.T >= threshold
    np.fill_diagonal(similar, False)
    if not within:
        similar &= block[:, None] != block[None, :]
    some = np.flatnonzero(similar.any(axis=1))
    if not len(some):
        return None
    some = some[np.argsort(ids[some], kind="stable")]
    ids, similar, codes = ids[some], similar[np.ix_(some, some)], codes[some]
    first = similar.copy()
    for s in range(table):
        first &= codes[:, s][:, None] != codes[:, s][None, :]
    return ids, first @ weight[some], ids[linked(similar)]


def compared(work: DataFrame, threshold: float) -> DataFrame:
    """compare for every (label, dims, table, code, lo, hi), many of them in one task, in sorted order."""
    key = ["label", "dims", "table", "code", "lo", "hi"]

    def each(batches):
        rest: pd.DataFrame | None = None

        def groups(part: pd.DataFrame, cuts: list[int]) -> pd.DataFrame | None:
            dims, table, lo, hi, ids, weight, block = (part[c].to_numpy() for c in ("dims", "table", "lo", "hi", "rep", "weight", "block"))
            found = []
            for d in np.unique(dims[: cuts[-1]]) if len(cuts) > 1 else ():
                at = np.flatnonzero(dims[: cuts[-1]] == d)
                place = np.zeros(len(part), int)
                place[at] = np.arange(len(at))
                unit, codes = unit_rows(part["vector"].iloc[at]), np.stack(part["codes"].iloc[at].to_list())
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if dims[a] == d and b - a > 1:
                        p = place[a]
                        met = compare(unit[p : p + b - a], codes[p : p + b - a], ids[a:b], weight[a:b], block[a:b], int(table[a]), lo[a] == hi[a], threshold)
                        if met is not None:
                            found.append(met)
            return pd.DataFrame(dict(zip(("rep", "links", "root"), map(np.concatenate, zip(*found))))) if found else None

        for part in batches:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            marks = pd.util.hash_pandas_object(part[key], index=False).to_numpy()
            cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist()]
            rest = part.iloc[cuts[-1] :].reset_index(drop=True)
            if (met := groups(part, cuts)) is not None:
                yield met
        if rest is not None and (met := groups(rest, [0, len(rest)])) is not None:
            yield met

    return work.repartition(*key).sortWithinPartitions(*key).mapInPandas(each, "rep long, links long, root long")


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", *, threshold: float = THRESHOLD,
    tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    v = F.col(vector)
    fit = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    all_rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("vector"), F.coalesce(fit, F.lit(False)).alias("fit"))
    keyed = all_rows.withColumn("dims", F.size("vector")).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    key = ["label", "dims", "h1", "h2"]
    same = keyed.where("fit").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    same = keep(same, "vectors-distinct")
    coded = keep(hashed(same.select("rep", "label", "dims", "weight", "vector"), tables, projections, width, seed), "vectors-coded")
    bucket = ["label", "dims", "table", "code"]
    entries = coded.select("rep", "label", "dims", F.posexplode("codes").alias("table", "code"))
    shared = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = entries.join(shared, bucket).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("rep", "table", "code", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = keep(compared(met.join(coded, "rep"), threshold), "vectors-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found, "rep", "root").select(F.col("node").alias("rep"), "component")
    reps = same.select(*key, "rep", "weight").join(links, "rep", "left").join(parts, "rep", "left")
    out = keyed.where("fit").select("vec_id", *key).join(reps, key, "left")
    ends = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = all_rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ends.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
