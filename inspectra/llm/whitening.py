"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers (scaled and shifted), so sums and deviations are exact. The covariance itself is never formed:
a pass over the rows multiplies it with a block of columns, X'(XQ)/n with centred rows, in the tasks that hold the rows;
Spark adds up the parts by dimension. A filter is a three-term recurrence of such passes: the Chebyshev polynomial stays
within 1 on the unwanted spectrum, from a bound below all eigenvalues to the smallest Ritz value of the block, and grows fast
above it, however small the spread of the eigenvalues is beside their size (many vectors drawn alike leave it tiny). QR and
Rayleigh-Ritz follow; pairs that are done are held and kept out of the filter, so that the rest is not lost beside them. The
result is certified when every wanted pair's residual is at the limit of double precision and the
unwanted rest, deflated, shows no larger eigenvalue: random columns outside the block go through a filter of their own.

Only matrices of dimensions by block pass through the driver, never rows.

Defined cases: rows whose vector is null, or holds null, non-finite or too large entries, and rows whose length is not the
commonest one (of equals, the longest) are dropped; null and repeated ids and repeated rows count and return as rows;
directions without variance have no component, so equal or single rows return nothing, nor does an empty table; columns
besides id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

COMPONENTS, SCALE, SHIFT, SEED = 32, 64, 1_000_000, 11
#: Columns of the block besides the wanted ones, the passes of a filter, and the most filters.
GUARD, DEGREE, MOST_FILTERS = 16, 8, 60
#: Residual of a certified pair (a hundredfold where rounding lets it fall no further) and size below which a direction counts as without variance, as shares of the largest
#: eigenvalue.
RESIDUAL, FLAT = 1e-13, 1e-12
#: Random columns that look for eigenvalues outside the block, passes over them, and what they may find above the last wanted.
PROBES, PROBE_PASSES, ABOVE = 4, 16, 1e-6
#: Passes that bound the eigenvalues from below, narrowest damped interval (a share of the largest eigenvalue), and the most that a
#: filter may raise the largest above the damped ones: beyond it, rounding of the first columns would cover the others.
LOW_PASSES, NARROW, RAISED = 12, 1e-10, 1e10
#: Larger entries are dropped: their squares would leave what exact sums can hold.
LARGEST = float(1 << 40)


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int, shift: int) -> DataFrame:
    """vec_id and x, whole numbers, of the vectors that can be used; of the commonest length."""
    v = F.col(vector)
    fit = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale))
    some = rows.where(F.coalesce(fit, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale) + shift).alias("x"))
    length = some.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return keep(some.where(F.size("x") == (length or 0)), "whitening-rows")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch["x"]
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


class Centred:
    """The centred rows of a table of whole vectors, and passes over them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
        found = sorted(sums.collect())  # a row per dimension
        self.n, self.d = (int(found[0]["n"]) if found else 0), len(found)
        self.sums = [int(r["s"]) for r in found]

    def centre(self):
        """A function from a batch to its centred rows: (n x - S) / n, the numerator exact."""
        n, whole = self.n, max(map(abs, self.sums), default=0)
        if n * (LARGEST + SHIFT) + whole < 2**62:
            s = np.array(self.sums, "int64")
            return lambda batch: (n * matrix(batch) - s) / n
        near = np.array([x // n for x in self.sums], "int64")
        rest = np.array([x % n / n for x in self.sums])
        return lambda batch: (matrix(batch) - near) - rest

    def added(self, part, width: int) -> np.ndarray:
        """The sum over all rows of part(centred rows), matrices of `width` columns: added by row of the matrix in Spark."""
        centre = self.centre()
        schema = ", ".join(["i int", *[f"c{k} double" for k in range(width)]])
        names = ["i", *[f"c{k}" for k in range(width)]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for begin in range(0, batch.num_rows, 4096):
                    found = part(centre(batch.slice(begin, 4096)))
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="int32")), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], names)

        out = self.rows.select("x").mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect()
        return np.array([list(r[1:]) for r in sorted(out)])

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q, in one pass."""
        return self.added(lambda x: x.T @ (x @ q), q.shape[1]) / self.n

    def trace(self) -> float:
        return float(self.added(lambda x: np.array([[float((x * x).sum())]]), 1)[0, 0]) / self.n


def filtered(times, q: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the covariance, scaled to 1 at `top`, times q: small on [low, cut], large above."""
    e, c = (cut - low) / 2, (cut + low) / 2
    sigma = first = e / (top - c)
    y, before = (times(q) - c * q) * (sigma / e), q
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        y, before = 2 * (new / e) * (times(y) - c * y) - (sigma * new) * before, y
        sigma = new
    return y


def damped(low: float, cut: float, top: float, degree: int) -> tuple[float, int]:
    """The lower end of the damped interval that ends at `cut`, and the degree with which `top` is raised by RAISED at most."""
    low = min(low, cut - NARROW * top)
    rise = np.arccosh(max((2 * top - cut - low) / (cut - low), 1 + 1e-9))
    return low, max(1, min(degree, int(np.log(2 * RAISED) / rise)))


def outside_of(times, held: np.ndarray, inner: float):
    """`times` for columns outside the held ones, whose own directions get the eigenvalue `inner`: one that a filter damps."""
    if not held.shape[1]:
        return times

    def product(p: np.ndarray) -> np.ndarray:
        inside = held @ (held.T @ p)
        v = times(p - inside)
        return v - held @ (held.T @ v) + inner * inside

    return product


def lowest(times, d: int, seed: int) -> float:
    """A bound below the eigenvalues: the smallest Ritz value of a few block Lanczos steps, less its residual; 0 at least."""
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    new = np.random.default_rng(seed + 2).standard_normal((d, min(PROBES, d)))
    for _ in range(LOW_PASSES):
        new = new[:, : d - basis.shape[1]]
        if not new.shape[1]:
            break
        for _ in range(3):
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        basis, new = np.hstack([basis, new]), times(new)
        images = np.hstack([images, new])
    small = basis.T @ images
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return max(0.0, values[0] - np.linalg.norm(images @ turn[:, 0] - basis @ turn[:, 0] * values[0]))


class NotCertified(ArithmeticError):
    """The filters ended before residuals and rest were within their bounds."""


def leading(times, d: int, wanted: int, guard: int, degree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of the covariance that `times` multiplies with, certified."""
    width = min(d, wanted + guard)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    low = lowest(times, d, seed) if width < d else 0.0
    last, share, held = np.inf, 1.0, 0
    for _ in range(MOST_FILTERS):
        v = times(q)
        small = q.T @ v
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, v = q @ turn, v @ turn
        top = values[0]
        if not top > 0:
            return np.zeros(0), np.zeros((d, 0))
        here = min(wanted, int((values > FLAT * top).sum()))
        each = np.linalg.norm(v[:, :here] - q[:, :here] * values[:here], axis=0)
        far = each.max()
        limit, stalled = RESIDUAL * top * d**0.5, far > last / 2
        if (far <= limit or (stalled and far <= 100 * limit)) and nothing_above(times, q, values, here, seed, low):
            return values[:here], q[:, :here]
        share, last = share * 0.7 if stalled else share, far  # equal eigenvalues at the block's edge: damp less of them
        if width == d:  # the block is the whole space: the pairs become exact by turning alone
            q = np.linalg.qr(q)[0]
            continue
        done = int(np.argmax(np.append(each > RESIDUAL * top, True)))  # leading pairs that need no more filters
        done = 0 if done == here else done  # nothing_above found more
        share, held = share if done == held else 1.0, done
        cut = max(low + share * (values[-1] - low), FLAT * top)
        begin, passes = damped(low, cut, values[done], degree)
        q = np.linalg.qr(np.hstack([q[:, :done], filtered(outside_of(times, q[:, :done], cut), q[:, done:], passes, begin, cut, values[done])]))[0]
    raise NotCertified(f"residual {far / top:.1e} of the largest eigenvalue after {MOST_FILTERS} filters")


def nothing_above(times, q: np.ndarray, values: np.ndarray, wanted: int, seed: int, low: float = 0.0) -> bool:
    """Whether random columns outside the block show no eigenvalue above the last wanted one, after a filter of the deflated
    covariance that damps all from `low` up to the block's smallest Ritz value."""
    if q.shape[1] >= len(q):
        return True
    cut = max(values[-1], FLAT * values[0])
    begin, passes = damped(low, cut, values[0], PROBE_PASSES)
    deflated = outside_of(times, q, cut)
    outside = lambda p: p - q @ (q.T @ p)
    p = outside(np.random.default_rng(seed + 1).standard_normal((len(q), min(PROBES, len(q) - q.shape[1]))))
    p = np.linalg.qr(outside(filtered(deflated, p, passes, begin, cut, values[0])))[0]
    found = p.T @ outside(times(p))
    return np.linalg.eigvalsh((found + found.T) / 2)[-1] <= values[wanted - 1] * (1 + ABOVE) + FLAT * values[0]


def whiten(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, *, scale: int = SCALE, shift: int = SHIFT,
    guard: int = GUARD, degree: int = DEGREE, seed: int = SEED,
) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    data = Centred(whole_vectors(rows, vec_id, vector, scale, shift))
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    values, axes = leading(data.times, data.d, components, guard, degree, seed) if data.n else (np.zeros(0), np.zeros((0, 0)))
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    explained = values / data.trace()
    scaled = axes / np.sqrt(values)
    k = len(values)
    mean = data.added(lambda x: (x @ scaled).sum(axis=0, keepdims=True), k)[0] / data.n

    def products(x: np.ndarray) -> np.ndarray:
        w = x @ scaled - mean
        return w.T @ w

    error = float(np.abs(data.added(products, k) / data.n - np.eye(k)).max())
    n, sums, centre = data.n, data.sums, data.centre()
    names = schema.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                some = batch.slice(begin, 2048)
                white = centre(some) @ scaled
                whole = deviations(matrix(some), n, sums)
                m = len(white)
                yield pa.RecordBatch.from_arrays(
                    [
                        some["vec_id"].take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), m)), pa.array(np.full(m * k, n)),
                        whole.take(pa.array(np.repeat(np.arange(m), k))), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    [f.split()[0] for f in names],
                )

    return data.rows.mapInArrow(run, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null where a long cannot hold it."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    gap = n * x - np.array(sums, "int64") if most < 2**62 else None
    if gap is not None and int(np.abs(gap).max(initial=0)) ** 2 * x.shape[1] < 2**63:
        return pa.array((gap * gap).sum(axis=1))
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())
