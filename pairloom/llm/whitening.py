"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass over the vectors multiplies the centred
matrix, XᵀXQ, with a block of a few columns: tasks send one small matrix each,
added up in two levels in a fixed order. A Chebyshev polynomial of the
covariance, applied by its three-term recurrence of such passes, damps the
spectrum below the block; QR and a Rayleigh-Ritz step follow. It ends when the
residuals certify the wanted components: residual over the gap to the next
Ritz value bounds the angle to the true eigenvector.

Entries are first made integers, floor(1024 c) + 100000. Sums are exact, and
an entry is centred as the integer x - (S div n) less the fraction (S mod n)/n,
so that the size of the mean costs no digits.

Rows: vectors that are null, hold null or non-finite entries, entries whose
integer does not fit a long, or another length than the most frequent one
(of equally frequent ones the longest) are left out. Repeated ids are separate
vectors, null ids stay null. Components without variance are left out, so one
vector alone, or none, gives no rows.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.frames import tuned

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
BLOCK = 32
DEGREE = 12
ANGLE = 1e-11
MAX_CYCLES = 200
SUMMED_AT_ONCE = 64
LIMIT = 2.0**52  # of 1024 c: beyond it doubles have no fractions, and squares of a row no room

OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def integers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a column take part, and their entries as integers, a row for each."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = lengths == dimension
    flat = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * SCALE).reshape(-1, dimension)
    good = (np.abs(scaled) < LIMIT).all(axis=1)  # false for NaN, which a null entry is here
    kept = np.flatnonzero(right)[good]
    return kept, scaled[good].astype(np.int64) + SHIFT


@dataclass
class Moments:
    """Exact sums of the fit list, as n * whole + rest per dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, in Python integers."""
        low = x - self.whole
        top = int(np.abs(low).max(initial=0))
        if max(top * top, top * self.n) * x.shape[1] >= 1 << 62:
            low = low.astype(object)
        squares, mixed = (low * low).sum(axis=1).tolist(), (low * self.rest).sum(axis=1).tolist()
        rest = sum(r * r for r in self.rest.tolist())
        return [self.n * self.n * a - 2 * self.n * b + rest for a, b in zip(squares, mixed)]


def dimension_of(vectors: DataFrame) -> int:
    """The most frequent length of a vector without null, infinite or huge entries; 0 if there is none."""
    usable = F.forall("vector", lambda c: c.isNotNull() & (F.floor(F.abs(c) * SCALE) < LIMIT) & (F.abs(c) < LIMIT))
    lengths = vectors.where(F.col("vector").isNotNull() & usable).groupBy(F.size("vector").alias("length")).count()
    row = lengths.where("length > 0").orderBy(F.desc("count"), F.desc("length")).first()
    return row["length"] if row else 0


def moments(vectors: DataFrame, dimension: int) -> Moments:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimension, object)
        for batch in batches:
            _, x = integers(batch.column(0), dimension)
            n += len(x)
            # Halves of 32 bits: their sums over a batch can not leave a long.
            total += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(dimension, dtype=np.int32)),
                pa.array(np.full(dimension, n)),
                pa.array([Decimal(t) for t in total.tolist()], pa.decimal128(38, 0)),
            ],
            ["dim", "n", "total"],
        )

    sums = vectors.select("vector").mapInArrow(run, "dim int, n long, total decimal(38,0)")
    rows = sums.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    rows.sort(key=lambda r: r["dim"])
    n = rows[0]["n"]
    parts = [divmod(int(r["total"]), n) for r in rows]
    return Moments(n, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))


def summed(vectors: DataFrame, dimension: int, m: Moments, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(centred rows)`` over all vectors; the order of adding does not depend on the run."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            _, x = integers(batch.column(0), dimension)
            total += part(m.centred(x))
        yield _matrix(TaskContext.get().partitionId(), total)

    def per_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, group = np.zeros(shape), None
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += np.frombuffer(raw).reshape(shape)
                group = at if group is None else group
        if group is not None:
            yield _matrix(group, total)

    parts = vectors.select("vector").mapInArrow(per_task, "part int, total binary")
    tasks = vectors.rdd.getNumPartitions()
    if tasks > SUMMED_AT_ONCE:
        groups = math.isqrt(tasks)
        dealt = parts.repartition(groups, F.col("part") % groups).sortWithinPartitions("part")
        parts = dealt.mapInArrow(per_group, "part int, total binary")
    out = np.zeros(shape)
    for row in sorted(parts.collect()):
        out += np.frombuffer(row["total"]).reshape(shape)
    return out


def _matrix(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])


# --- the iteration ------------------------------------------------------------


def filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, top: float, cut: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the matrix on [0, cut], scaled to one at ``top``, times q. Takes degree - 1 passes."""
    half = cut / 2
    first = half / (top - half)
    sigma, before, now = first, q, (vq - half * q) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - half * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def degree_for(top: float, cut: float) -> int:
    """At most ``DEGREE``, fewer where the top would outgrow the rest of the block by more than 1e10."""
    return max(1, min(DEGREE, int(math.log(1e10) / math.acosh(max(1 + 1e-9, 2 * top / cut - 1)))))


def leading(apply: Callable[[np.ndarray], np.ndarray], dimension: int, k: int, block: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors of a positive matrix known by ``apply`` alone."""
    block = min(dimension, max(block, 2 * k))
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, block)))
    vq = apply(q)
    best, stuck = math.inf, 0
    for _ in range(MAX_CYCLES):
        h = q.T @ vq
        ritz, turn = np.linalg.eigh((h + h.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = float(ritz[0])
        if top <= 0:
            return ritz[:k], q[:, :k]
        residual = np.linalg.norm(vq[:, :k] - q[:, :k] * ritz[:k], axis=0)
        apart = np.abs(ritz[:k, None] - ritz[None, :])
        apart[np.arange(len(apart)), np.arange(len(apart))] = np.inf
        gap = apart.min(axis=1, initial=math.inf)
        worst = float((residual / np.maximum(gap, 1e-300)).max())
        # Equal eigenvalues have no gap: there the residual itself reaches the rounding of a pass.
        rounding = float(residual.max()) <= 1e-13 * top
        stuck = 0 if worst < best / 2 else stuck + 1
        best = min(best, worst)
        if block == dimension or worst <= ANGLE or (rounding and stuck >= 2):
            return ritz[:k], q[:, :k]
        cut = max(float(ritz[-1]), 1e-12 * top)
        q, _ = np.linalg.qr(filtered(apply, q, vq, top, cut, degree_for(top, cut)))
        vq = apply(q)
    raise ArithmeticError(f"components not certified after {MAX_CYCLES} cycles")


@dataclass
class Whitener:
    """What turns a vector into its whitened components."""

    dimension: int
    moments: Moments
    values: np.ndarray
    components: np.ndarray  # a column for each
    trace: float
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.moments.centred(x) @ self.components) / np.sqrt(self.values)


def as_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def fit(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> Whitener | None:
    """A whitener of all vectors of a table, or none where there is no variance."""
    tuned(rows.sparkSession)
    vectors = as_vectors(rows, id_col, vector_col)
    dimension = dimension_of(vectors)
    if not dimension:
        return None
    m = moments(vectors, dimension)

    def product(q: np.ndarray) -> np.ndarray:
        return summed(vectors, dimension, m, q.shape, lambda c: c.T @ (c @ q)) / m.n

    trace = float(summed(vectors, dimension, m, (dimension,), lambda c: (c * c).sum(axis=0)).sum()) / m.n
    if trace <= 0:
        return None
    k = min(components, dimension)
    values, vectors_of = leading(product, dimension, k, block)
    filled = values > 1e-13 * dimension * values[0]
    out = Whitener(dimension, m, values[filled], vectors_of[:, filled], trace, 0.0)
    k = int(filled.sum())

    def second_moment(c: np.ndarray) -> np.ndarray:
        w = np.hstack([(c @ out.components) / np.sqrt(out.values), np.ones((len(c), 1))])
        return w.T @ w

    s = summed(vectors, dimension, m, (k + 1, k + 1), second_moment) / m.n
    out.identity_error = float(np.abs(s[:k, :k] - np.outer(s[k, :k], s[k, :k]) - np.eye(k)).max())
    return out


def transform(rows: DataFrame, model: Whitener | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each component."""
    vectors = as_vectors(rows, id_col, vector_col)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    explained = model.values / model.trace
    k = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = integers(batch.column(1), model.dimension)
            n = len(kept)
            if not n:
                continue
            deviation = [Decimal(d) if d < 10**38 else None for d in model.moments.deviations(x)]
            each = np.repeat(np.arange(n), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.moments.n)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, n)),
                    pa.array(np.full(n * k, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, OUT)


def whitening(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit and transform. A deviation that does not fit a long is null."""
    out = transform(rows, fit(rows, components, id_col, vector_col), id_col, vector_col)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
