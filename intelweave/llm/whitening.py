"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of the distinct vectors are found without V itself: a pass
over the vectors gives V·Q for a block Q of a few columns, as partial sums of Cᵀ(C·Q) over centred blocks
C, added up in two steps. Between passes a three-term recurrence builds p(V)·Q for the Chebyshev
polynomial p that stays within ±1 on the unwanted part of the spectrum and grows fast beyond it. Then Q is
made orthonormal (QR) and rotated to the eigenvectors of QᵀVQ (Rayleigh-Ritz), which gives eigenvalues,
residuals and the next bounds. This is repeated until the residuals of all wanted pairs are as small as
double precision allows; the product of the last pass is the first one of the next recurrence.

Entries are scaled to integers, so counts, sums and deviations are exact. Centring subtracts an integer
first and the fraction afterwards, so it loses nothing to the size of the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave.llm.common import staged

SCALE, SHIFT = 64, 1_000_000
_MOST = 1 << 52  # of a scaled entry: beyond, neighbouring doubles are no longer told apart
_BLOCK = 8192  # vectors of a stored block
_SLOTS = 16  # tasks that add up partial sums before the driver adds theirs


def scaled(vector: Column) -> Column:
    """``floor(64 * entry) + 1000000`` as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite, and no larger than a double keeps apart."""
    good = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < _MOST / SCALE, F.lit(False)))  # NaN is larger than all
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def fit_blocks(rows: DataFrame, dim: int) -> DataFrame:
    """The distinct vectors ``x`` as blocks (n, size, data): little-endian integers of 4 bytes, or 8 where needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: np.ndarray) -> pa.RecordBatch:
            size = 4 if np.abs(part).max() < 1 << 31 else 8
            return pa.RecordBatch.from_arrays([pa.array([len(part)]), pa.array([size], pa.int32()), pa.array([part.astype(f"<i{size}").tobytes()], pa.binary())], names=["n", "size", "data"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).flatten().to_numpy().reshape(-1, dim) - SHIFT)
                n += batch.num_rows
            if n >= _BLOCK:
                yield block(np.concatenate(held))
                held, n = [], 0
        if n:
            yield block(np.concatenate(held))

    return rows.select("x").distinct().mapInArrow(run, "n long, size int, data binary")


def _added(blocks: DataFrame, part, shape: tuple[int, ...], kind: str = "<f8") -> np.ndarray:
    """Sum of ``part(vectors)`` over all blocks: within a task, then in ``_SLOTS`` tasks, then here."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(shape, kind), 0
        for batch in batches:
            for size, data in zip(batch.column("size").to_pylist(), batch.column("data")):
                total += part(np.frombuffer(data.as_buffer(), f"<i{size}").reshape(-1, shape[0]))
                at += 1
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(shape, kind), 0
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(data.as_buffer(), kind).reshape(shape)
                at += 1
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = blocks.select("size", "data").mapInArrow(first, "sums binary").repartition(_SLOTS).mapInArrow(second, "sums binary").collect()
    return np.sum([np.frombuffer(r["sums"], kind).reshape(shape) for r in sums], 0) if sums else np.zeros(shape, kind)


@dataclass
class Moments:
    """Count and exact sums of the distinct vectors, less ``SHIFT`` an entry."""

    n: int
    sums: list[int]

    @property
    def base(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - int(b) * self.n) / self.n for s, b in zip(self.sums, self.base)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.int64) - self.base).astype(np.float64) - self.rest


@dataclass
class Spectrum:
    """Leading eigenpairs: ``values`` falling, ``vectors`` in columns; the trace, passes made and largest residual over the first value."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residual: float


def moments(blocks: DataFrame, dim: int) -> Moments:
    """Exact sums: 32-bit halves are added as longs, so 2**31 vectors cannot overflow them."""
    def halves(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)], 1)

    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    both = _added(blocks, halves, (dim, 2), "<i8").tolist()
    return Moments(n, [(high << 32) + low for high, low in both])


def leading(blocks: DataFrame, m: Moments, count: int, tolerance: float = 1e-13, most_passes: int = 400, seed: int = 7) -> Spectrum:
    """The ``count`` leading eigenpairs of the covariance of the blocks' vectors.

    The block holds three times as many columns, at most all dimensions; then one pass is exact. The
    unwanted interval ends at the least Ritz value. Its lower end is taken from the mean and the spread of
    the unwanted eigenvalues (trace and Frobenius norm less what the block holds) and never trusted: should
    a round lose ground, it falls back to 0, below which no covariance has an eigenvalue. A pair is
    certified when its residual is within ``tolerance`` of the largest eigenvalue, or when rounds no longer
    lower a residual of a hundred times that (the limit of rounding). Without that after ``most_passes``, an error says so.
    """
    dim = len(m.sums)
    width = min(dim, 3 * count)

    def through(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = m.centred(x)
            return np.hstack([c.T @ (c @ q), np.square(c).sum(0)[:, None]])

        nonlocal trace, passes
        out = _added(blocks, part, (dim, width + 1)) / m.n
        trace, passes = float(out[:, -1].sum()), passes + 1
        return out[:, :-1]

    trace, passes, best = 0.0, 0, np.inf
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    low_trusted, was = True, None
    norm2 = None
    while True:
        vq = through(q)
        if norm2 is None:
            norm2 = float(np.square(vq).sum()) * dim / width  # of V, by random columns
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(float(values[0]), 0.0)
        apart = np.linalg.norm(vq - q * values, axis=0)[:count]
        residual = float(apart.max()) / top if top else 0.0
        if width == dim or residual <= tolerance or (residual <= 100 * tolerance and residual > best / 2):
            return Spectrum(values[:count], q[:, :count], trace, passes, residual)
        if passes >= most_passes:
            raise ArithmeticError(f"residual {residual:.1e} after {passes} passes")
        if was is not None and values[:count].sum() < was * (1 - 1e-9):
            low_trusted = False
        was, best = float(values[:count].sum()), min(best, residual)

        high = max(float(values[-1]), 1e-300)
        left = max(trace - float(values.sum()), 0.0) / (dim - width)
        spread = max((norm2 - float(np.square(values).sum())) / (dim - width) - left * left, 0.0)
        low = min(max(left - 3 * np.sqrt(spread), 0.0), left) if low_trusted else 0.0
        low = min(low, 0.98 * high)
        middle, half = (high + low) / 2, (high - low) / 2
        # beyond this degree the first column's direction would drown the others in rounding
        steep = np.arccosh(max((top - middle) / half, 1 + 1e-12))
        degree = int(min(max(18 / steep, 2), 12))
        before, now = q, (vq - middle * q) / half
        for _ in range(degree - 1):
            before, now = now, 2 / half * (through(now) - middle * now) - before
            size = np.linalg.norm(now, axis=0)
            before, now = before / size, now / size
        q = np.linalg.qr(now)[0]


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """Sum over dimensions of (n·x − S)²; null where a long cannot hold it. ``x`` less ``SHIFT``."""
    away = np.square(m.centred(x) * float(m.n)).sum(1)
    if not len(x) or away.max() < 2.0**61:
        part = (x - m.base) * m.n - np.array([s - int(b) * m.n for s, b in zip(m.sums, m.base)], np.int64)
        return np.square(part).sum(1).tolist()
    exact = [sum((m.n * v - s) ** 2 for v, s in zip(row, m.sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, count: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Left out: vectors that are null or empty or hold null, NaN, infinite or absurdly large (2**46) entries,
    and vectors of another length than most rows have (of equally frequent ones the longest counts). The fit
    looks at each distinct vector once, so copies add nothing, however many; rows that repeat are all
    reported, null ids too. Components of no variance cannot be scaled to one: there are as many as the rank,
    at most ``count``, and no rows if all vectors are equal or the table is empty. Other columns are left
    out, so their names cannot clash. A deviation beyond a long is null.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["d"]
    rows = rows.filter(F.size("v") == dim).select("id", scaled(F.col("v")).alias("x"))
    blocks = staged(fit_blocks(rows, dim), "blocks")
    m = moments(blocks, dim)
    found = leading(blocks, m, min(count, dim))
    live = found.values > max(found.values[0], 0.0) * 1e-12
    if not live.any():
        return spark.createDataFrame([], schema)
    values, axes = found.values[live], found.vectors[:, live] / np.sqrt(found.values[live])
    k = len(values)

    def products(x: np.ndarray) -> np.ndarray:
        w = m.centred(x) @ axes
        return np.vstack([w.T @ w, np.zeros((dim - k, k))])

    error = float(np.abs(_added(blocks, products, (dim, k))[:k] / m.n - np.eye(k)).max())
    explained = values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                x = part.column(1).flatten().to_numpy().reshape(-1, dim) - SHIFT
                n = len(x)
                away = pa.array(deviations(x, m), pa.int64())
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m.n)), away.take(each),
                     pa.array((m.centred(x) @ axes).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
