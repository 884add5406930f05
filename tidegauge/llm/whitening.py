"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The covariance is never formed. One pass over the fit list multiplies it with a block of vectors:
every task centres its rows, computes ``X'(XQ)`` and sums over its tiles, and the partial blocks,
as wide as the block and as tall as the dimension, are added up. A Chebyshev recurrence of such
passes damps the spectrum below the wanted eigenvalues, QR and a Rayleigh-Ritz step turn the block,
until the residuals of the wanted pairs certify them or rounding lets them fall no further.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import col, cut_lineage
from tidegauge.llm.vectors import finite, matrices

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
GUARD = 16  # vectors of the block beyond the wanted ones
DEGREE = 10  # of the filter polynomial: passes between two Rayleigh-Ritz steps
TOLERANCE = 1e-14  # wanted residual, relative to the largest eigenvalue
LIMIT = 1e-10  # residual that must be reached at least
PROBES = 12  # Lanczos passes that find the ends of the spectrum
LARGEST = 2.0**62  # of an entry that a long can hold
TILE_BYTES = 4 << 20
TASK_BYTES = 64 << 20  # of the tiles that one task of a pass reads
FEW_PARTS = 32  # partial sums that are added on the driver in one go
_LONG = np.iinfo(np.int64).max

Product = Callable[[np.ndarray], np.ndarray]


def grid(matrix: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.floor(scale * matrix).astype(np.int64) + shift


def _tiles(vectors: DataFrame, dim: int, n: int) -> DataFrame:
    """The ``n`` rows ``x`` (array of longs), packed into tiles of bounded bytes and written once.

    A pass takes as many tasks as the bytes ask for, or as there are cores: there are many passes.
    """
    wanted = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-n * dim * 8 // TASK_BYTES))
    rows = max(1, TILE_BYTES // (8 * dim))

    def pack(batches):
        for batch in batches:
            for _, m in matrices(batch.column(0)):
                for at in range(0, len(m), rows):
                    yield pa.RecordBatch.from_arrays([pa.array([m[at : at + rows].astype(np.int64).tobytes()], pa.binary())], ["tile"])

    return cut_lineage(vectors.coalesce(wanted).mapInArrow(pack, "tile binary"))


def _total(tiles: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray], kind=np.float64) -> np.ndarray:
    """The sum of ``of(tile)``, a block of one shape, over all tiles; partial sums meet in two steps if they are many."""

    def add(batches, take):
        total = None
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                got = take(cell)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = tiles.mapInArrow(lambda b: add(b, lambda c: of(np.frombuffer(c, np.int64).reshape(-1, dim)).astype(kind)), "part binary")
    count = tiles.rdd.getNumPartitions()
    if count > FEW_PARTS:
        parts = parts.repartition(max(2, int(count**0.5))).mapInArrow(lambda b: add(b, lambda c: np.frombuffer(c, kind)), "part binary")
    return sum(np.frombuffer(r.part, kind) for r in parts.collect())


@dataclass(frozen=True)
class Whitening:
    """``x`` goes to ``(x - sums / n) @ directions / sqrt(values)``."""

    n: int
    sums: tuple[int, ...]  # of x, exact
    values: np.ndarray
    directions: np.ndarray  # a column a component
    trace: float
    residual: float  # of the worst component, relative to the largest eigenvalue
    passes: int
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.directions / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sums)^2, exact."""
        base = int(np.median(x)) if x.size else 0
        offset = [s - self.n * base for s in self.sums]
        most = self.n * int(np.abs(x - base).max(initial=0)) + max(map(abs, offset), default=0)
        if most**2 * max(1, len(self.sums)) <= _LONG:
            off = self.n * (x - base) - np.array(offset, np.int64)
            return (off * off).sum(axis=1).tolist()
        return [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]


def _centred(x: np.ndarray, n: int, sums) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def _spectrum(times: Product, dim: int) -> tuple[float, float]:
    """A bound below the spectrum and a value inside it that a quarter lies above, from Lanczos passes."""
    rng = np.random.default_rng(5)
    q = rng.standard_normal(dim)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(dim, PROBES)):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            w = w - sum((w @ b) * b for b in basis)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        basis.append(w / beta[-1])
    ritz, turn = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    low = ritz[0] - abs(beta[len(alpha) - 1] * turn[-1, 0])
    return max(0.0, float(low)), float(np.quantile(ritz, 0.75))


def _filtered(times: Product, block: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance times the block: at most one on [low, high], scaled to one at ``top``."""
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = block, (times(block) - centre * block) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def leading(times: Product, dim: int, k: int, guard: int = GUARD, degree: int = DEGREE, cycles: int = 60):
    """(values, vectors, worst relative residual) of the ``k`` largest eigenpairs of a symmetric positive operator."""
    width = min(dim, k + guard)
    block = np.linalg.qr(np.random.default_rng(3).standard_normal((dim, width)))[0]
    low, high = _spectrum(times, dim) if width < dim else (0.0, 0.0)
    best = None
    for cycle in range(cycles):
        image = times(block)
        small = block.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = max(float(ritz[0]), np.finfo(float).tiny)
        residual = float(np.linalg.norm(image - block * ritz, axis=0)[:k].max() / top)
        stalled = best is not None and best[2] <= LIMIT and residual > best[2] / 2
        if best is None or residual < best[2]:
            best = ritz[:k], block[:, :k], residual
        if residual <= TOLERANCE or stalled:
            break
        if width < dim:
            high = max(high, float(ritz[-1])) if cycle == 0 else float(ritz[-1])
            high = min(high, float(ritz[min(k, width - 1)]))  # the wanted ones lie outside
            if high - low <= 1e-12 * top:
                low = max(0.0, high - 1e-3 * top)
            block = _filtered(times, block, low, high, top * (1 + 1e-9), degree)
        block = np.linalg.qr(block)[0]
    return best


def fit(vectors: DataFrame, k: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> Whitening | None:
    """Whitening of the distinct rows ``x`` (arrays of longs, all of one length); None if they do not vary."""
    listed = cut_lineage(vectors.select("x").distinct())
    first = listed.select(F.size("x").alias("dim"), F.element_at("x", 1)).first()
    if first is None or not first.dim:
        return None
    dim, n = first.dim, listed.count()
    tiles = _tiles(listed, dim, n)
    # Halves of 32 bits: their sums are exact in 64 bits for two thousand million rows.
    halves = _total(tiles, dim, lambda x: np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), np.int64)
    sums = tuple((int(h) << 32) + int(w) for h, w in zip(halves[:dim], halves[dim:], strict=True))
    passes = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x):
            z = _centred(x, n, sums)
            return z.T @ (z @ block)

        return _total(tiles, dim, part).reshape(block.shape) / n

    squares = _total(tiles, dim, lambda x: (_centred(x, n, sums) ** 2).sum(axis=0))
    trace = float(squares.sum()) / n
    if not trace > 0:
        return None
    values, directions, residual = leading(times, dim, min(k, dim), guard, degree)
    if residual > LIMIT:
        raise RuntimeError(f"eigenpairs not certified: residual {residual:.1e}")
    real = values > 1e-12 * trace  # a direction without variance cannot be whitened
    values, directions = values[real], directions[:, real]
    largest = np.abs(directions).argmax(axis=0)
    directions = directions * np.sign(directions[largest, np.arange(len(values))])

    def moments(x):
        w = _centred(x, n, sums) @ directions / np.sqrt(values)
        return np.concatenate([w.sum(axis=0)[None], w.T @ w])

    got = _total(tiles, dim, moments).reshape(len(values) + 1, -1) / n
    error = got[1:] - np.outer(got[0], got[0]) - np.eye(len(values))
    return Whitening(n, sums, values, directions, trace, residual, passes, float(np.abs(error).max()))


ADDED = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "deviation_exact string, residual double"
)


def whitened(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
    guard: int = GUARD,
    degree: int = DEGREE,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, ...) of every usable row and component.

    Entries become ``floor(scale * c) + shift``. Rows whose vector is null, empty, holds null or
    non-finite entries, or entries that no long can hold, are left out. Whitening is fitted once on
    every distinct vector; repeated rows and rows without an id are kept in the result, ties and
    copies get equal values. ``deviation`` is null where a long cannot hold it, and exact as text in
    ``deviation_exact``; ``residual`` is the certified error of the worst eigenpair. Components
    without variance are left out, so vectors that do not vary give no rows. Vectors of another
    length are another space with a fit of its own, one after the other. An empty table gives an
    empty one; other columns are ignored.
    """
    v = F.col("v")
    given = rows.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v"))
    given = given.where(finite(v) & (F.size("v") > 0) & F.forall(v, lambda c: F.abs(c * scale) < LARGEST))
    kind = rows.select(col(id_col)).schema[0].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + list(T._parse_datatype_string(f"struct<{ADDED}>").fields))

    def snapped(batches):
        for batch in batches:
            for _, m in matrices(batch.column(0)):
                x = grid(m, scale, shift)
                offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["x"])

    out = None
    for (dim,) in sorted(given.select(F.size("v")).distinct().collect()):
        own = given.where(F.size("v") == dim)
        model = fit(own.select("v").mapInArrow(snapped, "x array<bigint>"), k, guard, degree)
        if model is not None:
            part = own.mapInArrow(_projected(model, scale, shift, schema.names), schema)
            out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _projected(model: Whitening, scale: int, shift: int, names: list[str]):
    k = len(model.values)
    explained = model.values / model.trace

    def run(batches):
        for batch in batches:
            for places, m in matrices(batch.column(1)):
                for at in range(0, len(m), 4096):
                    x = grid(m[at : at + 4096], scale, shift)
                    rows, exact = len(x), model.deviations(x)
                    each = np.repeat(np.arange(rows), k)
                    fits = [d if d <= _LONG else None for d in exact]
                    size = rows * k
                    arrays = [
                        batch.column(0).take(pa.array(places[at + each])),
                        pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                        pa.array(np.full(size, model.n), pa.int64()),
                        pa.array(fits, pa.int64()).take(pa.array(each)),
                        pa.array(model.apply(x).ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(size, model.identity_error)),
                        pa.array(list(map(str, exact)), pa.string()).take(pa.array(each)),
                        pa.array(np.full(size, model.residual)),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return run
