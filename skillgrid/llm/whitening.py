"""Embedding whitening by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgrid.llm.vectors import matrix, summed, whole_numbers

COMPONENTS, GUARD, SCALE, SHIFT = 32, 16, 64, 1_000_000
#: Scaled components beyond +-LIMIT count as that: sums and products with the number of rows stay in 64 bits up to 2**32 rows.
LIMIT = 1 << 30
#: A component is certified when the residual of its eigenpair is below this share of the largest eigenvalue.
CERTAIN = 1e-13
#: Below this share of the largest eigenvalue, a component has no variance that rounding leaves.
FLAT = 1e-11
CYCLES, DEGREE = 60, 12
#: Largest factor by which a filter may raise the first wanted component over the last: beyond it, rounding hides the last.
SPREAD = 1e7
ROWS = 4096


@dataclass
class Whitening:
    """Fit over all rows: numbers of rows and their sums, unit components (columns) with eigenvalues, trace, passes made, residual reached."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residual: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n of whole numbers: the difference is taken exactly, then divided once."""
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def _sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    def part(batches):
        total = np.zeros((width + 1, 1), np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            total[:width, 0] += x.sum(0)
            total[width] += len(x)
        return total

    part.whole = True
    total = summed(rows.select("x"), width + 1, 1, part)[:, 0]
    return int(total[width]), total[:width]


def _rayleigh_ritz(q: np.ndarray, aq: np.ndarray):
    """Ritz values in falling order, Ritz vectors, what the covariance makes of these, and their residuals."""
    h = q.T @ aq
    values, u = np.linalg.eigh((h + h.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    v, av = q @ u, aq @ u
    return values, v, av, np.linalg.norm(av - v * values, axis=0)


def _growth(value: float, low: float, high: float) -> float:
    """Factor a degree by which a Chebyshev filter on [low, high] raises an eigenvalue above it."""
    t = max(1.0, (2 * value - high - low) / (high - low))
    return t + np.sqrt(t * t - 1)


def fit(rows: DataFrame, width: int, components: int = COMPONENTS, guard: int = GUARD, seed: int = 0) -> Whitening | None:
    """Leading eigenpairs of the covariance of ``x`` over all rows, to rounding.

    A block of ``components`` + ``guard`` vectors is raised by a Chebyshev polynomial of the covariance, which damps the spectrum below the block;
    the three-term recurrence needs one pass over the centred rows a degree, each a sum of X'(X Q). QR and Rayleigh-Ritz follow, until the residual
    of every wanted pair certifies it. Only width x block numbers leave a pass. None without rows.
    """
    n, sums = _sums(rows, width) if width else (0, None)
    if not n:
        return None
    state = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0, 0.0)

    def apply(q: np.ndarray) -> np.ndarray:
        """The covariance times q; the trace comes along as a last row."""
        def part(batches):
            total = np.zeros((width + 1, q.shape[1]))
            for batch in batches:
                x = matrix(batch.column("x"), width)
                for at in range(0, len(x), ROWS):
                    c = state.centred(x[at:at + ROWS])
                    total[:width] += c.T @ (c @ q)
                    total[width, 0] += (c * c).sum()
            return total

        total = summed(rows.select("x"), width + 1, q.shape[1], part) / n
        state.passes += 1
        state.trace = float(total[width, 0])
        return total[:width]

    block = min(width, components + guard)
    wanted = min(width, components)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, block)))[0]
    values, v, av, residual = _rayleigh_ritz(q, apply(q))
    # the lowest Ritz value less its residual stands for the lower end of the spectrum; a cycle that fails moves it down
    low, last = max(0.0, values[-1] - residual[-1]), np.inf
    for _ in range(CYCLES):
        worst = float(residual[:wanted].max())
        if values[0] <= 0 or worst <= CERTAIN * values[0] or (worst <= 100 * CERTAIN * values[0] and worst > last / 2):
            break
        if worst > last / 2:
            low /= 2
        last = worst
        high = values[-1]
        low = min(low, high - 1e-6 * values[0])
        rise, least = _growth(values[0], low, high), _growth(values[wanted - 1], low, high)
        most = np.log(SPREAD) / np.log(rise / least) if rise > least * (1 + 1e-9) else DEGREE
        need = np.log(10 * worst / (CERTAIN * values[0])) / np.log(least) if least > 1 + 1e-9 else DEGREE
        degree = int(np.clip(min(most, np.ceil(need)), 2, DEGREE))
        middle, half = (high + low) / 2, (high - low) / 2
        before, now = v, (av - middle * v) / half
        for _ in range(degree - 1):
            before, now = now, (2 / half) * (apply(now) - middle * now) - before
        q = np.linalg.qr(now)[0]
        values, v, av, residual = _rayleigh_ritz(q, apply(q))
    real = values[:wanted] > FLAT * max(values[0], 0.0)
    state.vectors, state.values = v[:, :wanted][:, real], values[:wanted][real]
    state.residual = float((residual[:wanted][real] / max(values[0], 1e-300)).max()) if real.any() else 0.0
    return state


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum of (n*x - S)**2 of each row, exact; null where it passes 64 bits."""
    d = n * x - sums
    fits = (d.astype(np.float64) ** 2).sum(1) < 2.0**63 * (1 - 1e-9)
    return pa.array((d * d).sum(1), mask=~fits)


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE,
           shift: int = SHIFT) -> tuple[DataFrame, Whitening | None]:
    """(rows, fit): one row per vector and component with the whitened coordinate.

    Rows: the id, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation`` (sum over dimensions of (n*x - S)**2; null where it passes 64 bits), ``whitened``,
    ``explained`` (eigenvalue over trace) and ``identity_error`` (largest entry of the whitened covariance less the identity, measured over all rows).

    The fit and the result take all rows, repeated ones too, but those with a null vector or a null or non-finite component. Null ids are kept. Shorter
    vectors are filled up with zeros (c = 0), an empty one is all zeros. Components without variance are left out (their coordinate would be a division by
    zero), so a table without rows, with one row or with equal rows only gives no rows. Equal eigenvalues leave the choice of their vectors open, as does the sign. Entries beyond +-2**24 count as
    that. Other columns are left out, so their names don't matter.
    """
    rows, width = whole_numbers(vectors, vector, scale, LIMIT, shift, i=id)
    schema = T.StructType([T.StructField("i", rows.schema["i"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType())])
    got = fit(rows, width, components)
    if got is None or not len(got.values):
        out, explained, error = rows.sparkSession.createDataFrame([], schema), [], 0.0
    else:
        k = len(got.values)

        def part(batches):
            total = np.zeros((k + 1, k))
            for batch in batches:
                x = matrix(batch.column("x"), width)
                for at in range(0, len(x), ROWS):
                    z = got.project(x[at:at + ROWS])
                    total[:k] += z.T @ z
                    total[k] += z.sum(0)
            return total

        total = summed(rows.select("x"), k + 1, k, part) / got.n
        error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
        explained = (got.values / got.trace).tolist()

        def run(batches):
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    piece = batch.slice(at, ROWS)
                    x = matrix(piece.column("x"), width)
                    each = np.repeat(np.arange(len(x)), k)
                    yield pa.RecordBatch.from_arrays([
                        piece.column("i").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), got.n)),
                        _deviations(x, got.n, got.sums).take(pa.array(each)), pa.array(got.project(x).ravel())], schema.names)

        out = rows.mapInArrow(run, schema)
    shares = F.array(*[F.lit(x) for x in explained]) if explained else F.array().cast("array<double>")
    return out.select(F.col("i").alias(id), "component", "n", "deviation", "whitened", F.try_element_at(shares, F.col("component")).alias("explained"),
                      F.lit(error).alias("identity_error")), got
