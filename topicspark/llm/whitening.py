"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so that sums, counts and deviations are exact. The vectors to fit on, each distinct one once, are
written to the shared folder; all that is done with their covariance V after that are passes of V Q for a thin block Q, in which each
task centres its rows, multiplies them by Q and then by their transpose, and sends a row of sums a dimension. A few Lanczos steps
bound the spectrum from below; each round then damps what lies under the block's least Ritz value by a Chebyshev polynomial of V
(one pass a degree), makes the block orthonormal by QR and takes its Ritz pairs, until the largest residual of the wanted ones is
TOLERANCE times the largest eigenvalue at most. What the driver holds is a block of dimensions x BLOCK numbers.

Edge cases: rows whose vector is null or empty, or holds a null or non-finite entry or one beyond MOST, take no part, and neither do
vectors of another size than the commonest (of equal ones the larger); rows that repeat an id or a vector are projected row by row,
also those without an id. Directions in which the fitted vectors don't vary (RANK of the largest eigenvalue or less) aren't
components, so one distinct vector, or none, gives no rows. A deviation beyond the range of a long is null. Of equal eigenvalues any
orthonormal vectors of their space are taken, the same for all rows. Other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import written

#: Components, vectors of a block, Lanczos steps, highest degree of a filter and ln of the largest ratio of what it does to two
#: wanted directions, rounds at most, residual of a component and eigenvalue of a direction in which nothing varies, both next to the
#: largest eigenvalue.
COMPONENTS, BLOCK, STEPS, DEGREE, SPREAD, ROUNDS, TOLERANCE, RANK, SEED = 16, 32, 8, 12, 18.0, 40, 2e-14, 1e-9, 7
#: Entry that is taken at most: 64 times it, and a million, is a whole number that a double holds.
MOST = 2.0**46
SCALE, SHIFT = 64, 1_000_000


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Whole numbers of a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def whole_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the usable rows, their entries as little-endian 64-bit whole numbers one after another."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int32)
            size = np.where(np.asarray(column.is_valid()), size, 0)
            entries = column.flatten()
            c = np.where(np.asarray(entries.is_valid(), bool), entries.fill_null(0.0).to_numpy(zero_copy_only=False), np.nan)
            fine = np.zeros(len(c) + 1, np.int64)
            np.cumsum(~(np.abs(c) <= MOST), out=fine[1:])
            end = np.cumsum(size)
            keep = np.flatnonzero((size > 0) & (fine[end] == fine[end - size]))
            with np.errstate(invalid="ignore"):
                x = (np.floor(SCALE * np.where(np.abs(c) <= MOST, c, 0)).astype("<i8") + SHIFT).astype("<i8")
            raw = [x[end[r] - size[r] : end[r]].tobytes() for r in keep]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), pa.array(raw, pa.binary())], ["vec_id", "x"])

    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, x binary")


class Fit:
    """The distinct vectors to fit on, their number `n` and sums `S` by dimension, and passes over them."""

    def __init__(self, rows: DataFrame):
        size = rows.groupBy(F.length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
        self.d = size["size"] // 8 if size else 0
        self.n, self.S, self.trace = 0, np.zeros(self.d, object), 0.0
        if not self.d:
            return
        self.rows = written(rows.filter(F.length("x") == 8 * self.d).select("x").distinct())
        d = self.d

        def sums(batches):
            n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
            for batch in batches:
                x = _matrix(batch.column("x"), d)
                n += len(x)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                high += (x >> 32).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(d), pa.int32()), "n": pa.array(np.full(d, n), pa.int64()), "low": pa.array(low), "high": pa.array(high)})

        for r in self.rows.mapInArrow(sums, "i int, n long, low long, high long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "low", "high")]).collect():
            self.n, self.S[r["i"]] = r["n"], (r["high"] << 32) + r["low"]
        self.trace = float(self.added(lambda y: np.column_stack([(y * y).sum(axis=0)]), d, 1).sum()) / self.n

    def added(self, make, height: int, width: int) -> np.ndarray:
        """Sum over all fitted rows of the matrix `make(y)`, y being a batch of centred rows: summed by row of the matrix."""
        d, centred = self.d, self.centred()

        def run(batches):
            total = np.zeros((height, width))
            for batch in batches:
                total += make(centred(_matrix(batch.column("x"), d)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height), pa.int32()), *[pa.array(total[:, j]) for j in range(width)]], ["i", *[f"y{j}" for j in range(width)]])

        schema = ", ".join(["i int", *[f"y{j} double" for j in range(width)]])
        out = np.zeros((height, width))
        for r in self.rows.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).collect():
            out[r["i"]] = r[1:]
        return out

    def centred(self):
        """x - S / n as doubles: (n x - S) / n where the product fits, so that the difference is exact."""
        n, whole, part = self.n, np.array([s // self.n for s in self.S], np.int64), np.array([float(s % self.n) for s in self.S])
        return lambda x: ((x - whole) * float(n) - part) / n

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        return self.added(lambda y: y.T @ (y @ q), self.d, q.shape[1]) / self.n


def least_eigenvalue(fit: Fit, steps: int = STEPS) -> float:
    """A number that is hardly above the least eigenvalue: the least Ritz value of a few Lanczos steps less its residual."""
    q = np.random.default_rng(SEED).standard_normal((fit.d, 1))
    basis, alpha, beta = [q[:, 0] / np.linalg.norm(q)], [], []
    for _ in range(min(steps, fit.d)):
        v = fit.times(basis[-1][:, None])[:, 0]
        alpha.append(basis[-1] @ v)
        for _ in range(2):
            v -= np.stack(basis, 1) @ (np.stack(basis) @ v)
        beta.append(np.linalg.norm(v))
        if beta[-1] <= 1e-14 * max(map(abs, alpha)):
            beta[-1] = 0.0
            break
        basis.append(v / beta[-1])
    value, vector = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, float(value[0] - beta[-1] * abs(vector[-1, 0])))


def eigenpairs(fit: Fit, wanted: int = COMPONENTS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, largest first, eigenvectors as columns, and the largest residual next to the largest eigenvalue."""
    p, k = min(block, fit.d), min(wanted, fit.d)
    low = least_eigenvalue(fit) if p < fit.d else 0.0
    q = np.linalg.qr(np.random.default_rng(SEED + 1).standard_normal((fit.d, p)))[0]
    best = None
    for _ in range(ROUNDS):
        vq = fit.times(q)
        value, w = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        value, w = value[::-1], w[:, ::-1]
        q, vq = q @ w, vq @ w
        top = max(value[0], 0.0)
        # directions without variance are no components, so their residual doesn't count
        off = np.linalg.norm(vq - q * value, axis=0)[:k][value[:k] > RANK * top]
        residual = float(off.max(initial=0.0) / top) if top else 0.0
        if best is None or residual < best[2]:
            best = (value[:k], q[:, :k], residual)
        if residual <= TOLERANCE or p == fit.d:
            break
        # damp [low, high] into [-1, 1]; a steep spectrum takes lower degrees, so that no wanted direction drowns in another
        high = max(value[-1], RANK * top)
        mid, half = (high + low) / 2, max((high - low) / 2, RANK * top)
        degree = int(np.clip(SPREAD / max(np.arccosh(max((top - mid) / half, 1.0)), 1e-9), 1, DEGREE))
        before, now = q, (vq - mid * q) / half
        for _ in range(degree - 1):
            before, now = now, 2 * (fit.times(now) - mid * now) / half - before
        q = np.linalg.qr(now)[0]
    return best


def op13_whitening(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual) of every usable row of `vectors` (vec_id,
    embedding): its place along each component, in units of the fitted vectors' deviation there."""
    rows = whole_rows(vectors)
    fit = Fit(rows)
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    if fit.n < 2:
        return rows.sparkSession.createDataFrame([], schema)
    value, q, residual = eigenpairs(fit, wanted)
    real = value > RANK * max(value[0], 0.0)
    value, q = value[real], q[:, real]
    k = len(value)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    axes = q / np.sqrt(value)
    moments = fit.added(lambda y: np.vstack([(w := y @ axes).T @ w, w.sum(axis=0)]), k + 1, k) / fit.n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    d, n, sums, centred, explained = fit.d, fit.n, fit.S, fit.centred(), value / fit.trace

    def deviations(x: np.ndarray) -> list:
        rough = (np.abs(x.astype(float) * n - sums.astype(float)) ** 2).sum(axis=1)
        if n * max(1.0, float(np.abs(x).max(initial=0))) < 2**62 and rough.max(initial=0.0) < 2**62:
            y = x * n - sums.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = [sum(v * v for v in (int(a) * n - int(s) for a, s in zip(row, sums, strict=True))) for row in x]
        return [v if v < 2**63 else None for v in exact]

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            rep = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(rep), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, n), pa.int64()), pa.array(deviations(x), pa.int64()).take(rep), pa.array((centred(x) @ axes).ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)), pa.array(np.full(len(x) * k, residual))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
            )

    return rows.filter(F.length("x") == 8 * d).mapInArrow(project, schema)
