"""Whitening of embeddings by spectral divide and conquer.

Vectors become integers, so sums and means are exact. The distinct vectors give one
covariance, summed by Spark from blocks that are centred first. The driver, which
holds matrices of dimension x dimension only, takes its spectrum apart: the polar factor
of the covariance less a shift (QDWH iterations) is the matrix sign, half of it plus half of the
identity projects on the eigenvectors above the shift, and an orthonormal basis of that
space and one of its complement split the matrix in two, until single components are left.
The components then go to every task, which whitens its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.session import written

EPS = float(np.finfo(np.float64).eps)
#: Entries beyond this size count as non-finite: 64 times an entry must fit a long.
LARGEST = float(2**40)
STEP, OFFSET = 64, 1_000_000
#: Rows of one block of a partial sum: so many longs below 2^47 add up in 64 bits.
BLOCK = 1 << 15


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH; the matrix sign, as it is symmetric."""
    n = len(a)
    eye = np.eye(n)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low if np.isfinite(low) else 0.0, EPS / n))
    for _ in range(40):
        t = np.cbrt(4 * (1 - low**2) / low**4)
        f = np.sqrt(1 + t) + 0.5 * np.sqrt(max(0.0, 8 - 4 * t + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + t))))
        b = (f - 1) ** 2 / 4
        c = f + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
            new = b / c * x + (f - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            new = b / c * x + (f - b / c) * np.linalg.solve(eye + c * (x @ x.T), x)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (f + b * low**2) / (1 + c * low**2))
        if moved < (4 * EPS) ** (1 / 3) and 1 - low < 10 * EPS:
            return x
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Points between the smallest and the largest eigenvalue: a median for balance, the mean, which always splits, and points off it."""
    diagonal = np.diag(a)
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(len(a))) / np.sqrt(len(a))
    yield float(np.median(diagonal))
    yield float(mean)
    for part in (0.11, -0.13, 0.29, -0.31, 0.53, -0.57, 0.9, -0.9):
        yield float(mean + part * spread)


def eigen(a: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n = len(a)
    a = (a + a.T) / 2
    scale = np.linalg.norm(a)
    rng = np.random.default_rng(seed)
    values, vectors, todo = [], [], [(a, np.eye(n))]
    while todo:
        part, basis = todo.pop()
        m = len(part)
        if m == 1 or np.linalg.norm(part - np.trace(part) / m * np.eye(m)) <= 4 * m * EPS * scale:
            values.extend(np.diag(part))
            vectors.append(basis)
            continue
        best = None
        for shift in _shifts(part):
            projector = (polar(part - shift * np.eye(m)) + np.eye(m)) / 2
            k = round(float(np.trace(projector)))
            if not 0 < k < m:
                continue
            q, _ = np.linalg.qr(projector @ rng.standard_normal((m, k)))
            q, _ = np.linalg.qr(projector @ q, mode="complete")
            turned = q.T @ part @ q
            error = np.linalg.norm(turned[k:, :k])
            if best is None or error < best[0]:
                best = error, k, q, turned
            if error <= 16 * m * EPS * scale:
                break
        if best is None or best[0] > 1e-10 * scale:
            raise ArithmeticError("no shift splits the spectrum")
        _, k, q, turned = best
        for lo, hi in ((0, k), (k, m)):
            block = turned[lo:hi, lo:hi]
            todo.append(((block + block.T) / 2, basis @ q[:, lo:hi]))
    x = np.hstack(vectors)
    x, _ = np.linalg.qr(x)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


@dataclass(frozen=True)
class Model:
    """Components of the vectors of one length."""

    n: int
    sums: tuple[int, ...]
    centre: np.ndarray  #: whole numbers next to the means
    rest: np.ndarray  #: means less ``centre``
    axes: np.ndarray  #: components over the roots of their eigenvalues, as columns
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2, exact; Python's whole numbers where 64 bits could overflow."""
        near = x - self.centre
        off = [s - self.n * int(c) for s, c in zip(self.sums, self.centre)]
        bound = self.n * int(np.abs(near).max(initial=0)) + max(map(abs, off))
        if bound * bound * len(off) < 2**63:
            u = near * self.n - np.array(off, np.int64)
        else:
            u = near.astype(object) * self.n - np.array(off, object)
        return (u * u).sum(1).tolist()


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x (array of longs) of the rows of ``vectors`` (vec_id, embedding) that can be used."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    whole = F.transform("v", lambda c: F.floor(c * STEP) + F.lit(OFFSET).cast("long"))
    return plain.where(F.col("v").isNotNull() & F.coalesce(usable, F.lit(False))).select("vec_id", F.size("v").alias("dim"), whole.alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, row numbers, x as a matrix) of the rows of each length in a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        flat = batch.column("x").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield int(dim), rows, flat.reshape(len(rows), dim)


def _gram(distinct: DataFrame, models: dict[int, Model], whiten: bool) -> dict[int, np.ndarray]:
    """Covariance of the centred or whitened vectors of each length, summed by Spark."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch):
                y = models[dim].whitened(x) if whiten else models[dim].centred(x)
                sums[dim] = sums.get(dim, 0) + y.T @ y
        for dim, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(i), dim, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": s[i, j]})

    rows = distinct.select("dim", "x").mapInArrow(partial, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in rows.collect():
        size = models[r.dim].axes.shape[1] if whiten else r.dim
        s = out.setdefault(r.dim, np.zeros((size, size)))
        s[r.i, r.j] = s[r.j, r.i] = r.v / models[r.dim].n
    return out


def fit(rows: DataFrame, components: int = 16) -> dict[int, Model]:
    """A model for each length among ``rows`` (of :func:`quantised`), fitted on each distinct vector once.

    Components whose eigenvalue is zero up to rounding are left out: they cannot be scaled to one.
    The driver and each task hold a matrix of length x length for each length.
    """
    with written(rows.select("dim", "x").distinct()) as distinct:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, at, x in _matrices(batch):
                    for lo in range(0, len(at), BLOCK):
                        s = x[lo : lo + BLOCK].sum(0)
                        yield pa.RecordBatch.from_pydict({
                            "dim": np.full(dim, dim, np.int32), "i": np.arange(dim, dtype=np.int32), "s": s,
                            "n": np.full(dim, len(x[lo : lo + BLOCK]), np.int64),
                        })

        total = distinct.mapInArrow(add, "dim int, i int, s long, n long").groupBy("dim", "i").agg(
            F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")
        )
        sums: dict[int, dict[int, int]] = {}
        count: dict[int, int] = {}
        for r in total.collect():
            sums.setdefault(r.dim, {})[r.i] = int(r.s)
            count[r.dim] = r.n
        models = {}
        for dim, of in sums.items():
            n, s = count[dim], tuple(of[i] for i in range(dim))
            centre = [round(Fraction(v, n)) for v in s]
            rest = np.array([float(Fraction(v, n) - c) for v, c in zip(s, centre)])
            models[dim] = Model(n, s, np.array(centre, np.int64), rest, np.empty((dim, 0)), np.empty(0))
        for dim, cov in _gram(distinct, models, False).items():
            if not cov.any():
                continue
            values, axes = eigen(cov)
            keep = min(components, int((values > dim * EPS * values[0]).sum()))
            m = models[dim]
            models[dim] = Model(m.n, m.sums, m.centre, m.rest, axes[:, :keep] / np.sqrt(values[:keep]), values[:keep] / np.trace(cov))
        for dim, cov in _gram(distinct, models, True).items():
            m, error = models[dim], float(np.abs(cov - np.eye(len(cov))).max(initial=0))
            models[dim] = Model(m.n, m.sums, m.centre, m.rest, m.axes, m.explained, error)
    return models


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of ``vectors`` (vec_id, embedding).

    Rows whose vector is null or empty or holds null or non-finite entries are dropped, as are those with an entry
    beyond 2^40 in size. Repeated rows and null ids stay; extra columns are ignored. Vectors of
    different lengths are fitted apart. Components without variance give no rows, so neither do a single
    distinct vector nor an empty table. A deviation beyond 64 bits ends the job with an error.
    """
    rows = quantised(vectors)
    models = fit(rows, components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _matrices(batch):
                m = models[dim]
                k = m.axes.shape[1]
                if not k:
                    continue
                size = len(at) * k
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)),
                    "n": np.full(size, m.n, np.int64),
                    "deviation": pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    "whitened": m.whitened(x).ravel(),
                    "explained": np.tile(m.explained, len(at)),
                    "identity_error": np.full(size, m.identity_error),
                })

    return rows.mapInArrow(
        apply, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
