"""Whitening of embeddings by their leading components: Chebyshev-filtered subspace iteration over distributed passes.

A pass sends a narrow block Q to the tasks, each of which adds up its rows' share of the centred product X'(XQ); Spark sums the
shares, so the driver holds nothing but blocks of (dimensions x some 32) numbers, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import lean, stored

#: The integer grid of the entries, and components that are returned.
GRID, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries stop here, so that sums and n times an entry stay exact.
LARGEST = 1 << 30
#: Columns of the block besides the components, degree of the filter, steps of the bound on the spectrum, most rounds of the iteration.
GUARD, DEGREE, BOUND_STEPS, ROUNDS = 24, 10, 8, 60
#: Residual of a component against the largest eigenvalue that ends the iteration; where rounding forbids it, a residual that no longer falls and is below the second value.
TIGHT, LOOSE = 2e-15, 1e-11
#: An eigenvalue below this share of the trace is rounding, and its component can't be whitened.
FLAT = 1e-13


def grid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x: the entries floor(1024 * c) + 100000 of the vectors that take part.

    Null and empty vectors and those with a null or non-finite entry go; so do vectors of another length than the most frequent
    one (of equally frequent ones the longer). Null and repeated vec_ids stay.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    bound = float(LARGEST)
    entry = F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.lit(float(GRID)) * c.cast("double")))) + F.lit(SHIFT))
    out = stored(rows.select("vec_id", entry.cast("array<int>").alias("x")), "vectors")
    length = out.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return out.where(F.size("x") == (length.length if length else 0))


def _block(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def gathered(vectors: DataFrame, work: Callable[[np.ndarray], np.ndarray], rows: int, columns: int, whole: bool = False) -> np.ndarray:
    """The sum of ``work(x)`` (rows x columns; integers if ``whole``) over all blocks x of vectors: one share a task, summed by Spark."""
    kind = np.int64 if whole else np.float64
    names = [f"c{j}" for j in range(columns)]

    def share(batches):
        total = np.zeros((rows, columns), kind)
        some = False
        for batch in batches:
            if batch.num_rows:
                total += work(_block(batch))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *(pa.array(total[:, j].copy()) for j in range(columns))], names=["row", *names])

    schema = "row int, " + ", ".join(f"{c} {'long' if whole else 'double'}" for c in names)
    out = np.zeros((rows, columns), kind)
    for r in vectors.select("x").mapInArrow(lean(share), schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["row"]] = [r[c] for c in names]
    return out


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray  # falling
    vectors: np.ndarray  # unit columns
    residual: float  # largest of the components' residuals against the largest eigenvalue
    passes: int

    @property
    def scale(self) -> np.ndarray:
        """1 over the root of each eigenvalue; nan for a flat one."""
        return np.where(self.values > FLAT * self.trace, 1 / np.sqrt(np.maximum(self.values, 1e-300)), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors * self.scale


def fit(vectors: DataFrame, components: int = COMPONENTS, seed: int = 7) -> Whitening | None:
    """The leading components of the vectors' covariance (divisor n); None for no vectors.

    A short Lanczos run bounds the spectrum from below. Each round filters the block by a Chebyshev polynomial, small between that
    bound and the least Ritz value of the block, makes it orthonormal by QR, and takes Rayleigh-Ritz pairs. It ends when the residuals of all
    components are certified and a fresh random block, filtered in their complement, shows no larger eigenvalue that was missed.
    """
    first = vectors.first()
    if first is None:
        return None
    d = len(first["x"])
    moments = gathered(vectors, lambda x: np.stack([np.full(d, len(x)), x.sum(0)], 1), d, 2, whole=True)
    n, sums = int(moments[0, 0]), moments[:, 1]
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), 0.0, 1)
    random = np.random.default_rng(seed)

    def product(q: np.ndarray) -> np.ndarray:
        """V Q by one distributed pass."""

        def work(x):
            c = (x * n - sums) / n
            return c.T @ (c @ q)

        model.passes += 1
        return gathered(vectors, work, d, q.shape[1]) / n

    def work(x):
        return (((x * n - sums) / n) ** 2).sum(0)[:, None]

    model.trace = float(gathered(vectors, work, d, 1).sum()) / n
    k = min(d, components + GUARD)
    components = min(d, components)
    if model.trace == 0:  # all vectors are equal: any directions are components
        model.values, model.vectors = np.zeros(components), np.eye(d)[:, :components]
        return model

    low = _lower_bound(product, random.standard_normal(d), min(d, BOUND_STEPS))
    q = np.linalg.qr(random.standard_normal((d, k)))[0]
    last, best = np.inf, None
    for _ in range(ROUNDS):
        q, w, theta = _ritz(q, product)
        top = q[:, :components]
        residual = float(np.linalg.norm(w[:, :components] - top * theta[:components], axis=0).max() / theta[0])
        if best is None or residual < best[0]:
            best = residual, theta[:components].copy(), top.copy()
        if k == d or residual <= TIGHT or best[0] <= LOOSE and residual > last / 2:
            if k == d or not _missed(best[1], best[2], product, random, low, theta[-1]):
                break
            q[:, components:] = random.standard_normal((d, k - components))
            q, best, last = np.linalg.qr(q)[0], None, np.inf
            continue
        last = residual
        q = np.linalg.qr(_filtered(q, w, product, low, max(theta[-1], low + 1e-9 * theta[0])))[0]
    else:
        raise RuntimeError(f"no certificate after {ROUNDS} rounds: residual {best[0] if best else last}")
    model.residual, model.values, model.vectors = best
    return model


def _ritz(q: np.ndarray, product) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz vectors, their products and values, falling."""
    w = product(q)
    h = q.T @ w
    theta, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return q @ turn, w @ turn, np.maximum(theta[::-1], 0)


def _filtered(q: np.ndarray, w: np.ndarray, product, low: float, high: float, degree: int = DEGREE) -> np.ndarray:
    """T(V) q for the Chebyshev polynomial T that stays within 1 between low and high; w is V q. Scaled in each step."""
    centre, half = (high + low) / 2, (high - low) / 2
    before, now = q, (w - centre * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (product(now) - centre * now) / half - before
        size = np.linalg.norm(now, axis=0).max()
        before, now = before / size, now / size
    return now


def _lower_bound(product, start: np.ndarray, steps: int) -> float:
    """A bound below the spectrum: the least Ritz value of a Lanczos run less its residual."""
    basis = [start / np.linalg.norm(start)]
    alpha, beta = [], []
    for _ in range(steps):
        v = product(basis[-1][:, None])[:, 0]
        alpha.append(float(v @ basis[-1]))
        for _ in range(2):
            for b in basis:
                v = v - (v @ b) * b
        beta.append(float(np.linalg.norm(v)))
        if beta[-1] <= 1e-13 * max(alpha):
            break
        basis.append(v / beta[-1])
    m = len(alpha)
    t = np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1)
    values, turn = np.linalg.eigh(t)
    return max(0.0, float(values[0] - abs(beta[m - 1] * turn[-1, 0])))


def _missed(theta: np.ndarray, top: np.ndarray, product, random, low: float, high: float) -> bool:
    """Whether a fresh block, filtered in the complement of the components, has a Ritz value above the least of theirs."""
    d, k = top.shape
    width = min(k, d - k)
    if not width:
        return False
    away = lambda q: q - top @ (top.T @ q)
    inside = lambda q: away(product(away(q)))
    q = np.linalg.qr(away(random.standard_normal((d, width))))[0]
    q = np.linalg.qr(away(_filtered(q, inside(q), inside, low, max(high, low + 1e-9 * theta[0]))))[0]
    h = q.T @ inside(q)
    return float(np.linalg.eigvalsh((h + h.T) / 2)[-1]) > theta[-1] * (1 + 1e-9)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance (divisor n, centred first) minus the identity; None if no component can be whitened."""
    good = np.flatnonzero(~np.isnan(model.scale))
    if not len(good):
        return None
    mean = gathered(vectors, lambda x: model.whitened(x)[:, good].sum(0)[:, None], len(good), 1)[:, 0] / model.n

    def work(x):
        w = model.whitened(x)[:, good] - mean
        return w.T @ w

    return float(np.abs(gathered(vectors, work, len(good), len(good)) / model.n - np.eye(len(good))).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and each component.

    Fewer dimensions than ``components`` give as many components as dimensions. Components without variance (all vectors equal, fewer
    different vectors than components) are returned with a null ``whitened``; equal eigenvalues get any basis of their space. ``deviation`` is
    exact as decimal(38, 0): beyond some three million vectors it needs more than 64 bits. Other columns are ignored; no vectors give no rows.
    """
    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = grid_vectors(embeddings)
    model = fit(vectors, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], kinds)
    error = identity_error(vectors, model)
    k = len(model.values)
    explained = model.values / model.trace if model.trace else np.zeros(k)

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x, m = _block(part), part.num_rows
                w = model.whitened(x)
                ids = part.column(part.schema.names.index("vec_id")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        _deviation(x * model.n - model.sums).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                        pa.array(np.tile(explained, m)),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select("vec_id", "x").mapInArrow(lean(rows), kinds)


def _deviation(d: np.ndarray) -> pa.Array:
    """Sums of squares of integers, exact."""
    largest = int(np.abs(d).max(initial=0))
    if largest * largest * d.shape[1] < 1 << 63:
        return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
    wide = d.astype(object)
    return pa.array([Decimal(int(v)) for v in (wide * wide).sum(1)], pa.decimal128(38, 0))
