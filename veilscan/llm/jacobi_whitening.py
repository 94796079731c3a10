"""Whitening of vectors on their leading principal components, found by a block Jacobi-Davidson method without a covariance matrix.

Entries become integers, whose sums per dimension are exact, so the mean is an exact fraction and every centred entry is correct to
one rounding. The only thing the eigensolver asks of the data is the centred product ``V B = 1/n sum (x - mean) ((x - mean)' B)``
for a narrow block B: one pass over the rows, added up per task and then by Spark, with nothing larger than dimensions times
block width on the driver.

Rounds: Rayleigh-Ritz in the search space gives pairs and residuals. Leading pairs whose residual is at the level of double
rounding are locked. For each other wanted pair (theta, u, residual r) the correction equation ``(I - P P')(V - theta)(I - P P') t = -r``,
P being the locked and the wanted vectors, is solved by some steps of MINRES, all pairs in step so that a step is one pass; the corrections
widen the search space, which restarts from its Ritz vectors when it is full.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped; so are vectors of another length
than most have (the longer one on a tie), as they are in no common space. ``64 c`` is held within +-2^52. Components whose
eigenvalue is not above 1e-12 of the largest do not exist (one row, equal rows and empty vectors have none, hence no result rows).
Eigenvectors have their largest entry positive; equal eigenvalues leave a choice of basis. ``deviation`` is null where it
exceeds a long. Null and repeated vec_ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, table_of

SCALE, SHIFT, LIMIT = 64, 1_000_000, float(1 << 52)
EPS = np.finfo(float).eps
CELLS = pa.schema([("at", pa.int64()), ("value", pa.float64())])
TOTALS = pa.schema([("at", pa.int64()), ("value", pa.decimal128(38, 0))])
WHITE = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
    ("explained", pa.float64()), ("identity_error", pa.float64()),
])
WHITE_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Key and integer entries of the vectors without null and non-finite entries."""
    value = F.transform(F.col(column), lambda c: c.cast("double"))
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform("v", lambda c: (F.floor(F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + SHIFT).cast("long"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), value.alias("v")).where("v IS NOT NULL").where(finite)
    return rows.select("vec_id", scaled.alias("x"))


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


@dataclass(frozen=True)
class Mean:
    """n, and per dimension the sum S as ``whole * n + part``."""

    n: int
    whole: np.ndarray
    part: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.part / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 per row."""
        gap = x - self.whole
        bound = (int(np.abs(gap).max(initial=0)) + 1) * self.n
        if len(self.whole) * bound * bound < 1 << 63:
            return ((gap * self.n - self.part) ** 2).sum(axis=1).tolist()
        exact = ((gap.astype(object) * self.n - self.part.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def mean_of(rows: DataFrame, d: int) -> Mean:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (d + 1)
        for batch in batches:
            x = _rows(batch, d)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            totals = [t + v for t, v in zip(totals, [*((h << 32) + v for h, v in zip(high, low, strict=True)), len(x)], strict=True)]
        yield table_of(TOTALS, range(d + 1), totals)

    sums = rows.select("x").mapInArrow(run, "at long, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()
    totals = [int(v) for _, v in sorted((r["at"], r["value"]) for r in sums)]
    n = totals[d]
    return Mean(n, np.array([t // n for t in totals[:d]], np.int64), np.array([t % n for t in totals[:d]], np.int64))


def added_up(rows: DataFrame, d: int, size: int, local: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``local`` (a flat array of ``size`` numbers per batch of rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, compensation = np.zeros(size), np.zeros(size)
        for batch in batches:
            term = local(_rows(batch, d)) - compensation
            after = total + term
            compensation, total = (after - total) - term, after
        yield table_of(CELLS, range(size), total)

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


class Covariance:
    """The covariance of the rows as an operator; counts its passes."""

    def __init__(self, rows: DataFrame, mean: Mean):
        self.rows, self.mean, self.passes, self.trace = rows, mean, 0, 0.0

    def __call__(self, block: np.ndarray) -> np.ndarray:
        d, k = block.shape
        mean = self.mean

        def local(x: np.ndarray) -> np.ndarray:
            c = mean.centred(x)
            return np.append((c.T @ (c @ block)).ravel(), (c * c).sum())

        sums = added_up(self.rows, d, d * k + 1, local) / mean.n
        self.passes += 1
        self.trace = sums[-1]
        return sums[:-1].reshape(d, k)


def _lengths(block: np.ndarray) -> np.ndarray:
    return np.sqrt((block * block).sum(axis=0))


def minres(operate: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """Columns x with ``operate(x)`` near ``b``, one Lanczos process per column, all in step."""
    start = _lengths(b)
    safe = lambda v: np.where(np.abs(v) > 1e-300, v, 1)
    x, eta, beta = np.zeros_like(b), start.copy(), np.zeros_like(start)
    v, v_old, w, w_old = b / safe(start), np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    cos, cos_old, sin, sin_old = np.ones_like(start), np.ones_like(start), np.zeros_like(start), np.zeros_like(start)
    for _ in range(steps):
        p = operate(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = _lengths(p)
        delta, second, third = cos * alpha - cos_old * sin * beta, sin * alpha + cos_old * cos * beta, sin_old * beta
        first = np.hypot(delta, beta_new)
        cos_old, cos, sin_old, sin = cos, delta / safe(first), sin, beta_new / safe(first)
        w_old, w = w, (v - third * w_old - second * w) / safe(first)
        x += cos * eta * w
        eta = -sin * eta
        v_old, v, beta = v, p / safe(beta_new), beta_new
        if (np.abs(eta) <= reduce * start).all():
            break
    return x


def widened(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``block`` adds to ``basis``."""
    block = block / np.maximum(_lengths(block), 1e-300)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    new = left[:, size > 1e-10]
    new = new - basis @ (basis.T @ new)
    return np.linalg.qr(new)[0] if new.shape[1] else new


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, inner: int = 4, rounds: int = 100, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and their unit eigenvectors, until every residual is at rounding level."""
    if d == 0 or k == 0:
        return np.zeros(0), np.zeros((d, 0))
    k, most = min(k, d), min(d, 4 * k + 16)
    random = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    basis = np.linalg.qr(random.standard_normal((d, min(d, k + 8))))[0]
    image, best, idle = apply(basis), np.inf, 0
    for _ in range(rounds):
        small = basis.T @ image
        theta, mix = np.linalg.eigh((small + small.T) / 2)
        theta, mix = theta[::-1], mix[:, ::-1]
        open_ = k - len(values)
        ritz = basis @ mix[:, :open_]
        residual = image @ mix[:, :open_] - ritz * theta[:open_]
        size, scale = _lengths(residual), max(abs(theta[0]), values.max(initial=0), 1e-300)
        complete = locked.shape[1] + basis.shape[1] >= d  # nothing left to search: what remains is rounding
        idle = 0 if size.max() < best / 2 else idle + 1
        best = min(best, size.max())
        done = complete or (idle >= 3 and size.max() <= 1e-12 * scale)
        n_done = open_ if done else int(np.argmin(np.append(size <= 32 * EPS * scale, False)))
        locked, values = np.hstack([locked, ritz[:, :n_done]]), np.append(values, theta[:n_done])
        if len(values) == k:
            break
        if n_done:
            basis, image = basis @ mix[:, n_done:], image @ mix[:, n_done:]
            mix, theta, best, idle = np.eye(basis.shape[1]), theta[n_done:], np.inf, 0
            ritz, residual = ritz[:, n_done:], residual[:, n_done:]
        wanted = np.hstack([locked, ritz])
        outside = lambda block: block - wanted @ (wanted.T @ block)
        shift = theta[: ritz.shape[1]]
        step = minres(lambda block, s=shift, out=outside: out(apply(out(block)) - s * out(block)), outside(-residual), inner, 0.05)
        new = widened(np.hstack([locked, basis]), step)
        if new.shape[1] == 0:
            new = widened(np.hstack([locked, basis]), random.standard_normal((d, k)))
        if basis.shape[1] + new.shape[1] > most - locked.shape[1] and most < d:
            keep = min(basis.shape[1], ritz.shape[1] + 8)
            basis, image = basis @ mix[:, :keep], image @ mix[:, :keep]
            new = widened(np.hstack([locked, basis]), new)
        basis, image = np.hstack([basis, new]), np.hstack([image, apply(new)])
    else:
        raise ArithmeticError(f"largest residual {best} after {rounds} rounds")
    order = np.argsort(-values, kind="stable")
    vectors = locked[:, order]
    return values[order], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])


def whitened(vectors: DataFrame, most: int = 32, inner: int = 4) -> DataFrame:
    """One row per remaining vector and component: whitened value, and what it is measured by."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(integers(vectors), "integers")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if not lengths or lengths[0]["d"] == 0:
        return spark.createDataFrame([], WHITE_DDL)
    d = lengths[0]["d"]
    if len(lengths) > 1:
        rows = rows.where(F.size("x") == d)
    mean = mean_of(rows, d)
    covariance = Covariance(rows, mean)
    values, axes = jacobi_davidson(covariance, d, min(most, d), inner)
    real = values > 1e-12 * max(values[0], 0)
    values, axes = values[real], axes[:, real]
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], WHITE_DDL)
    turn = axes / np.sqrt(values)
    middle = added_up(rows, d, k, lambda x: (mean.centred(x) @ turn).sum(axis=0)) / mean.n

    def outer(x: np.ndarray) -> np.ndarray:
        w = mean.centred(x) @ turn - middle
        return (w.T @ w).ravel()

    error = float(np.abs(added_up(rows, d, k * k, outer).reshape(k, k) / mean.n - np.eye(k)).max())
    explained = values / covariance.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, d)
            m = len(x)
            if not m:
                continue
            each = pa.array(np.repeat(np.arange(m), k))
            yield table_of(
                WHITE, batch.column("vec_id").take(each), np.tile(np.arange(1, k + 1), m), np.full(m * k, mean.n),
                pa.array(mean.deviation(x), pa.int64()).take(each), (mean.centred(x) @ turn).ravel(), np.tile(explained, m), np.full(m * k, error),
            )

    return rows.mapInArrow(run, WHITE_DDL)
