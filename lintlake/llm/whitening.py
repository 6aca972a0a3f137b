"""Whitening of embeddings by spectral divide and conquer on polar decompositions.

Spark counts the distinct integer vectors and adds up their exact sums and products; a table of at
most (d + 1)(d + 2) / 2 numbers for d dimensions reaches the driver, whatever the number of rows.
There the covariance A is split: the orthogonal polar factor U of A - s I, by the QR- and
Cholesky-based dynamically weighted Halley iteration, is the matrix sign, so (I + U) / 2 projects on
the eigenvectors whose eigenvalues exceed the shift s. Bases of both ranges split A into two smaller
blocks, and so on until blocks are single components or multiples of the identity. Components go to
all tasks (d numbers each), which whiten rows in numpy batches.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm._store import keep, table

LARGEST = 2.0**62
EXACT = 1 << 53
EPS = np.finfo(np.float64).eps
ROWS = 4096  # multiplied at a time
LONG_MAX = (1 << 63) - 1


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without eigenvalue 0 (its matrix sign)."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    one = np.eye(n)
    low = EPS / 4  # taken for the least singular value of x; six or seven steps from here to 1
    for _ in range(12):
        root = np.cbrt(4 * (1 - low**2) / low**4)
        p = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + root)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))[0]
            step = both[:n] @ both[n:].T / np.sqrt(r)
        else:
            factor = np.linalg.cholesky(one + r * x.T @ x)
            step = np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        fresh = q / r * x + (p - q / r) * step
        fresh = (fresh + fresh.T) / 2
        moved = np.linalg.norm(fresh - x)
        x = fresh
        low = min(low * (p + q * low**2) / (1 + r * low**2), 1.0)
        if 1 - low < EPS * 10 and moved < EPS ** (1 / 3):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """(orthogonal basis, k): the first k columns span the eigenvectors above a shift, the others
    the rest. None for a multiple of the identity, up to rounding at `scale`."""
    n = len(a)
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n))
    if spread <= 4 * EPS * scale * n:
        return None
    radius = np.abs(a).sum(1) - np.abs(np.diag(a))  # Gershgorin's circles hold all eigenvalues
    low, high = (np.diag(a) - radius).min(), (np.diag(a) + radius).max()
    shift = float(np.median(np.diag(a)))
    start = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))[0]
    while high - low > EPS * scale:
        above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(above)))
        if 0 < k < n:
            basis = start
            for _ in range(3):
                basis = np.linalg.qr(above @ basis[:, :k], mode="complete")[0]
            off = basis[:, k:].T @ a @ basis[:, :k]
            if np.linalg.norm(off) <= 64 * EPS * scale * n:
                return basis, k
            shift += (high - low) * 2.0**-10  # too near to an eigenvalue
            high -= (high - low) * 2.0**-9
            continue
        # All eigenvalues lie on one side.
        low, high = (shift, high) if k == n else (low, shift)
        shift = (low + high) / 2
    return None


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of a symmetric matrix, by falling eigenvalue."""
    a = np.asarray(a, np.float64)
    n = len(a)
    scale = np.linalg.norm(a)
    done, waiting = [], [(np.eye(n), a)]
    while waiting:
        basis, block = waiting.pop()
        cut = _split(block, scale) if len(block) > 1 else None
        if cut is None:
            done.append(basis)
            continue
        own, k = cut
        for part in (own[:, :k], own[:, k:]):
            inner = part.T @ block @ part
            waiting.append((basis @ part, (inner + inner.T) / 2))
    vectors = np.linalg.qr(np.hstack(done))[0] if done else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(batches):
    """(i, j, s) with i <= j: sums of x_i x_j over the rows of a task, x_0 being 1."""
    total = None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            x = _rows(batch.column(0).slice(at, ROWS))
            x = np.hstack([np.ones((len(x), 1), np.int64), x])
            most = int(np.abs(x).max(initial=0))
            kind = np.float64 if most * most * len(x) < EXACT else object
            part = x.astype(kind).T @ x.astype(kind)
            part = (part.astype(np.int64) if kind is np.float64 else part).astype(object)
            total = part if total is None else total + part
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
            "s": pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0)),
        })


class Whitening:
    """What tasks need: n, the sums of the fit list, eigenvalues and the first components."""

    def __init__(self, sums: dict[tuple[int, int], int], keep_components: int) -> None:
        size = max((j for _, j in sums), default=-1) + 1
        self.n = sums.get((0, 0), 0)
        self.sums = np.array([sums[0, k] for k in range(1, size)], dtype=object)
        # n^2 times the covariance: whole numbers, exact whatever the mean.
        d = max(size - 1, 0)
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                whole = self.n * sums[i + 1, j + 1] - self.sums[i] * self.sums[j]
                cov[i, j] = cov[j, i] = whole / self.n**2
        values, vectors = components(cov)
        self.trace = float(np.trace(cov))
        k = min(keep_components, d)
        # Below this a component is rounding: the fit list does not vary along it.
        floor = max(d, 1) * EPS * max(float(values[0]) if d else 0.0, 0.0)
        self.varies = values[:k] > floor
        self.values = np.where(self.varies, values[:k], 0.0)
        self.vectors = vectors[:, :k]
        self.explained = self.values / self.trace if self.trace > 0 else np.zeros(k)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whitened components; NaN along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            # n x - S is exact before the one division.
            far = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
            whole = np.int64 if far < LONG_MAX else object
            centred = (x.astype(whole) * self.n - self.sums.astype(whole)).astype(np.float64) / self.n
            out = centred @ self.vectors / np.sqrt(self.values)
        out[:, ~self.varies] = np.nan
        return out

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n x - S)^2 of each row, exact; at most 2**63 - 1."""
        far = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if far * far * max(x.shape[1], 1) <= LONG_MAX:
            return ((x * self.n - self.sums.astype(np.int64)) ** 2).sum(1)
        whole = ((x.astype(object) * self.n - self.sums) ** 2).sum(1)
        return np.array([min(int(v), LONG_MAX) for v in whole], np.int64)


def _spread(model: Whitening):
    """(i, j, s): sums of products of whitened components over the rows of a task, 1 in front."""

    def run(batches):
        total = 0.0
        for batch in batches:
            w = model.whiten(_rows(batch.column(0)))[:, model.varies]
            w = np.hstack([np.ones((len(w), 1)), w])
            total = total + w.T @ w
        if np.ndim(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(total[i, j]),
            })

    return run


OUT = (
    "id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def _whitened(model: Whitening, error: float):
    k = len(model.values)

    def run(batches):
        for batch in batches:
            x = _rows(batch.column(1))
            w = model.whiten(x).ravel()
            m = len(x)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, model.n, np.int64)),
                "deviation": pa.array(np.repeat(model.deviation(x), k)),
                "whitened": pa.array(w, mask=np.isnan(w)),
                "explained": pa.array(np.tile(model.explained, m)),
                "identity_error": pa.array(np.full(m * k, error)),
            })

    return run


def whiten(vectors: DataFrame, k: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row and each of
    the first k components, numbered from 1 by falling variance.

    `vectors` has id (long) and x (array of long). The fit list is every distinct x once; n is its
    length, deviation the exact sum of (n x - S)^2 over dimensions (S: sums of the fit list; at most
    2**63 - 1), identity_error the largest entry of the whitened fit list's covariance minus the
    identity, measured in a pass of its own.

    Rows without vector take no part, and of vectors of different lengths only those of the most
    frequent length (the longer one of equally frequent ones). A null id stays null, repeated rows
    come out each. Along a component without variance, as of a fit list of one vector, whitened is null
    and explained 0. An empty table gives an empty one, and so do vectors without components. Other
    columns are ignored. Sums of products must fit in 38 digits.
    """
    rows = vectors.where("x is not null").select("id", "x")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    first = lengths.first()
    spark = vectors.sparkSession
    if first is None or first["d"] == 0:
        return spark.createDataFrame([], OUT)
    rows = rows.where(F.size("x") == first["d"])
    fit = keep(rows.select("x").distinct(), "fit-list")
    sums = fit.mapInArrow(_products, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(
        F.sum("s").alias("s")
    )
    model = Whitening({(r["i"], r["j"]): int(r["s"]) for r in sums.collect()}, k)
    spread = fit.mapInArrow(_spread(model), "i int, j int, s double").groupBy("i", "j").agg(
        F.sum("s").alias("s")
    )
    found = {(r["i"], r["j"]): r["s"] / model.n for r in spread.collect()}
    error = max((
        abs(s - found[0, i] * found[0, j] - (i == j)) for (i, j), s in found.items() if i > 0
    ), default=0.0)
    return rows.mapInArrow(_whitened(model, error), OUT)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vectors = rows.where(F.forall("embedding", finite)).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform("embedding", lambda x: F.floor(
            F.greatest(F.least(x.cast("double") * 256, F.lit(LARGEST)), F.lit(-LARGEST))
        ).cast("long")).alias("x"),
    )
    return whiten(vectors).withColumnRenamed("id", "vec_id")
