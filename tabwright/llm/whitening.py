"""Whitening of embeddings by QDWH spectral divide and conquer.

The fit list is each distinct whole-number vector once; it is written to the shared folder and read for count and sums, for the
covariance and for the check of the result. The covariance is summed in tasks from rows centred by a whole-number vector near the
mean, so the sums are exact as long as they stay below 2^53, and centred to the mean itself at the end.

The covariance is as large as the dimension squared, so its eigenvectors are found in the driver: the polar factor of the matrix less a
shift (QDWH: dynamically weighted Halley steps by QR) is +1 on the invariant subspace above the shift and -1 below; (I + U) / 2
projects on the upper one. Both subspaces are split again until one component is left in each or nothing is left to split. The components
are broadcast, and each row is projected on them where it lies.

Defined cases: null or empty vectors and ones with null or non-finite entries are dropped, as are those of another length than most have;
entries beyond long are held at its ends; fewer dimensions than components give as many components as there are dimensions; a
component without variance (to rounding) has whitened null, explained 0 and no part in identity_error, which is null if there is none
other; a deviation beyond long is null and whole in deviation_exact while it has 38 digits; a null id stays null; repeated rows stay,
but count once in the fit; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import shared_table_path
from .tables import named_id
from .vectors import largest, matrix, usable, whole

COMPONENTS = 4
#: rows that are multiplied at once
BLOCK = 4096
#: eigenvalues below this share of the largest are rounding
NOTHING = 1e-13
EPS = float(np.finfo(np.float64).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by QDWH; singular directions to rounding may come out between -1 and 1."""
    d = len(a)
    scale = np.linalg.norm(a)
    x = a / scale
    eye = np.eye(d)
    try:  # a lower bound of the smallest singular value
        low = max(EPS, 1 / float(np.linalg.norm(np.linalg.inv(x))))
    except np.linalg.LinAlgError:
        low = EPS
    for _ in range(40):
        low = min(low, 1.0)
        u = low * low
        inner = (4 * (1 - u) / (u * u)) ** (1 / 3)
        ha = np.sqrt(1 + inner) + 0.5 * np.sqrt(8 - 4 * inner + 8 * (2 - u) / (u * np.sqrt(1 + inner)))
        hb = (ha - 1) ** 2 / 4
        hc = ha + hb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(hc) * x, eye]))
        step = (hb / hc) * x + ((ha - hb / hc) / np.sqrt(hc)) * q[:d] @ q[d:].T
        step = (step + step.T) / 2
        low = low * (ha + hb * u) / (1 + hc * u)
        moved = np.linalg.norm(step - x)
        x = step
        if moved < 1e-13 * np.sqrt(d) or (abs(1 - low) < EPS * 10 and moved < 1e-9):
            break
    return x


def subspaces(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below the shift."""
    d = len(a)
    projector = (polar(a - shift * np.eye(d)) + np.eye(d)) / 2
    rank = min(d, max(0, round(float(np.trace(projector)))))
    left, best = projector.copy(), np.zeros((d, rank))
    for k in range(rank):  # the column that sticks out most, without what is there already
        v = left[:, np.argmax(np.einsum("ij,ij->j", left, left))]
        best[:, k] = v / max(np.linalg.norm(v), EPS)
        left = left - np.outer(best[:, k], best[:, k] @ left)
    if rank:
        best, _ = np.linalg.qr(projector @ best)
    full, _ = np.linalg.qr(np.column_stack([best, np.eye(d)]))
    return best, full[:, best.shape[1]:d]


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    values, vectors = [], []
    scale = max(float(np.abs(a).max(initial=0.0)), np.finfo(float).tiny)
    todo = [((a + a.T) / 2, np.eye(len(a)))]
    while todo:
        b, basis = todo.pop()
        d = len(b)
        off = b - np.diag(np.diag(b))
        if d == 1 or np.abs(off).max() <= EPS * scale:
            values += list(np.diag(b))
            vectors += list(basis.T)
            continue
        radius = np.abs(off).sum(axis=1)
        ends = float((np.diag(b) - radius).min()), float((np.diag(b) + radius).max())
        for k in range(60):  # a shift that leaves something on both sides
            shift = (float(np.median(np.diag(b))), float(np.trace(b)) / d)[k] if k < 2 else (ends[0] + ends[1]) / 2
            upper, lower = subspaces(b, shift)
            if upper.shape[1] and lower.shape[1]:
                break
            ends = (max(ends[0], shift), ends[1]) if upper.shape[1] else (ends[0], min(ends[1], shift))
        else:  # one eigenvalue to rounding
            values += list(np.diag(b))
            vectors += list(basis.T)
            continue
        todo += [(part.T @ b @ part, basis @ part) for part in (lower, upper)]
        todo[-2:] = [((x + x.T) / 2, y) for x, y in todo[-2:]]
    order = np.argsort(-np.array(values), kind="stable")
    v = np.array(vectors)[order].T
    for _ in range(2):  # what the products of bases have lost: first-order refinement of all components at once
        r, t = np.eye(len(v)) - v.T @ v, v.T @ a @ v
        values = np.diag(t) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 1e-7 * scale
        v = v + v @ np.where(near, r / 2, (t + values[None, :] * r) / np.where(near, 1, gap))
    order = np.argsort(-values, kind="stable")
    v = v[:, order] / np.linalg.norm(v[:, order], axis=0)
    sign = np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])
    return values[order], v * np.where(sign == 0, 1, sign)


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = whole(matrix(batch.column("vec")))
        off = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1] if len(x) else np.zeros(1, np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))], ["x"])


def _gram(centre: np.ndarray):
    """Sums of products of centred rows of a task, by row of the matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(centre), len(centre))), False
        for batch in batches:
            x = matrix(batch.column("x"), "int64")
            for i in range(0, len(x), BLOCK):
                y = x[i:i + BLOCK].astype(np.float64) - centre
                total += y.T @ y
                seen = True
        if seen:
            i, j = np.divmod(np.arange(total.size), len(centre))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])
    return run


def _second_moments(fit: DataFrame, job, d: int) -> np.ndarray:
    """The d x d sums over all tasks: each sends one row for each entry, which Spark adds up."""
    got = fit.mapInArrow(job, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((d, d))
    out[got["i"], got["j"]] = got["value"]
    return out


class Whitener:
    """Count, sums and components of a fit list; small enough to go to every task."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, components: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.trace = n, sums, values, trace
        self.components = components
        self.there = (values > NOTHING * max(trace, 0)) & (values > 0)
        self.mean = np.array([s / n for s in sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; without variance not a number."""
        return ((x.astype(np.float64) - self.mean) @ self.components) / np.sqrt(np.where(self.there, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n * x - S)^2 over the dimensions, exact."""
        most = self.n * largest(x) + max(abs(s) for s in self.sums)
        y = x * np.int64(self.n) - np.array(self.sums, np.int64) if most < 1 << 62 else x.astype(object) * self.n - np.array(self.sums, object)
        if most * most * x.shape[1] < 1 << 62:
            return np.einsum("ij,ij->i", y, y).tolist()
        y = y.astype(object)
        return (y * y).sum(axis=1).tolist()

    def rows(self, error: float | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(self.values)
            for batch in batches:
                x = whole(matrix(batch.column("vec")))
                if not len(x):
                    continue
                white, far = self.whiten(x), self.deviations(x)
                long = [v if v < 1 << 63 else None for v in far]
                exact = [Decimal(v) if v < 10 ** 38 else None for v in far]
                again = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(again), self.n)),
                    pa.array(long, pa.int64()).take(pa.array(again)), pa.array(exact, pa.decimal128(38, 0)).take(pa.array(again)),
                    pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(np.where(self.there, self.values / self.trace if self.trace else 0.0, 0.0), len(x))), pa.array([error] * len(again), pa.float64())],
                    ["key", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"])
        return run


OUT = "key long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct whole-number vector once, as a written table: copies meet in partial aggregates, so a frequent one is no hot key."""
    path = shared_table_path(rows.sparkSession, "vectors")
    rows.select("vec").mapInArrow(_wholes, "x array<long>").groupBy("x").agg(F.lit(1).alias("one")).select("x").write.parquet(path)
    return rows.sparkSession.read.schema("x array<long>").parquet(path)


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> tuple[Whitener | None, float | None]:
    """The whitener of a fit list, and the largest entry by which the whitened list's covariance differs from the identity."""
    d = (fit.agg(F.max(F.size("x"))).first()[0]) or 0
    if not d:
        return None, None
    first = fit.agg(F.count("*"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(d)]).first()
    n, sums = first[0], [int(s) for s in first[1:]]
    centre = np.array([float(round(s / n)) for s in sums])
    off = np.array([float(s - n * int(c)) / n for s, c in zip(sums, centre)])  # what the mean is off the centre
    v = _second_moments(fit, _gram(centre), d) / n - np.outer(off, off)
    values, vectors = spectral(v)
    k = min(components, d)
    found = Whitener(n, sums, values[:k], vectors[:, :k], float(np.trace(v)))
    if not found.there.any():
        return found, None

    def white_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = (pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))], ["x"])
                 for b in batches if b.num_rows for w in [np.nan_to_num(found.whiten(matrix(b.column("x"), "int64")))])
        total, seen = np.zeros((k, k)), False
        for b in again:
            w = matrix(b.column("x"))
            total, seen = total + w.T @ w, True
        if seen:
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])
    cov = _second_moments(fit, white_gram, k) / n
    at = np.flatnonzero(found.there)
    return found, float(np.abs(cov[np.ix_(at, at)] - np.eye(len(at))).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: the id, component, n, deviation, deviation_exact, whitened, explained, identity_error."""
    rows = usable(vectors, id_col, vector_col)
    found, error = fit_whitener(fit_list(rows), components)
    out = rows.mapInArrow(found.rows(error), OUT) if found else vectors.sparkSession.createDataFrame([], OUT)
    return out.select(named_id().alias(id_col), *[c for c in out.columns if c != "key"])


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
