"""What the vector operators share: rows that take part, whole-number components, products without rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import LAST

#: components are counted in steps of 1 / SCALE
SCALE = 256
#: below this every whole number is a double
EXACT = 1 << 53


def usable(rows: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """key (the id, null last), further columns named, and vec (doubles) of the rows whose vector is whole and finite.

    Vectors are as long as most are (the longer of two lengths that are equally frequent); others, and empty ones, take no part.
    """
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    found = rows.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("key"), *[F.col(f"`{c}`").alias(n) for c, n in zip(more[::2], more[1::2])], vec.alias("vec"))
    found = found.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)))
    lengths = found.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found.filter(F.size("vec") == lengths[0]["d"]) if lengths else found.limit(0)


def matrix(column: pa.Array | pa.ChunkedArray, kind: str = "float64") -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def whole(vec: np.ndarray) -> np.ndarray:
    """floor(SCALE * component); beyond the range of long its ends."""
    with np.errstate(over="ignore"):
        x = np.floor(vec * SCALE)
    big = np.abs(x) >= 2.0 ** 63
    out = np.where(big, 0, x).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.where(big, np.where(x > 0, ends.max, ends.min), out) if big.any() else out


def clipped(x: np.ndarray) -> np.ndarray:
    """Python whole numbers as long, beyond its range the ends."""
    ends = np.iinfo(np.int64)
    return np.array([min(max(int(v), ends.min), ends.max) for v in x.ravel()], np.int64).reshape(x.shape)


def largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact (beyond long its ends)."""
    bound = largest(a) * largest(b) * max(1, a.shape[1])
    if bound < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if bound < 1 << 63 else clipped(a.astype(object) @ b.T.astype(object))


def row_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with the same row of b, exact (beyond long its ends)."""
    if largest(a) * largest(b) * max(1, a.shape[1]) < 1 << 63:
        return np.einsum("ij,ij->i", a, b)
    return clipped((a.astype(object) * b.astype(object)).sum(axis=1))
