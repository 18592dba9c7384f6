"""Exact k-nearest-neighbour join.

Right rows are dealt to leaves. With complete coordinates a leaf is the cell of its nearest pivot (a row of
a hash sample), and the triangle inequality with the leaf's range of distances to the pivot, and with the
plane between two pivots, bounds how near any of its rows can be. With missing coordinates rows of a large table meet by
the coordinates that both have, a join with complete ones for each such set. With too many sets distances
keep no triangle inequality, so leaves are those of a k-d tree and the box of each leaf bounds them.
A left row first meets its home leaf, which bounds its k-th distance, and is then sent only to leaves
that can hold something closer. Leaves grow with the table: their number is bounded by the bytes of what
describes them, and large ones are cut by hash, so neither grows beyond a task.

Rows meet in groups of neighbouring leaves, so that a row is sent once for many leaves. Inside a task, up to
`CELL_DIMS` coordinates, both sides are cut into cells of some `CELL_ROWS` rows, and a cell of left rows only meets
the cells that can hold something near enough. Distances are matrix products of blocks; whatever may belong to the k nearest within
the product's rounding is computed again coordinate by coordinate, so results are exact. Only k
candidates per (row, group) leave a task and no pair table exists at any point. Busy groups replicate over left
salts, and of identical points only as many are kept as can be wanted before anything is compared. Below a checked number of bytes
(carried columns included) the right side is broadcast instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..core import num, q
from ..session import cut_lineage

BROADCAST_BYTES = 16 << 20
#: what describes the leaves (pivots or boxes) goes to every task
LEAF_BYTES = 16 << 20
LEAF_ROWS = 4_096
BLOCK_LEFT = 20_000
SAMPLE_ROWS = 40_000
#: numbers in a block's matrix
BLOCK_CELLS = 2_000_000
#: right rows from which rows with missing coordinates meet by what they have, and joins that may take
PATTERN_ROWS, PATTERNS = 16_384, 32
#: rows of a cell inside a task, and coordinates up to which cells are worth it
CELL_ROWS, CELL_DIMS = 64, 12
#: right rows of a group of leaves and bytes of their coordinates, and groups of a table that is not larger than these allow
GROUP_ROWS, GROUP_BYTES, GROUPS = 65_536, 32 << 20, 16


@dataclass
class Tree:
    dim: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    leaf: list[int]
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        dim, cut = np.array(self.dim), np.array(self.cut)
        lo, hi, leaf = np.array(self.left), np.array(self.right), np.array(self.leaf)
        rows = np.arange(len(x))
        while True:
            inner = leaf[node] < 0
            if not inner.any():
                return leaf[node]
            r, nd = rows[inner], node[inner]
            node[r] = np.where(x[r, dim[nd]] <= cut[nd], lo[nd], hi[nd])


def build_tree(sample: np.ndarray, leaves: int) -> Tree:
    t = Tree([], [], [], [], [], 0)

    def grow(rows: np.ndarray, parts: int) -> int:
        me = len(t.dim)
        t.dim.append(0), t.cut.append(0.0), t.left.append(0), t.right.append(0), t.leaf.append(-1)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        d = int(np.argmax(spread))
        if parts > 1 and len(rows) > 1 and spread[d] > 0:
            c = float(np.median(rows[:, d]))
            low = rows[:, d] <= c
            if low.all():
                c = float(np.max(rows[rows[:, d] < c, d], initial=-math.inf))
                low = rows[:, d] <= c
            if low.any() and not low.all():
                t.dim[me], t.cut[me] = d, c
                t.left[me] = grow(rows[low], parts // 2)
                t.right[me] = grow(rows[~low], parts - parts // 2)
                return me
        t.leaf[me] = t.leaves
        t.leaves += 1
        return me

    grow(sample, leaves)
    return t


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str, missing: bool, share: float = 1.0) -> np.ndarray:
    """Distance of each row of a to the same row of b, one coordinate after another; with ``missing``,
    coordinates absent on either side are left out and the sum is scaled up by their share (by ``share`` where they were left out before). A
    metric named ``-euclidean`` or ``-manhattan`` gives negative distances, which turns nearest into
    farthest."""
    sign, metric = (-1.0, metric[1:]) if metric.startswith("-") else (1.0, metric)
    acc, seen = np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        d = np.abs(d) if metric == "manhattan" else d * d
        if missing:
            ok = ~np.isnan(d)
            seen += ok
            d = np.where(ok, d, 0.0)
        acc += d
    if missing:
        with np.errstate(divide="ignore", invalid="ignore"):
            acc = np.where(seen > 0, acc * (a.shape[1] / seen), sign * np.inf)
    elif share != 1.0:
        acc = acc * share
    return sign * (acc if metric == "manhattan" else np.sqrt(acc))


def centred(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Centre of the right rows, the rows from there, the sums of their squares, and the largest coordinate."""
    centre = np.nan_to_num(np.nanmean(b, axis=0)) if len(b) and not np.isnan(b).all() else np.zeros(b.shape[1])
    y = b - centre
    return centre, y, (y * y).sum(axis=1), np.abs(np.nan_to_num(y)).max(initial=0.0)


def block_bounds(a: np.ndarray, b: np.ndarray, metric: str, missing: bool, right=None) -> tuple[np.ndarray, np.ndarray]:
    """|a| x |b| numbers that order as distances do (squares for euclidean), and how far each row's may be off. ``right`` is ``centred(b)``."""
    sign, metric = (-1.0, metric[1:]) if metric.startswith("-") else (1.0, metric)
    p = a.shape[1]
    if metric == "manhattan":
        acc = np.zeros((len(a), len(b)))
        seen = np.zeros_like(acc) if missing else None
        for j in range(p):
            d = np.abs(a[:, j, None] - b[None, :, j])
            if missing:
                ok = ~np.isnan(d)
                seen += ok
                d = np.where(ok, d, 0.0)
            acc += d
        off = np.zeros(len(a))
    else:
        centre, y, yy, reach = right or centred(b)
        x = a - centre
        if missing:
            here, there = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            seen = here @ there.T
            acc = (x * x) @ there.T + here @ (y * y).T - 2 * (x @ y.T)
        else:
            seen = None
            acc = x @ y.T
            acc *= -2
            acc += (x * x).sum(axis=1)[:, None]
            acc += yy
        size = (np.abs(x).max(axis=1, initial=0.0) + reach) ** 2
        off = size * (4e-16 * p * (p + 4)) * (p if missing else 1)
    if missing:
        with np.errstate(divide="ignore", invalid="ignore"):
            acc = np.where(seen > 0, acc * (p / seen), sign * np.inf)
    return (acc if sign > 0 else -acc), off


def block_top_k(a, b, k, metric, missing, same=None, share=1.0):
    """(left row, right row, distance) of the k nearest; ties go to the earlier right row."""
    step = max(1, BLOCK_CELLS // max(1, len(b)))
    rows_out, cols_out, dist_out = [], [], []
    right = None if metric.endswith("manhattan") else centred(b)
    for s in range(0, len(a), step):
        d, off = block_bounds(a[s:s + step], b, metric, missing, right)
        if same is not None:
            d[same(s, s + step)] = np.inf
        kk = min(k, d.shape[1])
        kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        r, c = np.nonzero((d <= (kth + 2 * off)[:, None]) & np.isfinite(d))
        v = pair_distances(a[r + s], b[c], metric, missing, share)
        order = np.lexsort((c, v, r))
        r, c, v = r[order], c[order], v[order]
        first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else np.zeros(0, int)
        keep = np.arange(len(r)) - start < k
        rows_out.append(r[keep] + s), cols_out.append(c[keep]), dist_out.append(v[keep])
    if not rows_out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows_out), np.concatenate(cols_out), np.concatenate(dist_out)


def stretch(share: float, metric: str) -> float:
    """What a distance grows by when its sum is scaled up by ``share``."""
    return share if metric.endswith("manhattan") else math.sqrt(share)


class Cells:
    """Rows cut at medians into small boxes, in the order of ``rows``; cell i is ``rows[start[i]:start[i + 1]]``."""

    def __init__(self, x: np.ndarray):
        parts, todo = [], [np.arange(len(x))] if len(x) else []
        while todo:
            mine = todo.pop()
            here = x[mine]
            spread = here.max(axis=0) - here.min(axis=0)
            d = int(np.argmax(spread))
            if len(mine) > CELL_ROWS and spread[d] > 0:
                v = here[:, d]
                cut = float(np.partition(v, len(v) // 2)[len(v) // 2])
                low = v < cut
                if not low.any():  # half of them are the smallest
                    low = v <= cut
                todo += [mine[~low], mine[low]]
            else:
                parts.append(np.sort(mine))
        self.rows = np.concatenate(parts) if parts else np.zeros(0, int)
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in parts])]).astype(int)
        self.low = np.array([x[r].min(axis=0) for r in parts])
        self.high = np.array([x[r].max(axis=0) for r in parts])

    @classmethod
    def of(cls, parts: dict) -> Cells:
        """Cells from their arrays, which is what a broadcast may hold."""
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    def cell(self, i: int) -> np.ndarray:
        return self.rows[self.start[i]:self.start[i + 1]]

    def members(self, chosen: np.ndarray) -> np.ndarray:
        """Rows of some cells, ascending."""
        return np.sort(np.concatenate([self.cell(i) for i in chosen]))

    def bounds(self, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
        """Lower bound on the (signed) distance of each cell's rows from all points of a box."""
        if metric.startswith("-"):
            gap = np.maximum(np.abs(self.high - low), np.abs(high - self.low))
        else:
            gap = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        far = gap.sum(axis=1) if metric.endswith("manhattan") else np.sqrt((gap * gap).sum(axis=1))
        return -far if metric.startswith("-") else far


def cells_top_k(a, b, k, metric, same=None, cells: Cells | None = None, share=1.0):
    """What `block_top_k` gives, for complete rows: a cell of left rows meets only the right cells that can be near enough."""
    cells = cells or Cells(b)
    here, sizes = Cells(a), np.diff(cells.start)
    out = []
    for i in range(len(here.low)):
        mine = here.cell(i)

        def top(chosen):
            rows = cells.members(chosen)
            r, c, v = block_top_k(a[mine], b[rows], k, metric, False, None if same is None else (lambda s, e: same(mine[s:e], rows)), share)
            return mine[r], rows[c], v, np.bincount(r, minlength=len(mine))
        bound = cells.bounds(here.low[i], here.high[i], metric)
        order = np.argsort(bound, kind="stable")
        held, want = np.cumsum(sizes[order]), k + 1
        while True:  # a few cells bound the k-th distance of every row
            m = int(np.searchsorted(held, want)) + 1
            r, c, v, n = top(order[:m])
            if m >= len(order) or n.min() >= k:
                break
            want = 4 * max(want, int(held[m - 1]))
        if m < len(order):
            kth = float(v.max()) / stretch(share, metric)
            near = order[bound[order] <= kth + abs(kth) * 1e-9 + 1e-300]
            if len(near) > m:
                r, c, v, _ = top(near)
        out.append((r, c, v))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(s: pd.Series, p: int) -> np.ndarray:
    return np.vstack(s.to_numpy()).astype("float64") if len(s) else np.zeros((0, p))


def _vector(df: DataFrame, cols: Sequence[str]):
    nan = F.lit(float("nan"))
    return F.array(*[F.coalesce(num(df, c), nan) for c in cols])


def _row_bytes(df: DataFrame):
    """Bytes of a row: 8 for each number, the length of texts, and of others' text form."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        x = q(f.name)
        if f.name == "v":
            total = total + 8 * F.coalesce(F.size(x), F.lit(0))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + 8 + F.coalesce(F.octet_length(x), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            total = total + 8 + F.coalesce(F.octet_length(F.to_json(F.struct(x))), F.lit(0))
        else:
            total = total + 8
    return total


def knn_join(left: DataFrame, right: DataFrame, cols: Sequence[str] | None, k: int,
             left_key: Sequence[str], right_key: Sequence[str], *, vector: str | None = None,
             metric: str = "euclidean", missing: bool = False, exclude_self: bool = False,
             carry: Sequence[str] = (), broadcast_bytes: int = BROADCAST_BYTES,
             leaf_rows: int = LEAF_ROWS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(l_<key>, r_<key>, r_<carry>, distance, rank) of the k nearest right rows per left row.

    Coordinates are numeric ``cols`` or one array column ``vector``. Ties go to the smaller right
    key. ``exclude_self`` drops the right row with the same key.
    """
    def shape(df, keys, side, extra=()):
        v = q(vector).cast("array<double>") if vector else _vector(df, cols)
        out = df.select(*[q(c).alias(f"{side}_{c}") for c in keys],
                        *[q(c).alias(f"{side}_{c}") for c in extra if c not in keys], v.alias("v"))
        endless = lambda x: F.abs(x) == float("inf")  # noqa: E731  at no finite distance from anything
        gone = endless if missing else lambda x: x.isNull() | F.isnan(x) | endless(x)
        return out.where(~F.coalesce(F.exists("v", gone), F.lit(False)))

    lk = [f"l_{c}" for c in left_key]
    rk = [f"r_{c}" for c in right_key]
    cy = [f"r_{c}" for c in carry if c not in right_key]
    lt, rt = shape(left, left_key, "l"), shape(right, right_key, "r", carry)
    out_type = T.StructType([lt.schema[c] for c in lk] + [rt.schema[c] for c in rk + cy]
                            + [T.StructField("distance", T.DoubleType())])
    if missing and metric.startswith("-"):
        raise ValueError("farthest rows need complete coordinates")
    how = (k, lk, rk, cy, metric, exclude_self, out_type, broadcast_bytes, leaf_rows, leaf_bytes)
    parts = _patterns(lt, rt) if missing and not vector else None
    if parts is None:
        res = _candidates(lt, rt, *how, missing=missing, p=len(cols) if cols else 1)
    else:
        res = None
        for l_rows, r_rows, n in parts:
            one = _candidates(l_rows, r_rows, *how, missing=False, p=n, share=len(cols) / n)
            res = one if res is None else res.unionByName(one)
        if res is None:
            res = left.sparkSession.createDataFrame([], out_type)
    w = W.partitionBy(*[q(c) for c in lk]).orderBy("distance", *[q(c) for c in rk])
    out = res.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("distance", F.abs("distance")) if metric.startswith("-") else out


def _candidates(lt, rt, k, lk, rk, cy, metric, exclude_self, out_type, broadcast_bytes, leaf_rows, leaf_bytes, *, missing, p, share=1.0) -> DataFrame:
    """Left rows with right rows, the k nearest among them."""
    facts = [F.count("*"), F.max(F.size("v")), F.sum(_row_bytes(rt))]
    n_right, size_of, size, points = rt.agg(*facts, F.approx_count_distinct(F.xxhash64("v"), 0.01)).first()
    p = size_of or p
    wanted = k + 1 if exclude_self else k
    if n_right > 16 * CELL_ROWS and points * wanted < 0.5 * n_right:
        rt = cut_lineage(_thin_copies(rt, rk, wanted))
        n_right, _, size = rt.agg(*facts).first()
    if not n_right:
        return lt.sparkSession.createDataFrame([], out_type)
    if size <= broadcast_bytes:
        return _broadcast_join(lt, rt, k, lk, rk, cy, metric, missing, exclude_self, p, out_type, share)
    return _leaf_join(lt, rt, k, lk, rk, cy, metric, missing, exclude_self, p, out_type, share, n_right, leaf_rows, leaf_bytes)


def _patterns(lt, rt):
    """Left and right rows that share the same coordinates, all of them complete and without the others, and the number of coordinates.

    A pair of rows is in exactly one such join, where cells and the triangle inequality prune and identical points can be thinned. None where the table is small
    or has too many patterns of missing coordinates: its boxes then bound the distances."""
    if rt.count() <= PATTERN_ROWS:
        return None
    p = rt.select(F.max(F.size("v"))).first()[0]
    if p > 62:
        return None
    have = F.lit(0).cast("long")
    for j in range(p):
        x = F.col("v")[j]
        have = have + F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(F.lit(1 << j))
    lt, rt = lt.withColumn("__have", have), rt.withColumn("__have", have)
    here, there = [sorted(r[0] for r in t.select("__have").distinct().limit(PATTERNS + 1).collect()) for t in (lt, rt)]
    if max(len(here), len(there)) > PATTERNS:
        return None
    pairs = [(a, b) for a in here for b in sorted({a & x for x in there} - {0})]
    if len(pairs) > PATTERNS:
        return None
    out = []
    for a, b in pairs:
        at = [j for j in range(p) if b >> j & 1]
        v = F.array(*[F.col("v")[j] for j in at]).alias("v")
        l_rows, r_rows = lt.where(F.col("__have") == a), rt.where(F.col("__have").bitwiseAND(F.lit(a)) == b)
        out.append((*[t.select(*[q(c) for c in t.columns if c not in ("v", "__have")], v) for t in (l_rows, r_rows)], len(at)))
    return out


def _same_rows(lpdf, rpdf, lk, rk):
    """Mask builder for pairs whose keys are equal; keys may repeat, and nulls are equal."""
    n, code = len(lpdf), np.zeros(len(lpdf) + len(rpdf), np.int64)
    for a, b in zip(lk, rk):
        one, values = pd.factorize(pd.concat([lpdf[a], rpdf[b]], ignore_index=True), use_na_sentinel=False)
        code = pd.factorize(code * (len(values) + 1) + one)[0]
    left, right = code[:n], code[n:]
    return lambda rows, cols: left[rows][:, None] == right[cols][None, :]


def _emit(lpdf, rpdf, lk, rk, cy, k, metric, missing, exclude_self, p, share, b=None, cells=None):
    a = _matrix(lpdf["v"], p)
    b = _matrix(rpdf["v"], p) if b is None else b
    same = _same_rows(lpdf, rpdf, lk, rk) if exclude_self and len(rpdf) and len(lpdf) else None
    if not len(a) or not len(b):
        r, c, d = [], [], []
    elif missing or p > CELL_DIMS or len(b) <= 4 * CELL_ROWS:
        r, c, d = block_top_k(a, b, k, metric, missing, None if same is None else (lambda s, e: same(slice(s, e), slice(None))), share)
    else:
        r, c, d = cells_top_k(a, b, k, metric, same, cells, share)
    left = lpdf[lk].iloc[r].reset_index(drop=True)
    right = rpdf[rk + cy].iloc[c].reset_index(drop=True)
    out = pd.concat([left, right], axis=1)
    out["distance"] = np.asarray(d, dtype="float64")
    return out


def _broadcast_join(lt, rt, k, lk, rk, cy, metric, missing, exclude_self, p, out_type, share):
    """The right side fits a checked number of bytes: ship it once, stream the left side past on all cores."""
    rpdf = rt.toPandas().sort_values(rk, kind="stable").reset_index(drop=True)
    b = _matrix(rpdf["v"], p)
    cells = None if missing or p > CELL_DIMS else vars(Cells(b))
    shared = lt.sparkSession.sparkContext.broadcast((rpdf[rk + cy], b, cells))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, b, parts = shared.value
        cells = parts and Cells.of(parts)
        for lpdf in batches:
            yield _emit(lpdf, right, lk, rk, cy, k, metric, missing, exclude_self, p, share, b, cells)[out_type.names]
    return lt.repartition(3 * lt.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, out_type)


class Pivots:
    """Leaves as the cells of pivots. Distances to pivots are matrix products, so bounds are a little slack."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.far, self.metric, self.pivots = metric.startswith("-"), metric.lstrip("-"), pivots
        self.ids = self.low = self.high = None

    def _distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """All distances, euclidean ones within slack."""
        if self.metric == "manhattan":
            out = np.zeros((len(x), len(y)))
            for j in range(x.shape[1]):
                out += np.abs(x[:, j, None] - y[None, :, j])
            return out
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        return np.sqrt(np.maximum(xx[:, None] + yy[None, :] - 2 * (x @ y.T), 0.0))

    def _slack(self, x: np.ndarray) -> float:
        """No product is off by more: its square is off by some 1e-16 of the largest squares."""
        size = max(float(np.abs(x).max(initial=0.0)), float(np.abs(self.pivots).max(initial=0.0))) * x.shape[1]
        return size * 1e-6 + 1e-300

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row and its distance to the leaf's pivot."""
        leaf, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
        step = max(1, BLOCK_CELLS // len(self.pivots))
        for s in range(0, len(x), step):
            d = self._distances(x[s:s + step], self.pivots)
            leaf[s:s + step] = d.argmin(axis=1)
            dist[s:s + step] = d[np.arange(len(d)), leaf[s:s + step]]
        return leaf, dist

    def describe(self, rows) -> None:
        """Leaves that hold rows, with the range of their distances to the pivot."""
        self.ids = np.array([r["leaf"] for r in rows], np.int64)
        self.low, self.high = np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])
        self.pivots = self.pivots[self.ids]

    def order(self) -> np.ndarray:
        """Leaves so that neighbours follow each other."""
        return np.argsort(build_tree(self.pivots, len(self.pivots)).assign(self.pivots), kind="stable")

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """rows x leaves lower bounds on the (signed) distance."""
        d, slack = self._distances(x, self.pivots), self._slack(x)
        if self.far:
            return -(d + self.high + 2 * slack)
        out = np.maximum(np.maximum(d - self.high, self.low - d) - 2 * slack, 0.0)
        if self.metric == "euclidean" and len(x):
            # rows of a leaf lie on its side of the plane between its pivot and the nearest one
            home = d.argmin(axis=1)
            homes, at = np.unique(home, return_inverse=True)
            between = self._distances(self.pivots[homes], self.pivots)[at]
            near = d[np.arange(len(x)), home][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between > 100 * slack, (d * d - near * near - 4 * slack * (d + near + slack)) / (2 * between) - 2 * slack, 0.0)
            # cells were cut with products too: a row may be on the wrong side by as much
            reach = np.maximum(self.high[None, :], near)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane -= np.where(between > 100 * slack, 4 * slack * (reach + slack) / (2 * between), 0.0)
            out = np.maximum(out, plane)
        return out


class Boxes:
    """Leaves of a k-d tree with the boxes of their rows, for coordinates that may be missing."""

    def __init__(self, tree: Tree, fill: np.ndarray, metric: str, p: int):
        self.tree, self.fill, self.metric, self.p = tree, fill, metric, p

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.tree.assign(np.where(np.isnan(x), self.fill, x)), np.zeros(len(x))

    def describe(self, rows) -> None:
        def grid(prefix, missing_value):
            return np.array([[missing_value if r[f"{prefix}{j}"] is None else r[f"{prefix}{j}"] for j in range(self.p)]
                             for r in rows], dtype="float64")
        self.ids = np.array([r["leaf"] for r in rows], np.int64)
        self.low, self.high = grid("a", -math.inf), grid("b", math.inf)
        self.gap = np.array([[bool(r[f"m{j}"]) for j in range(self.p)] for r in rows])

    def order(self) -> np.ndarray:
        return np.arange(len(self.ids))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        acc, present = np.zeros((len(x), len(self.ids))), np.zeros(len(x))
        for j in range(self.p):
            v = x[:, j, None]
            d = np.maximum(np.maximum(self.low[None, :, j] - v, v - self.high[None, :, j]), 0.0)
            d = d if self.metric == "manhattan" else d * d
            here = ~np.isnan(x[:, j])
            present += here
            acc += np.where(here[:, None] & ~self.gap[None, :, j], d, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            acc = np.where(present[:, None] > 0, acc * (self.p / present[:, None]), 0.0)
        return acc if self.metric == "manhattan" else np.sqrt(acc)


def leaf_count(n: int, leaf_rows: int, leaf_bytes: int, bytes_each: int) -> int:
    """Leaves of about max(leaf_rows, sqrt(n)) rows, as many at most as leaf_bytes can describe."""
    return int(max(1, min(math.ceil(n / max(leaf_rows, math.isqrt(n))), leaf_bytes // bytes_each)))


def leaf_groups(order: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """Group of every leaf: leaves taken in ``order`` until a group would hold more than ``rows`` rows."""
    group, now, held = np.zeros(len(sizes), int), 0, 0
    for i in order:
        if held and held + sizes[i] > rows:
            now, held = now + 1, 0
        group[i], held = now, held + sizes[i]
    return group


def _leaf_join(lt, rt, k, lk, rk, cy, metric, missing, exclude_self, p, out_type, share, n_right, leaf_rows, leaf_bytes):
    leaves = leaf_count(n_right, leaf_rows, leaf_bytes, p * (17 if missing else 8) + 24)
    sample = rt.orderBy(F.xxhash64(*[q(c) for c in rk])).select("v").limit(max(leaves, SAMPLE_ROWS) if missing else leaves).collect()
    sample = np.array([[np.nan if x is None else x for x in r["v"]] for r in sample], dtype="float64")
    if missing:
        with np.errstate(all="ignore"):
            fill = np.where(np.isnan(sample).all(axis=0), 0.0, np.nanmean(sample, axis=0))
        parts = Boxes(build_tree(np.where(np.isnan(sample), fill, sample), leaves), fill, metric, p)
    else:
        parts = Pivots(np.unique(sample, axis=0), metric)

    def add_leaf(batches):
        for pdf in batches:
            leaf, dist = parts.assign(_matrix(pdf["v"], p))
            pdf["leaf"], pdf["reach"] = leaf.astype("int32"), dist
            yield pdf
    tasks = 3 * lt.sparkSession.sparkContext.defaultParallelism  # few bytes, much work
    rl = cut_lineage(rt.repartition(tasks).mapInPandas(add_leaf, _with_leaf(rt.schema).add("reach", "double")))
    rows = rl.groupBy("leaf").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"), *(_box(p) if missing else [])).orderBy("leaf").collect()
    rl = rl.drop("reach")
    parts.describe(rows)  # as many rows as leaves, bounded above
    # neighbouring leaves meet the left rows together
    largest = min(GROUP_ROWS, max(leaf_rows, GROUP_BYTES // (8 * p)))
    group = leaf_groups(parts.order(), np.array([r["n"] for r in rows]), min(largest, max(16 * leaf_rows, n_right // GROUPS)))
    held = np.bincount(group, weights=[r["n"] for r in rows]).astype(int)
    chunks = {g: max(1, math.ceil(n / largest)) for g, n in enumerate(held.tolist())}
    names = F.broadcast(lt.sparkSession.createDataFrame(list(zip(parts.ids.tolist(), group.tolist())), "leaf int, __g int"))
    rl = rl.join(names, "leaf").drop("leaf").withColumnRenamed("__g", "leaf")
    step = max(1, BLOCK_CELLS // len(parts.ids))
    by_group = np.argsort(group, kind="stable")
    first_of = np.searchsorted(group[by_group], np.arange(len(held)))

    def homes(batches):
        for pdf in batches:
            x = _matrix(pdf["v"], p)
            best = [parts.bounds(x[s:s + step]).argmin(axis=1) for s in range(0, len(x), step)]
            pdf["leaf"] = group[np.concatenate(best or [np.zeros(0, int)])].astype("int32")
            yield pdf
    l_type = _with_leaf(lt.schema)
    # phase 1: the home group gives a bound on the k-th distance
    home = cut_lineage(lt.repartition(tasks).mapInPandas(homes, l_type))
    first = cut_lineage(_meet(home, rl, chunks, k, lk, rk, cy, metric, missing, exclude_self, p, out_type, share))
    w = W.partitionBy(*[q(c) for c in lk]).orderBy("distance")
    kth = (first.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == k)
           .select(*[q(c) for c in lk], F.col("distance").alias("bound")))
    bounded = home.join(kth, lk, "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def slack(b):
        return np.where(np.isinf(b), b, b + np.abs(np.where(np.isinf(b), 0.0, b)) * 1e-9 + 1e-12)

    def visits(batches):
        for pdf in batches:
            x, bound, mine = _matrix(pdf["v"], p), slack(pdf["bound"].to_numpy()) / stretch(share, metric), pdf["leaf"].to_numpy()
            near = []
            for s in range(0, len(x), step):
                ok = np.logical_or.reduceat((parts.bounds(x[s:s + step]) <= bound[s:s + step, None])[:, by_group], first_of, axis=1)
                ok[np.arange(len(ok)), mine[s:s + step]] = False
                near += [np.flatnonzero(row).tolist() for row in ok]
            out = pdf.drop(columns=["bound", "leaf"])
            out["leaves"] = near
            yield out
    # one row for each left row, with the groups it still has to see
    v_type = T.StructType([f for f in l_type.fields if f.name != "leaf"]).add("leaves", T.ArrayType(T.IntegerType()))
    left = cut_lineage(bounded.select(*[q(f.name) for f in l_type.fields], "bound").mapInPandas(visits, v_type))
    rest = left.select(*[q(f.name) for f in v_type.fields if f.name != "leaves"], F.explode("leaves").alias("leaf"))
    return first.unionByName(_meet(rest, rl, chunks, k, lk, rk, cy, metric, missing, exclude_self, p, out_type, share))


def _with_leaf(schema: T.StructType) -> T.StructType:
    """Adds the leaf; coordinates may come back from pandas as nulls where they were NaN."""
    fields = [T.StructField("v", T.ArrayType(T.DoubleType(), True)) if f.name == "v" else f for f in schema.fields]
    return T.StructType(fields + [T.StructField("leaf", T.IntegerType())])


def _thin_copies(rt, rk, k):
    """Keep the k smallest keys of every set of identical points, and k rows of a key.

    Reduced in two steps, first inside hash salts, so a point held by a third of all rows is cut
    down before its rows meet in one task.
    """
    keys = [q(c) for c in rk]
    one = W.partitionBy("v", *keys).orderBy(F.lit(0))
    salted = rt.withColumn("__s", F.pmod(F.xxhash64(*keys), F.lit(1024)))
    for part in (["v", "__s"], ["v"]):
        w = W.partitionBy(*part).orderBy(*keys)
        salted = salted.withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") <= k).drop("__r")
    return salted.withColumn("__r", F.row_number().over(one)).where(F.col("__r") <= k).drop("__s", "__r")


def _box(p):
    aggs = []
    for j in range(p):
        x = F.when(~F.isnan(F.col("v")[j]), F.col("v")[j])
        aggs += [F.min(x).alias(f"a{j}"), F.max(x).alias(f"b{j}"), F.bool_or(x.isNull()).alias(f"m{j}")]
    return aggs


def _meet(visits, rl, chunks, k, lk, rk, cy, metric, missing, exclude_self, p, out_type, share):
    """Bring left rows and right leaves together in groups of bounded size on both sides."""
    spark = visits.sparkSession
    load = {r["leaf"]: r["count"] for r in visits.groupBy("leaf").count().collect()}
    plan = [(int(leaf), int(c), int(max(1, math.ceil(load.get(leaf, 0) / BLOCK_LEFT))))
            for leaf, c in chunks.items() if load.get(leaf)]
    if not plan:
        return spark.createDataFrame([], out_type)
    table = F.broadcast(spark.createDataFrame(plan, "leaf int, chunks int, blocks int"))  # a row for each leaf
    lkeys, rkeys = [q(c) for c in lk], [q(c) for c in rk]
    left = (visits.join(table, "leaf")
            .withColumn("block", F.pmod(F.xxhash64(*lkeys), F.col("blocks")).cast("int"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "blocks"))
    right = (rl.join(table, "leaf")
             .withColumn("chunk", F.pmod(F.xxhash64(*rkeys), F.col("chunks")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("chunks", "blocks"))
    names = out_type.names

    def both(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        rpdf = rpdf.sort_values(rk, kind="stable").reset_index(drop=True)
        return _emit(lpdf, rpdf, lk, rk, cy, k, metric, missing, exclude_self, p, share)[names]
    by = ["leaf", "chunk", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(both, out_type)
