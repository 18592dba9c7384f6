"""Clustering by mergeable feature trees.

Every task streams its rows into a tree whose leaf entries are (rows, mean, squared deviations); an entry takes a row
only while its radius stays within ``threshold``. The trees' entries are then inserted into each other, a few trees a
task and round, until one is left; its entries are joined to clusters by Ward's criterion, weighted by their rows.
A tree holds at most ``max_entries`` entries: when it would hold more, its limit rises and it is built again from its
entries, so no task, no group and not the driver ever holds more than a stated number of them. The limit reached is
kept in the model; it is ``threshold`` wherever the entries fit.

Rows with a missing or non-finite feature take no part and get no cluster.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..core import num
from ..session import cut_lineage

MAX_ENTRIES = 2_000
#: trees that one task inserts into each other
FAN_IN = 8
ROWS_AT_ONCE = 4_096
ENTRY = "part long, n double, mean array<double>, m2 double, radius double"


def joined(n, mean, m2, n2, mean2, m22):
    """Features of two disjoint sets of rows taken together."""
    total = n + n2
    d = mean2 - mean
    return total, mean + d * (n2 / total), m2 + m22 + (d * d).sum() * (n * n2 / total)


class _Node:
    __slots__ = ("n", "mean", "m2", "kids", "size")

    def __init__(self, room: int, dims: int, leaf: bool):
        self.n, self.mean, self.m2 = np.zeros(room), np.zeros((room, dims)), np.zeros(room)
        self.kids: list | None = None if leaf else []
        self.size = 0

    def set(self, i, n, mean, m2):
        self.n[i], self.mean[i], self.m2[i] = n, mean, m2

    def add(self, n, mean, m2, kid=None):
        self.set(self.size, n, mean, m2)
        self.size += 1
        if self.kids is not None:
            self.kids.append(kid)

    def total(self):
        s = self.size
        n = self.n[:s].sum()
        mean = self.n[:s] @ self.mean[:s] / n
        return n, mean, self.m2[:s].sum() + (self.n[:s] * ((self.mean[:s] - mean) ** 2).sum(axis=1)).sum()


class FeatureTree:
    def __init__(self, dims: int, limit: float, branching: int = 50, max_entries: int = MAX_ENTRIES):
        self.dims, self.limit, self.branching, self.max_entries = dims, float(limit), max(2, branching), max(2, max_entries)
        self._clear()

    def _clear(self):
        self.root, self.entries = self._node(True), 0

    def _node(self, leaf):
        return _Node(self.branching + 1, self.dims, leaf)

    def add_rows(self, x: np.ndarray) -> None:
        """Rows near an entry are absorbed all at once; the others are inserted one by one."""
        for s in range(0, len(x), ROWS_AT_ONCE):
            part = x[s:s + ROWS_AT_ONCE]
            rest = np.arange(len(part))
            if self.entries:
                rest = rest[~self._absorb(self.root, part, rest)]
            for i in rest:
                self.insert(1.0, part[i], 0.0)

    def insert(self, n: float, mean: np.ndarray, m2: float) -> None:
        self._insert_at_root(n, mean, m2)
        while self.entries > self.max_entries:
            self._widen()

    def _insert_at_root(self, n, mean, m2):
        halves = self._insert(self.root, n, mean, m2)
        if halves:
            self.root = self._node(False)
            for h in halves:
                self.root.add(*h.total(), h)

    def _insert(self, node, n, mean, m2):
        """None, or the two nodes that ``node`` was split into."""
        s = node.size
        if s:
            i = int(np.argmin(((node.mean[:s] - mean) ** 2).sum(axis=1)))
            both = joined(node.n[i], node.mean[i], node.m2[i], n, mean, m2)
            if node.kids is None:
                if both[2] <= self.limit ** 2 * both[0]:
                    node.set(i, *both)
                    return None
            else:
                halves = self._insert(node.kids[i], n, mean, m2)
                if halves is None:
                    node.set(i, *both)
                    return None
                node.set(i, *halves[0].total())
                node.kids[i] = halves[0]
                node.add(*halves[1].total(), halves[1])
                return self._split(node) if node.size > self.branching else None
        node.add(n, mean, m2)
        self.entries += 1
        return self._split(node) if node.size > self.branching else None

    def _split(self, node):
        """The two entries farthest from each other draw the rest."""
        mean = node.mean[:node.size]
        d = ((mean[:, None] - mean[None]) ** 2).sum(axis=2)
        a, b = np.unravel_index(np.argmax(d), d.shape)
        second = d[b] < d[a] if d[a, b] > 0 else np.arange(node.size) % 2 == 1
        halves = self._node(node.kids is None), self._node(node.kids is None)
        for i in range(node.size):
            halves[int(second[i])].add(node.n[i], node.mean[i], node.m2[i], node.kids[i] if node.kids is not None else None)
        return halves

    def _absorb(self, node, x, rows):
        """Which of ``rows`` were taken by entries under ``node``: of each entry's rows the longest run of nearest
        ones with which its radius keeps the limit."""
        s = node.size
        centre = node.mean[0]
        m = node.mean[:s] - centre
        near = np.argmin((m * m).sum(axis=1)[None] - 2 * ((x[rows] - centre) @ m.T), axis=1)
        taken = np.zeros(len(rows), dtype=bool)
        for i in np.unique(near):
            at = np.flatnonzero(near == i)
            if node.kids is not None:
                got = at[self._absorb(node.kids[i], x, rows[at])]
            else:
                d = x[rows[at]] - node.mean[i]
                r = (d * d).sum(axis=1)
                order = np.argsort(r, kind="stable")
                n = node.n[i] + np.arange(1, len(at) + 1)
                shift = np.cumsum(d[order], axis=0)
                fits = node.m2[i] + np.cumsum(r[order]) - (shift * shift).sum(axis=1) / n <= self.limit ** 2 * n
                got = at[order[:len(at) if fits.all() else int(np.argmin(fits))]]
            if len(got):
                g = x[rows[got]]
                mean = g.mean(axis=0)
                node.set(i, *joined(node.n[i], node.mean[i], node.m2[i], float(len(g)), mean, ((g - mean) ** 2).sum()))
                taken[got] = True
        return taken

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, mean, squared deviations) of every entry."""
        out: list[tuple] = []

        def walk(node):
            if node.kids is None:
                out.append((node.n[:node.size], node.mean[:node.size], node.m2[:node.size]))
            else:
                for kid in node.kids:
                    walk(kid)
        walk(self.root)
        return tuple(np.concatenate(v) for v in zip(*out))  # type: ignore[return-value]

    def _widen(self):
        """A limit at which about half of the entries join their nearest one, then the tree anew."""
        n, mean, m2 = self.features()
        radius = np.empty(len(n))
        for i in range(len(n)):
            d = ((mean - mean[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            j = int(np.argmin(d))
            radius[i] = np.sqrt((m2[i] + m2[j] + d[j] * n[i] * n[j] / (n[i] + n[j])) / (n[i] + n[j]))
        self.limit = max(1.5 * self.limit, float(np.median(radius)), float(np.finfo(float).tiny))
        self._clear()
        for e in zip(n, mean, m2):
            self._insert_at_root(*e)

    def rows(self, part: int) -> pd.DataFrame:
        n, mean, m2 = self.features()
        return pd.DataFrame({"part": part, "n": n, "mean": list(mean), "m2": m2, "radius": self.limit})


def complete(df: DataFrame, features: Sequence[str]):
    """Whether a row has a finite number in every feature."""
    ok = F.lit(True)
    for c in features:
        x = num(df, c)
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return ok


def fit_entries(df: DataFrame, features: Sequence[str], threshold: float, branching: int = 50, max_entries: int = MAX_ENTRIES):
    """(rows, mean, squared deviations, limit) of the entries of one tree over all rows."""
    dims = len(features)

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = FeatureTree(dims, threshold, branching, max_entries)
        for f in frames:
            tree.add_rows(f.to_numpy(dtype="float64"))
        if tree.entries:
            yield tree.rows(TaskContext.get().partitionId())

    def merge(key, f: pd.DataFrame) -> pd.DataFrame:
        tree = FeatureTree(dims, f["radius"].max(), branching, max_entries)
        for n, mean, m2 in zip(f["n"], f["mean"], f["m2"]):
            tree.insert(n, np.asarray(mean), m2)
        return tree.rows(key[0])

    rows = df.where(complete(df, features)).select(*[num(df, c).alias(f"f{i}") for i, c in enumerate(features)])
    trees = cut_lineage(rows.mapInPandas(grow, ENTRY))
    top = trees.agg(F.max("part")).first()[0]
    if top is None:
        raise ValueError("no row has all features")
    while top > 0:
        trees = trees.withColumn("part", F.floor(F.col("part") / FAN_IN))
        trees = cut_lineage(trees.groupBy("part").applyInPandas(merge, ENTRY))
        top //= FAN_IN
    found = trees.orderBy("mean", "n").collect()
    return (np.array([r["n"] for r in found]), np.array([r["mean"] for r in found]), np.array([r["m2"] for r in found]),
            max(r["radius"] for r in found))


def ward_groups(n: np.ndarray, mean: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each entry after joining, by chains of nearest neighbours, the pairs that add least squared
    deviation until ``k`` clusters are left; numbered in the order of their means."""
    m = len(n)
    n, mean, start = n.astype(float).copy(), mean.astype(float).copy(), mean
    alive = np.ones(m, dtype=bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < m - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        a = chain[-1]
        cost = np.where(alive, n[a] * n / (n[a] + n) * ((mean - mean[a]) ** 2).sum(axis=1), np.inf)
        cost[a] = np.inf
        b = int(np.argmin(cost))
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            del chain[-2:]
            merges.append((float(cost[b]), a, b))
            mean[b] = (n[a] * mean[a] + n[b] * mean[b]) / (n[a] + n[b])
            n[b] += n[a]
            alive[a] = False
        else:
            chain.append(b)
    parent = np.arange(m)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for _, a, b in sorted(merges, key=lambda e: e[0])[:max(0, m - max(1, k))]:
        parent[root(a)] = root(b)
    roots = np.array([root(i) for i in range(m)])
    first = {r: tuple(start[roots == r].min(axis=0)) for r in set(roots.tolist())}
    names = {r: i for i, r in enumerate(sorted(first, key=lambda r: (first[r], r)))}
    return np.array([names[r] for r in roots.tolist()])


def nearest_entry(df: DataFrame, features: Sequence[str], mean: Sequence[Sequence[float]], cluster: Sequence[int]):
    """Cluster of the entry whose mean is nearest, null for rows that lack a feature."""
    centres, names = np.asarray(mean, dtype="float64"), np.asarray(cluster, dtype="float64")
    middle = centres.mean(axis=0)
    sizes = ((centres - middle) ** 2).sum(axis=1)

    @F.pandas_udf("double")
    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for f in parts:
            x = f.to_numpy(dtype="float64") - middle
            out = [np.argmin(sizes - 2 * (x[s:s + ROWS_AT_ONCE] @ (centres - middle).T), axis=1) for s in range(0, len(x), ROWS_AT_ONCE)]
            yield pd.Series(names[np.concatenate(out)] if out else np.zeros(0))
    ok = complete(df, features)
    fields = F.struct(*[F.when(ok, num(df, c)).otherwise(0.0).alias(f"f{i}") for i, c in enumerate(features)])
    return F.when(ok, pick(fields))
