"""Importances of a random forest of classification trees over counted rows.

Trees split columns at a bounded number of cuts, so rows with the same bins and class are one row to every tree. They are
counted once on the cluster (a cell each), and a tree draws how often it sees a cell from the Poisson distribution of its
count: the sum of what a bootstrap draws for each of its rows. Fits then take time by cells, not by rows, and trees grow on
all cores. The rest is as in Spark's forest: Gini impurity, random columns for each node (the square root of their number),
least rows of a child, depth, sister leaves of one class joined, importances normalised by tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from ..core import nn, num, q
from .learners import class_list, label_index

#: rows from which they are counted, and cells up to which that helps
COUNTED_ROWS, CELLS = 1_000_000, 1 << 18


@dataclass
class Cells:
    columns: list[str]
    bins: np.ndarray
    counts: np.ndarray

    def only(self, columns: Sequence[str]) -> Cells:
        """The cells of some of the columns."""
        at = [self.columns.index(c) for c in columns]
        bins, code = np.unique(self.bins[:, at], axis=0, return_inverse=True)
        counts = np.zeros((len(bins), self.counts.shape[1]), np.int64)
        np.add.at(counts, code.ravel(), self.counts)
        return Cells(list(columns), bins, counts)


def counted(df: DataFrame, columns: Sequence[str], target: str, max_bins: int = 64) -> Cells | None:
    """Cells of all rows with a target; None for few rows, or when there are too many cells."""
    df = df.where(nn(df, target).isNotNull()).select(*[F.coalesce(num(df, c), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(columns)], nn(df, target).alias("y"))
    names = [f"f{i}" for i in range(len(columns))]
    n, *distinct = df.agg(F.count("*"), *[F.approx_count_distinct(c, 0.02) for c in names]).first()
    if n < COUNTED_ROWS:
        return None
    few = {c: [r[0] for r in df.select(c).distinct().orderBy(c).limit(max_bins + 1).collect()] for c, d in zip(names, distinct) if d <= 1.2 * max_bins}
    cuts = {c: v[1:] for c, v in few.items() if len(v) <= max_bins}
    many = [c for c in names if c not in cuts]
    if many:
        found = df.approxQuantile(many, [i / max_bins for i in range(1, max_bins)], 0.1 / max_bins)
        cuts |= {c: sorted(set(v)) for c, v in zip(many, found)}
    classes = class_list(df, "y")
    edges = [[-math.inf, *[x for x in cuts[c] if -math.inf < x < math.inf], math.inf] for c in names]
    if any(len(e) == 2 for e in edges):  # one value: a cut that no row reaches
        edges = [e if len(e) > 2 else [-math.inf, 1.7e308, math.inf] for e in edges]
    binned = Bucketizer(splitsArray=edges, inputCols=names, outputCols=[f"b{i}" for i in range(len(names))], handleInvalid="error").transform(df)
    binned = binned.select(*[q(f"b{i}").cast("int").alias(f"b{i}") for i in range(len(names))], label_index(F.col("y"), classes).cast("int").alias("y"))
    keys = [f"b{i}" for i in range(len(names))]
    if binned.agg(F.approx_count_distinct(F.xxhash64(*keys), 0.02)).first()[0] > CELLS:
        return None
    rows = binned.groupBy(*keys, "y").agg(F.count("*").alias("n")).toPandas()
    bins, code = np.unique(rows[keys].to_numpy(np.int64), axis=0, return_inverse=True)
    counts = np.zeros((len(bins), len(classes)), np.int64)
    np.add.at(counts, (code.ravel(), rows["y"].to_numpy()), rows["n"].to_numpy())
    return Cells(list(columns), bins, counts)


def gini(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - ((counts / total[..., None]) ** 2).sum(axis=-1)


def tree_importances(bins: np.ndarray, seen: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> np.ndarray:
    """Gain of every column in one tree, by the share of the tree's gains."""
    columns, classes = bins.shape[1], seen.shape[1]
    subset, wide = max(1, math.ceil(math.sqrt(columns))), bins.max(axis=0) + 1
    at, levels = np.zeros(len(bins), np.int64), []
    for level in range(depth + 1):
        nodes = int(at.max(initial=-1)) + 1
        total = np.stack([np.bincount(at, seen[:, k], nodes) for k in range(classes)], axis=1)
        rows = total.sum(axis=1)
        gain, column, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        chosen = rng.random((nodes, columns)).argsort(axis=1)[:, :subset]
        for f in range(columns) if level < depth else ():
            if wide[f] < 2:
                continue
            cell = at * wide[f] + bins[:, f]
            low = np.stack([np.bincount(cell, seen[:, k], nodes * wide[f]).reshape(nodes, -1) for k in range(classes)], axis=2).cumsum(axis=1)[:, :-1]
            high = total[:, None, :] - low
            n_low, n_high = low.sum(axis=2), high.sum(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = gini(total, rows)[:, None] - n_low / rows[:, None] * gini(low, n_low) - n_high / rows[:, None] * gini(high, n_high)
            gains[(n_low < least) | (n_high < least) | ~(chosen == f).any(axis=1)[:, None]] = 0.0
            best = gains.argmax(axis=1)
            better = gains[np.arange(nodes), best] > gain
            gain[better], column[better], cut[better] = gains[np.arange(nodes), best][better], f, best[better]
        split = column >= 0
        first = np.cumsum(split) * 2 - 2
        levels.append((split, column, gain * rows, first, total.argmax(axis=1)))
        if not split.any():
            break
        stays = split[at]
        at, bins, seen = at[stays], bins[stays], seen[stays]
        at = first[at] + (bins[np.arange(len(at)), column[at]] > cut[at])
    out, below = np.zeros(columns), None
    for split, column, gain, first, answer in reversed(levels):
        if below is not None:  # sister leaves of one class are one leaf
            leaf, says = below
            left = first[split]
            joined = leaf[left] & leaf[left + 1] & (says[left] == says[left + 1])
            split = split.copy()
            split[np.flatnonzero(split)[joined]] = False
        np.add.at(out, column[split], gain[split])
        below = (~split, answer)
    return out / out.sum() if out.sum() else out


def forest_importances(spark, cells: Cells, trees: int = 100, depth: int = 10, least: int = 2, seed: int = 0) -> dict[str, float]:
    """Importances of the columns, trees grown on all cores."""
    context = spark.sparkContext
    shared = context.broadcast((cells.bins, cells.counts))

    def grown(tree: int) -> np.ndarray:
        bins, counts = shared.value
        rng = np.random.default_rng([seed, tree])
        seen = rng.poisson(counts)
        drawn = seen.any(axis=1)
        return tree_importances(bins[drawn], seen[drawn].astype(float), depth, least, rng)
    try:
        total = np.sum(context.parallelize(range(trees), min(trees, 3 * context.defaultParallelism)).map(grown).collect(), axis=0)
    finally:
        shared.unpersist()
    return dict(zip(cells.columns, (total / total.sum() if total.sum() else total).tolist()))
