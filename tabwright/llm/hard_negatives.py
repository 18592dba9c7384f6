"""Hard negatives of anchors, found through bounds from segment summaries.

A vector is cut into segments; of each one its mean and its deviation (the length of what is left without the mean) are kept. The
inner product of two segments is their means' product times their length, plus or minus at most the product of the deviations, so
summaries bound a pair's score from both sides. The segments of a coarse level are halved again and again for the pairs
that the level before could not settle; what is left is scored exactly, in whole numbers.

Anchors are broadcast in slices of at most `slice_bytes` of vectors, and all rows stream past a slice twice: for the positives (the best
rows of the anchor's own label) and, when these are known, for the negatives: the best rows of other labels whose score lies in the band
of a positive. A task keeps only the best few of every anchor and band, which also raise the bar for the rows that follow; the tasks' lists
are merged by a window whose groups are that small. Nothing else is sent, and no pair table exists.

Defined cases: rows with a null label, a null or empty vector, or null or non-finite components take no part, nor do vectors of another
length than most have; a null id ranks behind all others and is no anchor; rows with the anchor's own id are the anchor itself, never its
positives or negatives; an anchor that is repeated with the same label and vector is one anchor, repeated rows otherwise count
each for itself; scores beyond long are held at its ends; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .tables import named_id
from .vectors import matrix, products, row_products, usable, whole

SLICE_BYTES = 16 << 20
#: rows of the first block of a task (they only raise the bar), of the others, and anchors that meet a block at once
FIRST_ROWS, ROWS, TOGETHER = 128, 2048, 1024
LOWEST = np.iinfo(np.int64).min
#: columns of a task's candidates: the anchor's place, its band, score and id
FOUND = "anchor long, band int, score long, id long"


class Summaries:
    """Means and deviations of the segments of some vectors at one level, scaled so that sums of products bound inner products."""

    def __init__(self, x: np.ndarray, segments: int):
        edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
        lens = np.diff(edges)
        x = x.astype(np.float64)
        total = np.add.reduceat(x, edges[:-1], axis=1)
        self.mean = total / np.sqrt(lens)
        left = x - np.repeat(total / lens, lens, axis=1)
        self.deviation = np.sqrt(np.add.reduceat(left * left, edges[:-1], axis=1))
        self.norm = np.sqrt((x * x).sum(axis=1))

    def bounds(self, other: Summaries, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible inner product of all pairs, or of the given ones; a little wider than doubles may err."""
        if pairs is None:
            middle, reach, size = self.mean @ other.mean.T, self.deviation @ other.deviation.T, np.outer(self.norm, other.norm)
        else:
            i, j = pairs
            middle, reach = np.einsum("ij,ij->i", self.mean[i], other.mean[j]), np.einsum("ij,ij->i", self.deviation[i], other.deviation[j])
            size = self.norm[i] * other.norm[j]
        reach += size * 1e-9 + 1e-6
        return middle - reach, middle + reach


def levels_of(dimension: int) -> list[int]:
    """Numbers of segments from coarse to fine: at most 4 components in a segment of the finest level."""
    out, n = [], 1
    while n < dimension / 2:
        n *= 2
        out.append(min(n, dimension))
    return out[1::2] or out[-1:] or [1]


class Best:
    """The best `keep` candidates of each anchor and band: score and id, the worst last; empty places hold the lowest score."""

    def __init__(self, anchors: int, bands: int, keep: int):
        self.score = np.full((anchors, bands, keep), LOWEST, np.int64)
        self.id = np.full((anchors, bands, keep), np.iinfo(np.int64).max, np.int64)
        self.there = np.zeros((anchors, bands, keep), bool)
        self.keep = keep

    def bar(self) -> np.ndarray:
        """The score that a candidate must reach (ties may still win by id)."""
        return np.where(self.there[:, :, -1], self.score[:, :, -1], LOWEST)

    def add(self, band: int, anchor: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(anchor):
            return
        touched = np.unique(anchor)
        at = np.repeat(touched, self.keep)
        held = self.there[touched, band].ravel()
        a = np.concatenate([at[held], anchor])
        s = np.concatenate([self.score[touched, band].ravel()[held], score])
        k = np.concatenate([self.id[touched, band].ravel()[held], key])
        order = np.lexsort((k, ~s, a))
        a, s, k = a[order], s[order], k[order]
        start = np.searchsorted(a, a)
        rank = np.arange(len(a)) - start
        top = rank < self.keep
        a, s, k, rank = a[top], s[top], k[top], rank[top]
        self.score[a, band, rank], self.id[a, band, rank], self.there[a, band, rank] = s, k, True

    def batch(self) -> pa.RecordBatch:
        a, b, r = np.nonzero(self.there)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int32)), pa.array(self.score[a, b, r]), pa.array(self.id[a, b, r])], ["anchor", "band", "score", "id"])


class Anchors:
    """A slice of anchors in whole numbers, with the bands in which their candidates may lie."""

    def __init__(self, key: np.ndarray, label: np.ndarray, x: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, keep: int):
        self.key, self.label, self.x, self.same, self.low, self.high, self.keep = key, label, x, same, low, high, keep

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's best candidates of every anchor and band."""
        best, done = Best(len(self.key), self.low.shape[1], self.keep), 0
        levels = levels_of(self.x.shape[1])
        tiles = [slice(i, i + TOGETHER) for i in range(0, len(self.key), TOGETHER)]
        mine = [[Summaries(self.x[t], n) for n in levels] for t in tiles]
        for batch in batches:
            key, label, x = batch.column("key").to_numpy(), batch.column("label").to_numpy(), whole(matrix(batch.column("vec")))
            a = 0
            while a < len(key):
                b = min(len(key), a + (FIRST_ROWS if done < FIRST_ROWS else ROWS))
                theirs = [Summaries(x[a:b], n) for n in levels]
                for t, summaries in zip(tiles, mine):
                    self._block(t, key[a:b], label[a:b], x[a:b], best, list(zip(summaries, theirs)))
                done, a = done + b - a, b
        if done:
            yield best.batch()

    def _block(self, t: slice, key: np.ndarray, label: np.ndarray, x: np.ndarray, best: Best, levels: list[tuple[Summaries, Summaries]]) -> None:
        bar, high = np.maximum(best.bar()[t], self.low[t]), self.high[t]
        wanted = bar <= high
        floor = np.where(wanted, bar, np.iinfo(np.int64).max).min(axis=1).astype(np.float64)
        ceiling = np.where(wanted, high, LOWEST).max(axis=1).astype(np.float64)
        left = ((self.label[t, None] == label) == self.same) & (self.key[t, None] != key) & wanted.any(axis=1)[:, None]
        pairs = None
        for a, b in levels:
            if pairs is None and left.mean() > 0.2:  # most pairs are open: the whole block at once
                lo, hi = a.bounds(b)
                left &= (hi >= floor[:, None]) & (lo <= ceiling[:, None])
                continue
            pairs = np.nonzero(left) if pairs is None else pairs
            lo, hi = a.bounds(b, pairs)
            ok = (hi >= floor[pairs[0]]) & (lo <= ceiling[pairs[0]])
            pairs = pairs[0][ok], pairs[1][ok]
        i, j = np.nonzero(left) if pairs is None else pairs
        mine = self.x[t]
        if len(i) > 0.1 * left.size:
            score = products(mine, x)[i, j]
        else:
            step = 1 << 16
            score = np.concatenate([row_products(mine[i[k:k + step]], x[j[k:k + step]]) for k in range(0, len(i), step)] or [np.zeros(0, np.int64)])
        for band in range(high.shape[1]):
            ok = (score >= bar[i, band]) & (score <= high[i, band])
            best.add(band, i[ok] + t.start, score[ok], key[j[ok]])


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """The best of all tasks' lists, ranked from 1."""
    w = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def _bands(scores: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number bands [low, high] with least * score <= 100 * x <= most * score."""
    low = [-(-least * int(s) // 100) for s in scores]
    high = [most * int(s) // 100 for s in scores]
    return np.array(low, np.int64), np.array(high, np.int64)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on `key`, the id. A positive's negatives score between `least` and `most` hundredths of its own score.
    """
    rows = usable(vectors, id_col, vector_col, label_col, "label").filter("label IS NOT NULL").withColumn("label", F.col("label").cast("long"))
    anchors = rows.filter(is_anchor & named_id().isNotNull()).distinct()
    n, d = anchors.agg(F.count("*"), F.max(F.size("vec"))).first()
    slices = max(1, -(-n * (d or 1) * 8 // slice_bytes))
    dealt = F.pmod(F.xxhash64("key", "label", "vec"), F.lit(slices))
    out = []
    for k in range(slices):
        here = anchors.filter(dealt == k).toArrow()  # about slice_bytes
        if not here.num_rows:
            continue
        key, label, x = here["key"].to_numpy(), here["label"].to_numpy(), whole(matrix(here["vec"]))
        whole_range = np.full((len(key), 1), LOWEST), np.full((len(key), 1), np.iinfo(np.int64).max)
        best = cut_lineage(_merged(_search(rows, Anchors(key, label, x, True, *whole_range, positives)), positives))
        got = best.select("anchor", "rank", "score").toPandas()  # at most `positives` for each anchor of the slice
        low, high = np.full((len(key), positives), 1), np.full((len(key), positives), 0)
        at = got["anchor"].to_numpy(), got["rank"].to_numpy() - 1
        low[at], high[at] = _bands(got["score"].to_numpy(), least, most)
        worst = _merged(_search(rows, Anchors(key, label, x, False, low, high, negatives)), negatives)
        named = best.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(key)], "anchor long, anchor_id long")
        pair = best.select("anchor", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        both = worst.select("anchor", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pair, ["anchor", "band"]).join(F.broadcast(named), "anchor")
        out.append(cut_lineage(both.select("anchor_id", named_id("positive_id").alias("positive_id"), "rank", named_id("negative_id").alias("negative_id"), "positive_score", "negative_score")))
    if not out:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out)


def _search(rows: DataFrame, anchors: Anchors) -> DataFrame:
    return rows.select("key", "label", "vec").mapInArrow(anchors.search, FOUND)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("key") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
