"""Quality scores learned from preferences (Bradley-Terry).

Each text is described by shares of character classes, word and line figures. A good and a poor document form a preference pair;
the weights maximise the logistic likelihood that the good one wins, given the difference of their figures (no intercept,
a small ridge). A document's strength is its weighted sum. The threshold is a quantile of the strengths of the training
rows: the one that gives the best balanced accuracy there. Scores are the logistic of the distance from it, shifted so
that the threshold has the score `CUT`.

The weights are fitted on at most about `SAMPLE` labelled rows, drawn by a hash of the id; every text is scored.

Defined cases: null and empty texts have zero figures and get a score like all others; labels that are null or not 0 or 1, and
documents without a label, teach nothing; several labels of one id count as their largest; if no row of one class is left, every
score is 0.5; a null id is never held out; repeated rows get the same score; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays as A
from .tables import keyed, named_id
from .units import text_chunks

U = np.uint64
SAMPLE = 20_000
PAIRS = 200_000
CUT = 0.3
CLASS = np.full(256, 10, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[32], CLASS[10], CLASS[[9, 11, 12, 13]] = 0, 1, 2, 3, 4, 5
CLASS[[ord(c) for c in ".,;:"]], CLASS[[ord(c) for c in "!?"]], CLASS[[ord(c) for c in "#*$%&@~^"]], CLASS[[ord(c) for c in "|<>{}[]\\/"]] = 6, 7, 8, 9
CLASS[128:], CLASS[:9] = 11, 12
CLASSES = 13


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each row."""
    key = np.sort(A.mix(value ^ (row.astype(U) * A.C1)))
    # rows of the distinct keys come back through the first place of each
    both = A.mix(value ^ (row.astype(U) * A.C1))
    order = np.argsort(both, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount(row[order[new]], minlength=rows)


def figures(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Figures of texts, one row each."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    kinds = np.bincount(row * CLASSES + CLASS[buf], minlength=n * CLASSES).reshape(n, CLASSES)
    size = np.maximum(np.diff(off), 1)
    w = A.Words(buf, off)
    words = w.hashes(A.FOLD)
    many = np.diff(w.first)
    at_least = np.maximum(many, 1)
    wrow = np.repeat(np.arange(n), many)
    third = A.mix(A.mix(words[:-2] * A.C1 + words[1:-1]) * A.C2 + words[2:]) if len(words) > 2 else words[:0]
    inner = wrow[:-2] == wrow[2:] if len(words) > 2 else wrow[:0] > 0
    grams = np.bincount(wrow[:-2][inner], minlength=n) if len(words) > 2 else np.zeros(n, np.int64)
    distinct_grams = _distinct(wrow[:-2][inner], third[inner], n) if len(words) > 2 else grams
    distinct_words = _distinct(wrow, words, n)
    length = np.bincount(wrow, weights=w.end - w.start, minlength=n)
    last = CLASS[buf[w.end - 1]] if len(words) else CLASS[:0]
    odd_end = np.bincount(wrow, weights=(last >= 7) & (last <= 10), minlength=n)
    stop_end = np.bincount(wrow, weights=last == 6, minlength=n)
    share = kinds / size[:, None]
    extra = np.stack([np.log1p(many), np.log1p(size), length / at_least, distinct_words / at_least, 1 - distinct_grams / np.maximum(grams, 1), odd_end / at_least,
                      stop_end / at_least, kinds[:, 4] / at_least, np.sqrt(many) / 30, (many < 50).astype(float), (many < 10).astype(float)], 1)
    return np.concatenate([share, np.sqrt(share), np.minimum(share * 50, 1), extra], axis=1).astype(np.float64)


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0) -> dict:
    """Weights from preference pairs, and the threshold."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / spread, -6, 6)
    one, zero = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    each = np.random.default_rng(0)
    d = z[each.choice(one, pairs)] - z[each.choice(zero, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance that the poor one wins
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ p - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s)
    above = 1 - np.cumsum(good[order] == 1) / len(one)
    below = np.cumsum(good[order] == 0) / len(zero)
    k = int(np.argmax(above + below))
    quantile = (k + 1) / len(s)
    cut = (s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2
    return {"mean": mean, "spread": spread, "weights": w, "cut": cut, "quantile": quantile, "scale": 4 / (np.std(s) + 1e-9)}


def scored(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    s = np.clip((x - model["mean"]) / model["spread"], -6, 6) @ model["weights"]
    far = np.clip(model["scale"] * (s - model["cut"]) + np.log(CUT / (1 - CUT)), -500, 500)
    return 1 / (1 + np.exp(-far))


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(key).cast("long").cast("string").cast("binary")) % folds


def teachers(labels: DataFrame, id_col: str, label_col: str, folds: int, held: int) -> DataFrame:
    """id and label (0 or 1) of the rows outside the held-out fold."""
    label = F.col(f"`{label_col}`").cast("int")
    found = labels.select(F.col(f"`{id_col}`").cast("long").alias("key"), label.alias("label")).filter("key IS NOT NULL AND label IN (0, 1)")
    return found.filter(fold_of("key", folds) != held).groupBy("key").agg(F.max("label").alias("label"))


def preference_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> DataFrame:
    """One row for each document: the id, held_out, score."""
    base = keyed(docs, id_col, text_col)
    known = teachers(labels, id_col, label_col, folds, held)
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / total)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_chunks(batches):
            x = figures(*A.column_bytes(text))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["label", "x"])

    taught = base.join(F.broadcast(known), "key").mapInArrow(describe, "label int, x array<double>").toPandas()  # about `sample` rows
    model = None
    if taught["label"].nunique() == 2:
        order = np.lexsort(np.stack(taught["x"]).T)
        model = fit(np.stack(taught["x"])[order], taught["label"].to_numpy()[order])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scored(figures(*A.column_bytes(text)), model))], ["key", "score"])

    out = base.mapInArrow(score, "key long, score double").withColumn("key", named_id())
    return out.select(F.col("key").alias(id_col), F.coalesce(fold_of("key", folds) == held, F.lit(False)).alias("held_out"), "score")


def op9_preference_quality(spark, sf_dir: str) -> DataFrame:
    out = preference_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
