"""Cross-validation on hash folds, time blocks and nested folds."""

from __future__ import annotations

import math
from contextlib import contextmanager
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..core import q
from ..operators.splitting import exact_folds, hash_folds, hash_order, smallest, time_blocks
from .evaluation import evaluate
from .learners import fit_model


def summarise(folds: list[dict[str, float]]) -> dict[str, dict[str, float]]:
    """mean, std (n-1), min and max per metric over folds, non-finite values left out."""
    out = {}
    for k in sorted({k for f in folds for k in f}):
        v = [f[k] for f in folds if k in f and f[k] is not None and math.isfinite(f[k])]
        if v:
            m = sum(v) / len(v)
            std = math.sqrt(sum((x - m) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else 0.0
            out[k] = {"mean": m, "std": std, "min": min(v), "max": max(v)}
    return out


def fold_pairs(df: DataFrame, cv_type: str, n_folds: int, keys: Sequence[str], target: str | None = None,
               time_column: str | None = None, seed: int = 42, test_size: float = 0.2):
    """Yield (train, test) frames."""
    if cv_type in ("time_series_split", "time_series"):
        d = time_blocks(df, time_column, n_folds, "__block")
        for i in range(1, n_folds + 1):
            yield d.where(F.col("__block") < i).drop("__block"), d.where(F.col("__block") == i).drop("__block")
    elif cv_type == "shuffle_split":
        n = df.count()
        for i in range(n_folds):
            cond = smallest(df, hash_order(list(keys), seed + 17 * i), math.ceil(n * test_size), n)
            yield df.where(~cond), df.where(cond)
    else:
        strat = target if cv_type.startswith("stratified") else None
        d = hash_folds(df, list(keys), n_folds, seed, strat, "__fold")
        for i in range(n_folds):
            yield d.where(F.col("__fold") != i).drop("__fold"), d.where(F.col("__fold") == i).drop("__fold")


@contextmanager
def kept(df: DataFrame):
    """The frame, persisted for the block. What is kept already stays kept, for whoever keeps it is not done with it."""
    level = df.storageLevel
    mine = not (level.useMemory or level.useDisk)
    if mine:
        df = df.persist()
    try:
        yield df
    finally:
        if mine:
            df.unpersist()


def cross_validate(name: str, df: DataFrame, features, target, keys: Sequence[str], n_folds: int = 5, cv_type: str = "k_fold",
                   time_column: str | None = None, seed: int = 42, **params) -> dict:
    with kept(df) as base:
        folds = []
        for train, test in fold_pairs(base, cv_type, n_folds, keys, target, time_column, seed):
            folds.append(evaluate(fit_model(name, train, features, target, **params), test))
    return {"folds": folds, "aggregated_metrics": summarise(folds), "cv_config": {"n_folds": n_folds, "cv_type": cv_type}}


def nested_cross_validate(name, df, features, target, keys, outer: int = 5, inner: int = 3, metric: str = "accuracy",
                          grid: Sequence[dict] = ({},), seed: int = 42) -> dict:
    """Inner folds choose the parameters, outer folds score them."""
    folds, inner_scores = [], []
    base = df.persist()
    try:
        for train, test in fold_pairs(base, "k_fold", outer, keys, target, None, seed):
            with kept(train):
                scored = []
                for params in grid:
                    cv = cross_validate(name, train, features, target, keys, inner, "k_fold", None, seed + 1, **params)
                    scored.append((cv["aggregated_metrics"][metric]["mean"], params))
            best = max(scored, key=lambda s: s[0])
            inner_scores.append(best[0])
            folds.append(evaluate(fit_model(name, train, features, target, **best[1]), test))
    finally:
        base.unpersist()
    return {"folds": folds, "inner_scores": inner_scores, "aggregated_metrics": summarise(folds)}
