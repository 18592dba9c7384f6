"""Grid, random and halving search."""

from __future__ import annotations

import itertools
import math
import random
from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.splitting import hash_order, smallest
from .learners import Model, fit_model
from .validation import cross_validate, kept

LOWER_IS_BETTER = {"mae", "mse", "rmse", "mape", "log_loss", "davies_bouldin_score"}


def grid_candidates(space: dict) -> list[dict]:
    keys = sorted(space)
    return [dict(zip(keys, v)) for v in itertools.product(*[space[k] for k in keys])]


def random_candidates(space: dict, n: int, seed: int = 42) -> list[dict]:
    rng, every = random.Random(seed), grid_candidates(space)
    return every if n >= len(every) else rng.sample(every, n)


def _score(name, df, features, target, keys, params, metric, cv, seed, cv_type):
    agg = cross_validate(name, df, features, target, keys, cv, cv_type, None, seed, **params)["aggregated_metrics"]
    v = agg[metric]["mean"] if metric in agg else -math.inf
    return -v if metric in LOWER_IS_BETTER else v


def search(name: str, df: DataFrame, features, target, keys: Sequence[str], space: dict, strategy: str = "grid",
           n_trials: int = 10, metric: str = "accuracy", cv: int = 5, seed: int = 42, factor: int = 3,
           cv_type: str = "k_fold", parallelism: int = 2) -> dict:
    """Best candidate by cross-validation, refitted on all rows.

    Halving gives all candidates a small share of the rows first (a cut of the key-hash order),
    keeps one in ``factor`` and multiplies the rows by ``factor``.
    """
    cands = random_candidates(space, n_trials, seed) if "random" in strategy else grid_candidates(space)
    data = df.persist()
    trials: list[dict] = []
    try:
        def run(frame, params_list, rows):
            # jobs of several candidates share the cluster; each is a set of ordinary Spark jobs
            with kept(frame), ThreadPoolExecutor(parallelism) as pool:
                got = list(pool.map(lambda p: _score(name, frame, features, target, keys, p, metric, cv, seed, cv_type), params_list))
            out = [{"params": p, "score": s, "rows": rows} for p, s in zip(params_list, got)]
            trials.extend(out)
            return sorted(out, key=lambda t: -t["score"])
        n = data.count()
        if "halving" in strategy:
            rounds = max(1, math.ceil(math.log(len(cands), factor))) if len(cands) > 1 else 0
            rows, ranked = max(min(n, 20 * cv), n // factor ** rounds), [{"params": c} for c in cands]
            while True:
                sub = data if rows >= n else data.where(smallest(data, hash_order(list(keys), seed), rows, n))
                ranked = run(sub, [t["params"] for t in ranked], min(rows, n))
                if len(ranked) == 1 or rows >= n:
                    break
                ranked = ranked[:max(1, math.ceil(len(ranked) / factor))]
                rows *= factor
        else:
            ranked = run(data, cands, n)
        best = ranked[0]
        model: Model = fit_model(name, data, features, target, **best["params"])
    finally:
        data.unpersist()
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    for t in trials:
        t["score"] *= sign
    return {"best_params": best["params"], "best_score": best["score"], "trials": trials, "model": model}
