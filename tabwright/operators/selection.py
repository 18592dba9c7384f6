"""Feature selection from small score tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from ..core import (FLOAT_TYPES, INT_TYPES, Operator, agg_row, choose_columns, detect_numeric, dtype_of, is_numeric,
                    nn, num, numeric_candidates, operator, q)
from ..profiling.correlations import anova, class_moments, correlation_matrix
from ..profiling.information import class_information, number_information
from ..stats import chi2_tail, f_tail, t_two_sided

MAX_CLASSES_FOR_CLASSIFICATION = 10


class _Selector(Operator):
    def apply(self, df, art):
        if not art.get("drop_columns", True):
            return df
        return df.drop(*art["columns_to_drop"])


@operator("VarianceThreshold")
class VarianceThreshold(_Selector):
    description = "Keep columns whose population variance exceeds the threshold"
    defaults = {"threshold": 0.0, "drop_columns": True}

    def fit(self, df, cfg):
        cols = [c for c in choose_columns(df, cfg, numeric_candidates) if is_numeric(df, c)]
        var = agg_row(df, [F.var_pop(num(df, c)) for c in cols]) if cols else []
        t = float(cfg["threshold"])
        drop = [c for c, v in zip(cols, var) if not (v is not None and v > t)]
        return {"columns_to_drop": drop, "variances": dict(zip(cols, var)), "drop_columns": cfg["drop_columns"],
                "selected_columns": [c for c in cols if c not in drop]}


@operator("CorrelationThreshold")
class CorrelationThreshold(_Selector):
    description = "Drop a column strongly correlated with an earlier one"
    defaults = {"threshold": 0.95, "drop_columns": True}

    def fit(self, df, cfg):
        cols = [c for c in choose_columns(df, cfg, detect_numeric) if is_numeric(df, c)]
        method = cfg.get("correlation_method") or "pearson"
        if len(cols) < 2:
            return {"columns_to_drop": [], "drop_columns": cfg["drop_columns"]}
        m, t = correlation_matrix(df, cols, method), float(cfg["threshold"])
        drop = [cols[j] for j in range(len(cols)) if any(abs(m[i, j]) > t for i in range(j))]
        return {"columns_to_drop": drop, "method": method, "threshold": t, "drop_columns": cfg["drop_columns"]}


def guess_problem_type(df: DataFrame, target: str) -> str:
    """Text and booleans, or at most ten distinct values: classification."""
    if isinstance(dtype_of(df, target), (T.StringType, T.BooleanType)):
        return "classification"
    few = df.select(nn(df, target).alias("v")).where("v is not null")
    approx = few.agg(F.approx_count_distinct("v", 0.02)).first()[0]
    if approx > 3 * MAX_CLASSES_FOR_CLASSIFICATION:
        return "regression"
    exact = few.distinct().limit(MAX_CLASSES_FOR_CLASSIFICATION + 1).count()
    return "classification" if exact <= MAX_CLASSES_FOR_CLASSIFICATION else "regression"


def univariate_scores(df: DataFrame, cols: list[str], target: str, score_func: str) -> dict[str, tuple]:
    """column -> (score, p). Missing feature values count as 0."""
    z = df.select(*[F.coalesce(num(df, c), F.lit(0.0)).alias(c) for c in cols], q(target).alias("__y"))
    if score_func == "f_classif":
        return anova(z, "__y", cols)
    if score_func in ("f_regression", "r_regression"):
        row = agg_row(z, [F.corr(q(c), num(z, "__y")) for c in cols] + [F.count(num(z, "__y"))])
        n, out = row[-1], {}
        for c, r in zip(cols, row):
            r = 0.0 if r is None or r != r else r
            if score_func == "r_regression":
                out[c] = (r, math.nan)
            else:
                f = r * r * (n - 2) / (1 - r * r) if r * r < 1 else math.inf
                out[c] = (f, f_tail(f, 1, n - 2) if f < math.inf else 0.0)
        return out
    if score_func == "chi2":
        return _chi2_scores(z, cols)
    if score_func in ("mutual_info_classif", "mutual_info_regression"):
        info = class_information if score_func == "mutual_info_classif" else number_information
        return {c: (v, math.nan) for c, v in info(z, cols, "__y").items()}
    if score_func in ("binned_mutual_info_classif", "binned_mutual_info_regression"):
        return {c: (v, math.nan) for c, v in binned_mutual_information(
            z, cols, "__y", score_func == "binned_mutual_info_regression").items()}
    raise ValueError(f"unknown score {score_func!r}")


def _chi2_scores(z: DataFrame, cols: list[str]) -> dict[str, tuple]:
    lo_hi = agg_row(z, [e for c in cols for e in (F.min(c), F.max(c))])
    low, high = lo_hi[0::2], lo_hi[1::2]
    if any(v is not None and v < 0 for v in low):
        z = z.select(*[((q(c) - F.lit(a)) / F.lit((b - a) or 1.0)).alias(c) for c, a, b in zip(cols, low, high)], "__y")
    # class sums stay on the cluster, however many classes there are; the statistic is a second aggregate over them
    sums = z.groupBy(q("__y").cast("string").alias("y")).agg(F.count("*").alias("n"), *[F.sum(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).persist()
    try:
        classes, n, *totals = agg_row(sums, [F.count("*"), F.sum("n"), *[F.sum(f"s{i}") for i in range(len(cols))]])
        live = [i for i, t in enumerate(totals) if t is not None and t > 0]
        expected = {i: F.col("n") * F.lit(float(totals[i]) / float(n)) for i in live}
        stats = dict(zip(live, agg_row(sums, [F.sum(F.pow(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) - expected[i], F.lit(2.0)) / expected[i]) for i in live]))) if live else {}
    finally:
        sums.unpersist()
    return {c: (stats[i], chi2_tail(stats[i], classes - 1)) if i in stats else (0.0, 1.0) for i, c in enumerate(cols)}


def binned_mutual_information(df: DataFrame, cols: list[str], target: str, numeric_target: bool,
                              bins: int = 10) -> dict[str, float]:
    """Plug-in mutual information (nats) of quantile bins with the target's classes or bins."""
    from ..plans.quantiles import column_quantiles
    probs = [i / bins for i in range(bins + 1)]
    edges = {c: sorted(set(v)) for c, v in column_quantiles(
        df, cols + ([target] if numeric_target else []), probs).items()}

    def bin_of(c):
        e = F.lit(0)
        for i, b in enumerate(edges[c][1:-1]):
            e = F.when(num(df, c) > F.lit(b), F.lit(i + 1)).otherwise(e)
        return e
    y = bin_of(target).cast("string") if numeric_target else q(target).cast("string")
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), bin_of(c).alias("b")) for c in cols])
    cells = (df.select(F.explode(pairs).alias("p"), y.alias("y")).groupBy("p.c", "p.b", "y")
             .agg(F.count("*").alias("n")).collect())  # columns x bins x classes
    out = {}
    for c in cols:
        mine = [r for r in cells if r["c"] == c]
        n = sum(r["n"] for r in mine)
        bx, by = {}, {}
        for r in mine:
            bx[r["b"]] = bx.get(r["b"], 0) + r["n"]
            by[r["y"]] = by.get(r["y"], 0) + r["n"]
        out[c] = max(0.0, sum(r["n"] / n * math.log(r["n"] * n / (bx[r["b"]] * by[r["y"]])) for r in mine))
    return out


def pick_univariate(scores: dict[str, tuple], method: str, cfg: dict) -> list[str]:
    """Columns chosen by score or p-value, in table order."""
    cols = list(scores)
    val = {c: (0.0 if s != s or math.isinf(s) else s) for c, (s, _) in scores.items()}
    pv = {c: (1.0 if p != p else p) for c, (_, p) in scores.items()}
    alpha = float(cfg.get("alpha", 0.05))
    if method == "select_k_best":
        k = len(cols) if cfg.get("k", 10) == "all" else int(cfg.get("k", 10))
        best = sorted(cols, key=lambda c: (-val[c], -cols.index(c)))[:k]
        return [c for c in cols if c in best]
    if method == "select_percentile":
        share = float(cfg.get("percentile", 10))
        if share >= 100:
            return cols
        vals = sorted(val.values())
        h = (100 - share) / 100 * (len(vals) - 1)
        lo = int(math.floor(h))
        cut = vals[lo] + (vals[min(lo + 1, len(vals) - 1)] - vals[lo]) * (h - lo)
        keep = [c for c in cols if val[c] > cut]
        ties = [c for c in cols if val[c] == cut][:max(0, int(len(cols) * share / 100) - len(keep))]
        return [c for c in cols if c in keep or c in ties]
    if method == "select_fpr":
        return [c for c in cols if pv[c] < alpha]
    if method == "select_fwe":
        return [c for c in cols if pv[c] < alpha / len(cols)]
    if method == "select_fdr":
        ranked = sorted(pv.values())
        ok = [p for i, p in enumerate(ranked) if p <= alpha * (i + 1) / len(ranked)]
        return [c for c in cols if ok and pv[c] <= max(ok)]
    if method == "generic_univariate_select":
        mode = cfg.get("mode", "k_best")
        param = cfg.get("param")
        inner = {"k_best": ("select_k_best", "k", 10), "percentile": ("select_percentile", "percentile", 10),
                 "fpr": ("select_fpr", "alpha", 0.05), "fdr": ("select_fdr", "alpha", 0.05),
                 "fwe": ("select_fwe", "alpha", 0.05)}[mode]
        return pick_univariate(scores, inner[0], {inner[1]: cfg.get(inner[1], inner[2]) if param is None else param})
    raise ValueError(f"unknown method {method!r}")


METHOD_NAMES = ["select_k_best", "select_percentile", "select_fpr", "select_fdr", "select_fwe",
                "generic_univariate_select"]


@operator("UnivariateSelection")
class UnivariateSelection(_Selector):
    description = "Keep columns by a score against the target"
    defaults = {"method": "select_k_best", "score_func": None, "drop_columns": True}

    def fit(self, df, cfg):
        target = cfg.get("target_column")
        cols = [c for c in choose_columns(df, cfg, numeric_candidates) if c != target and is_numeric(df, c)]
        if not target or not cols:
            return {"selected_columns": cols, "columns_to_drop": [], "scores": {}, "pvalues": {},
                    "drop_columns": cfg["drop_columns"]}
        plain = {m.replace("_", ""): m for m in METHOD_NAMES}
        method = plain.get(cfg["method"].lower().replace("_", ""), cfg["method"])
        score = cfg.get("score_func")
        if not score:
            kind = cfg.get("problem_type") or "auto"
            kind = guess_problem_type(df, target) if kind == "auto" else kind
            score = "f_classif" if kind == "classification" else "f_regression"
        scores = univariate_scores(df, cols, target, score)
        keep = pick_univariate(scores, method, cfg)
        return {"selected_columns": keep, "columns_to_drop": [c for c in cols if c not in keep],
                "scores": {c: s for c, (s, _) in scores.items()},
                "pvalues": {c: p for c, (_, p) in scores.items()},
                "method": method, "score_func": score, "drop_columns": cfg["drop_columns"]}


def importances(df: DataFrame, cols: list[str], target: str, estimator: str, problem: str, cells=None) -> dict[str, float]:
    from ..models.learners import fit_model
    if cells is not None:
        from ..models.counted_forest import forest_importances
        return forest_importances(df.sparkSession, cells.only(cols))
    name = {"auto": "logistic_regression" if problem == "classification" else "linear_regression",
            "logisticregression": "logistic_regression", "linearregression": "linear_regression",
            "randomforest": "random_forest", "random_forest": "random_forest"}.get(estimator, estimator)
    params = {}
    if name == "random_forest":
        name = "random_forest_classifier" if problem == "classification" else "random_forest_regressor"
        params = {"n_estimators": 100, "random_state": 0}
    m = fit_model(name, df, cols, target, **params)
    return m.importances()


@operator("ModelBasedSelection")
class ModelBasedSelection(_Selector):
    description = "Keep columns by model importance, at once or by repeated elimination"
    defaults = {"method": "select_from_model", "estimator": "auto", "threshold": "mean", "drop_columns": True,
                "max_features": None, "n_features_to_select": None, "step": 1}

    def fit(self, df, cfg):
        target = cfg["target_column"]
        cols = [c for c in choose_columns(df, cfg, numeric_candidates) if c != target and is_numeric(df, c)]
        problem = cfg.get("problem_type") or "auto"
        problem = guess_problem_type(df, target) if problem == "auto" else problem
        z = df.select(*[F.coalesce(num(df, c), F.lit(0.0)).alias(c) for c in cols], q(target))
        est = str(cfg["estimator"]).lower()
        cells = None
        if est in ("random_forest", "randomforest") and problem == "classification" and cols:
            from ..models.counted_forest import counted
            cells = counted(z, cols, target)
        z = z if cells else z.persist()
        try:
            if cfg["method"] == "rfe":
                n = cfg["n_features_to_select"]
                n = max(1, len(cols) // 2) if n is None else (int(n) if float(n) >= 1 else max(1, int(len(cols) * n)))
                step = float(cfg["step"])
                step = max(1, int(step * len(cols))) if step < 1 else int(step)
                left = list(cols)
                while len(left) > n:
                    imp = importances(z, left, target, est, problem, cells)
                    weak = sorted(left, key=lambda c: (imp[c] ** 2, left.index(c)))[:min(step, len(left) - n)]
                    left = [c for c in left if c not in weak]
                imp = importances(z, left, target, est, problem, cells)
                keep = left
            else:
                imp = importances(z, cols, target, est, problem, cells)
                cut = threshold_value(cfg["threshold"], list(imp.values()))
                keep = [c for c in cols if imp[c] >= cut]
                if cfg["max_features"]:
                    top = sorted(keep, key=lambda c: -imp[c])[:int(cfg["max_features"])]
                    keep = [c for c in keep if c in top]
        finally:
            if not cells:
                z.unpersist()
        return {"selected_columns": keep, "columns_to_drop": [c for c in cols if c not in keep],
                "importances": imp, "drop_columns": cfg["drop_columns"]}


def threshold_value(t, values: list[float]) -> float:
    """A number, ``mean``, ``median`` or a multiple such as ``1.25*mean``."""
    try:
        return float(t)
    except (TypeError, ValueError):
        pass
    scale, _, ref = str(t).rpartition("*")
    s = sorted(values)
    mid = len(s) // 2
    base = sum(s) / len(s) if ref.strip() == "mean" else (s[mid] if len(s) % 2 else (s[mid - 1] + s[mid]) / 2)
    return (float(scale) if scale else 1.0) * base


@operator("FeatureSelection")
class FeatureSelection(_Selector):
    """Name-to-operator front for the selectors above."""

    description = "Any selector by method name"
    defaults = {"method": "select_k_best"}

    def fit(self, df, cfg):
        from ..core import get_operator
        m = cfg["method"]
        name = {"variance_threshold": "VarianceThreshold", "variance": "VarianceThreshold",
                "correlation_threshold": "CorrelationThreshold", "select_from_model": "ModelBasedSelection",
                "rfe": "ModelBasedSelection"}.get(m, "UnivariateSelection")
        op = get_operator(name)
        return op.fit(df, {**op.defaults, **cfg})
