"""Multivariate summaries of a table: components, segments, anomalies, rules."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, functions as F

from ..core import agg_row, num, q
from ..plans.quantiles import quantiles_of
from .learners import assemble, class_list, fit_model, label_index
from .trees import tree_nodes, tree_rules


def _standardised(df: DataFrame, cols: Sequence[str]):
    row = agg_row(df, [e for c in cols for e in (F.avg(num(df, c)), F.stddev_pop(num(df, c)))])
    mean, std = row[0::2], [s or 1.0 for s in row[1::2]]
    z = df.select("*", *[((F.coalesce(num(df, c), F.lit(m)) - F.lit(m)) / F.lit(s)).alias(f"__z{i}")
                         for i, (c, m, s) in enumerate(zip(cols, mean, std))])
    return assemble(z, [f"__z{i}" for i in range(len(cols))]), mean, std


def pca_summary(df: DataFrame, cols: Sequence[str], components: int = 3, top: int = 5) -> list[dict]:
    """Components of all rows: explained share and the largest loadings."""
    data, _, _ = _standardised(df, cols)
    k = min(components, len(cols))
    m = PCA(k=k, inputCol="__x", outputCol="__pc").fit(data.select("__x"))
    load, share = m.pc.toArray(), m.explainedVariance.toArray()
    out = []
    for j in range(k):
        order = np.argsort(-np.abs(load[:, j]))[:top]
        out.append({"component": j + 1, "explained": float(share[j]),
                    "loadings": {cols[i]: float(load[i, j]) for i in order}})
    return out


def pca_points(df: DataFrame, cols: Sequence[str], components: int = 3) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    data, _, _ = _standardised(df, cols)
    m = PCA(k=min(components, len(cols)), inputCol="__x", outputCol="__pc").fit(data.select("__x"))
    a = vector_to_array("__pc")
    return m.transform(data).select(*[q(c) for c in df.columns], *[a[i].alias(f"pc{i + 1}") for i in range(m.getK())])


def segmentation(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42) -> list[dict]:
    data, mean, std = _standardised(df, cols)
    m = KMeans(k=k, featuresCol="__x", predictionCol="__g", seed=seed).fit(data.select("__x"))
    sizes = {r["__g"]: r["count"] for r in m.transform(data.select("__x")).groupBy("__g").count().collect()}
    n = sum(sizes.values())
    return [{"cluster": i, "size": sizes.get(i, 0), "share": sizes.get(i, 0) / n,
             "center": {c: float(v * s + mu) for c, v, s, mu in zip(cols, centre, std, mean)}}
            for i, centre in enumerate(m.clusterCenters())]


# --- isolation forest ------------------------------------------------------------------------

def _average_path(n: float) -> float:
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n if n > 2 else 1.0


def _grow(x: np.ndarray, depth: int, limit: int, rng) -> dict:
    if depth >= limit or len(x) <= 1:
        return {"len": depth + _average_path(len(x))}
    lo, hi = x.min(axis=0), x.max(axis=0)
    live = np.nonzero(hi > lo)[0]
    if not len(live):
        return {"len": depth + _average_path(len(x))}
    f = int(rng.choice(live))
    t = float(rng.uniform(lo[f], hi[f]))
    left = x[:, f] < t
    return {"f": f, "t": t, "l": _grow(x[left], depth + 1, limit, rng), "r": _grow(x[~left], depth + 1, limit, rng)}


def _path(node: dict, x: np.ndarray) -> np.ndarray:
    if "len" in node:
        return np.full(len(x), node["len"])
    out = np.empty(len(x))
    left = x[:, node["f"]] < node["t"]
    out[left], out[~left] = _path(node["l"], x[left]), _path(node["r"], x[~left])
    return out


def isolation_forest(df: DataFrame, cols: Sequence[str], key: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42):
    """Trees grown in parallel tasks, each on its own 256-row sample; the sampled forest is the
    method. Rows are dealt to trees by hash, cut to the sample size inside hash salts first."""
    import json
    from pyspark.sql import Window as W
    n = df.count()
    means = agg_row(df, [F.avg(num(df, c)) for c in cols])
    vals = df.select(*[q(k) for k in key], *[F.coalesce(num(df, c), F.lit(m)).alias(f"f{i}") for i, (c, m) in enumerate(zip(cols, means))])
    share = min(1.0, 4.0 * trees * sample / max(n, 1))
    keys = [q(k) for k in key]
    picked = vals.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < F.lit(int(math.ceil(share * 1_000_000))))
    copies = max(1, math.ceil(trees * sample / max(1, int(n * share))))
    dealt = picked.withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn(
        "__t", F.pmod(F.xxhash64(F.lit(seed + 1), "__c", *keys), F.lit(trees)).cast("int"))
    w = W.partitionBy("__t").orderBy(F.xxhash64(F.lit(seed + 2), "__c", *keys))
    dealt = dealt.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= sample)
    names = [f"f{i}" for i in range(len(cols))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["__t"].iloc[0])
        x = pdf.sort_values("__r")[names].to_numpy(dtype="float64")
        tree = _grow(x, 0, int(math.ceil(math.log2(max(2, len(x))))), np.random.RandomState(seed + t))
        return pd.DataFrame({"size": [len(x)], "tree": [json.dumps(tree)]})
    rows = dealt.groupBy("__t").applyInPandas(grow, "size int, tree string").collect()  # one row per tree
    forest = [json.loads(r["tree"]) for r in rows]
    norm = _average_path(float(np.mean([r["size"] for r in rows])))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(dtype="float64") for p in parts])
        depth = np.mean([_path(t, x) for t in shared.value], axis=0)
        return pd.Series(np.power(2.0, -depth / norm))
    filled = [F.coalesce(num(df, c), F.lit(m)) for c, m in zip(cols, means)]
    return df.withColumn("anomaly_score", score(*filled))


def outlier_report(df: DataFrame, cols: Sequence[str], key: Sequence[str], contamination: float = 0.05, top: int = 20) -> dict:
    """Outlier count and the most isolated rows with the features far from their median."""
    scored = isolation_forest(df, cols, key).persist()
    try:
        _, (vals,) = quantiles_of(scored, [F.col("anomaly_score")], [1.0 - contamination])
        meds = quantiles_of(df, [num(df, c) for c in cols], [0.5])[1]
        n = scored.where(F.col("anomaly_score") > F.lit(vals[0])).count()
        rows = []
        for r in scored.orderBy(F.desc("anomaly_score"), *[q(k) for k in key]).limit(top).collect():
            odd = [c for c, (m,) in zip(cols, meds) if r[c] is not None and abs(r[c] - m) > 0.5 * max(abs(m), 1e-9)]
            rows.append({**{k: r[k] for k in key}, "score": r["anomaly_score"], "features": odd})
        return {"outliers": n, "threshold": vals[0], "top": rows}
    finally:
        scored.unpersist()


def surrogate_rules(df: DataFrame, cols: Sequence[str], target: str, task: str | None = None, max_depth: int = 4, max_classes: int | None = None) -> dict:
    """Rules and importances of a shallow tree."""
    from ..operators.selection import guess_problem_type
    task = task or guess_problem_type(df, target)
    means = agg_row(df, [F.avg(num(df, c)) for c in cols])
    d = df.select(*[F.coalesce(num(df, c), F.lit(m or 0.0)).alias(c) for c, m in zip(cols, means)], q(target))
    if task == "classification":
        if max_classes is not None and d.select(q(target)).distinct().limit(max_classes + 1).count() > max_classes:
            raise ValueError(f"{target} has more than {max_classes} classes")
        m = fit_model("decision_tree_classifier", d, list(cols), target, max_depth=max_depth)
        label = lambda v: m.classes[int(v)]
    else:
        m = fit_model("decision_tree_regressor", d, list(cols), target, max_depth=max_depth)
        label = lambda v: f"{v:.4f}"
    return {"rules": tree_rules(tree_nodes(m.parts[0]), list(cols), label), "importances": m.importances(), "task": task}
