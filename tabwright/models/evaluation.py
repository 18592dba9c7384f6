"""Evaluation from grouped counts: no prediction column is ever gathered."""

from __future__ import annotations

import math
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import agg_row, num, q
from ..plans.ordered import running_totals, segmented_totals
from ..plans.textorder import number_sorted
from ..session import cut_lineage


#: predicted classes in one row of the grid before it is laid out, and class names that may be broadcast
GRID_RANGE, NAMED_CLASSES = 4_096, 1_000_000


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return (df.groupBy(q(label).cast("string").alias("actual"), q(prediction).cast("string").alias("predicted"))
            .agg(F.count("*").alias("count")))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, count) over the full grid of class values, built on the cluster.

    The grid is as large as its definition says (classes squared); ``confusion_counts`` has the occupied cells only. Cells with
    a null class follow as they occur.
    """
    c = cut_lineage(confusion_counts(df, label, prediction))
    classes = c.select(F.explode(F.array("actual", "predicted")).alias("actual")).where("actual is not null").distinct()
    numbered = cut_lineage(number_sorted(classes, "actual").select("actual", F.col("code").cast("int").alias("code")))
    k = numbered.count()
    # empty cells are listed row by row of the grid, in ranges of predicted classes: only occupied cells are ever shuffled.
    # a partition takes range after range, so that a file holds few class names at a time and stays small
    names = numbered.select(F.col("actual").alias("predicted"), "code")
    taken = c.where("actual is not null and predicted is not null").join(names, "predicted")
    taken = taken.groupBy("actual", F.floor(F.col("code") / GRID_RANGE).cast("int").alias("range")).agg(F.collect_set("code").alias("taken"))
    ranges = numbered.select("actual", F.explode(F.sequence(F.lit(0), F.lit(max(k - 1, 0) // GRID_RANGE))).alias("range")).join(taken, ["actual", "range"], "left").sortWithinPartitions("range", "actual")
    first = F.col("range") * GRID_RANGE
    every = F.sequence(first, F.least(first + GRID_RANGE, F.lit(k)) - 1)
    empty = ranges.select("actual", F.explode(F.array_except(every, F.coalesce("taken", F.array().cast("array<int>")))).alias("code"))
    empty = empty.join(F.broadcast(names) if k <= NAMED_CLASSES else names, "code")
    return c.select("actual", "predicted", "count").unionByName(empty.select("actual", "predicted", F.lit(0).cast("long").alias("count")))


def metrics_from_counts(cells: dict[tuple[str, str], float], positive: str | None = None) -> dict[str, float]:
    """All label-based metrics of one confusion table."""
    classes = sorted({a for a, _ in cells} | {p for _, p in cells})
    n = sum(cells.values())
    t = {c: sum(v for (a, _), v in cells.items() if a == c) for c in classes}
    p = {c: sum(v for (_, b), v in cells.items() if b == c) for c in classes}
    hit = {c: cells.get((c, c), 0) for c in classes}
    prec = {c: hit[c] / p[c] if p[c] else 0.0 for c in classes}
    rec = {c: hit[c] / t[c] if t[c] else 0.0 for c in classes}
    f1 = {c: 2 * prec[c] * rec[c] / (prec[c] + rec[c]) if prec[c] + rec[c] else 0.0 for c in classes}
    w = {c: t[c] / n for c in classes}
    right = sum(hit.values())
    cov = right * n - sum(t[c] * p[c] for c in classes)
    den = math.sqrt((n * n - sum(v * v for v in p.values())) * (n * n - sum(v * v for v in t.values())))
    present = [c for c in classes if t[c]]
    spec = {c: (n - t[c] - p[c] + hit[c]) / (n - t[c]) if n - t[c] else 0.0 for c in classes}
    out = {
        "accuracy": right / n,
        "balanced_accuracy": sum(rec[c] for c in present) / len(present),
        "precision_weighted": sum(w[c] * prec[c] for c in classes),
        "recall_weighted": sum(w[c] * rec[c] for c in classes),
        "f1_weighted": sum(w[c] * f1[c] for c in classes),
        "matthews_corrcoef": cov / den if den else 0.0,
        "g_score": math.sqrt(sum(w[c] * rec[c] for c in classes) * sum(w[c] * spec[c] for c in classes)),
    }
    if len(present) == 2:
        pos = positive if positive in present else present[-1]
        out.update(precision=prec[pos], recall=rec[pos], f1=f1[pos])
    return out


def classification_metrics(df: DataFrame, label: str, prediction: str, positive: str | None = None) -> DataFrame:
    """(metric, value)."""
    cells = {(r["actual"], r["predicted"]): r["count"] for r in confusion_counts(df, label, prediction).collect()}
    rows = [(k, float(v)) for k, v in metrics_from_counts(cells, positive).items()]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def log_loss(df: DataFrame, label: str, probability: str, classes: Sequence[str]) -> float:
    eps = np.finfo("float64").eps
    p = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        p = F.when(q(label).cast("string") == F.lit(c), q(probability)[i]).otherwise(p)
    return df.agg(F.avg(-F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))))).first()[0]


def score_table(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """(s, pos, neg) per distinct score."""
    d = df.select(score.cast("double").alias("s"), positive.cast("double").alias("p")).na.drop()
    return d.groupBy("s").agg(F.sum("p").alias("pos"), F.sum(1.0 - F.col("p")).alias("neg"))


def binary_areas(df: DataFrame, positive: Column, score: Column) -> dict[str, float]:
    """ROC-AUC by the rank formula with ties, PR-AUC as average precision."""
    t = score_table(df, positive, score)
    P, N, m = t.agg(F.sum("pos"), F.sum("neg"), F.count("*")).first()
    if not P or not N:
        return {"roc_auc": math.nan, "pr_auc": math.nan}
    r = running_totals(t, "s", ["pos", "neg"], n=m)
    tp = F.lit(P) - F.col("cum_pos") + F.col("pos")
    fp = F.lit(N) - F.col("cum_neg") + F.col("neg")
    auc, ap = r.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)) / F.lit(P * N),
                    F.sum(F.col("pos") / F.lit(P) * tp / (tp + fp))).first()
    return {"roc_auc": auc, "pr_auc": ap}


def multiclass_areas(df: DataFrame, label: str, probability: str, classes: Sequence[str]) -> dict[str, float]:
    """One-vs-rest and one-vs-one areas.

    The scores of all classes are counted by true class, and running totals of these counts within a score's
    class hold every rank sum: of each class against each other and against the rest. Two jobs' worth of
    plan whatever the number of classes.
    """
    y, k = q(label).cast("string"), len(classes)
    counts = {r["y"]: r["n"] for r in df.groupBy(y.alias("y")).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    w = {c: counts.get(c, 0) / n for c in classes}
    items = F.array(*[F.struct(F.lit(i).alias("i"), q(probability)[i].cast("double").alias("v")) for i in range(k)])
    long = df.where(y.isNotNull()).select(y.alias("y"), F.explode(items).alias("t")).select("y", "t.i", "t.v").where("v IS NOT NULL AND NOT isnan(v)")
    seen = [f"n{j}" for j in range(k)]
    table = long.groupBy("i", "v").agg(F.count("*").alias("every"), *[F.count_if(F.col("y") == F.lit(c)).alias(f"n{j}") for j, c in enumerate(classes)])
    sizes = cut_lineage(long.groupBy("i").agg(F.count("*").alias("__n"), *[F.count_if(F.col("y") == F.lit(c)).alias(f"all{j}") for j, c in enumerate(classes)]))
    run = segmented_totals(table, ["i"], "v", ["every", *seen], sizes=sizes).join(F.broadcast(sizes), "i")  # a row for each class
    mine = lambda p: F.get(F.array(*[F.col(f"{p}{j}") for j in range(k)]), F.col("i")).cast("double")
    run = run.withColumn("own", mine("n")).withColumn("own_cum", mine("cum_n")).withColumn("own_all", mine("all"))
    tp = F.col("own_all") - F.col("own_cum") + F.col("own")
    called = F.col("__n") - F.col("cum_every") + F.col("every")
    below = lambda j: F.sum(F.col("own") * (F.col(f"cum_n{j}") - F.col(f"n{j}") / 2.0)).alias(f"u{j}")
    rest = F.sum(F.col("own") * (F.col("cum_every") - F.col("own_cum") - (F.col("every") - F.col("own")) / 2.0)).alias("rest")
    ap = F.sum(F.col("own") / F.col("own_all") * tp / called).alias("ap")
    got = {r["i"]: r for r in run.groupBy("i").agg(rest, ap, F.first("__n").alias("total"), *[F.first(f"all{j}").alias(f"all{j}") for j in range(k)], *[below(j) for j in range(k)]).collect()}

    def area(u, a, b):
        return u / (a * b) if a and b else math.nan
    one, ap_of, against = [], [], {}
    for i in range(k):
        r = got.get(i)
        a = r[f"all{i}"] if r else 0
        one.append(area(r["rest"], a, r["total"] - a) if r else math.nan)
        ap_of.append(r["ap"] if r and a and r["total"] > a else math.nan)
        against.update({(i, j): area(r[f"u{j}"], a, r[f"all{j}"]) if r else math.nan for j in range(k) if j != i})
    out = {"roc_auc_ovr": sum(one) / k,
           "roc_auc_ovr_weighted": sum(w[c] * v for c, v in zip(classes, one)),
           "pr_auc_weighted": sum(w[c] * v for c, v in zip(classes, ap_of))}
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    areas = [(against[i, j] + against[j, i]) / 2 for i, j in pairs]
    shares = [(counts.get(classes[i], 0) + counts.get(classes[j], 0)) / n for i, j in pairs]
    out["roc_auc_ovo"] = sum(areas) / len(areas)
    out["roc_auc_ovo_weighted"] = sum(p * s for p, s in zip(areas, shares)) / sum(shares)
    out["roc_auc_weighted"] = out["roc_auc_ovr_weighted"]
    return out


def curve_points(df: DataFrame, positive: Column, score: Column, limit: int = 1000) -> DataFrame:
    """(threshold, fpr, tpr, precision): ROC and PR points, at most ``limit`` evenly spaced ones."""
    t = score_table(df, positive, score).withColumn("k", F.lit(1.0))
    P, N, m = t.agg(F.sum("pos"), F.sum("neg"), F.count("*")).first()
    r = running_totals(t, "s", ["pos", "neg", "k"], n=m)
    tp = F.lit(P) - F.col("cum_pos") + F.col("pos")
    fp = F.lit(N) - F.col("cum_neg") + F.col("neg")
    step = max(1, math.ceil(m / limit))
    keep = ((F.col("cum_k").cast("bigint") - 1) % step == 0) | (F.col("cum_k") == m)
    return r.where(keep).select(F.col("s").alias("threshold"), (fp / F.lit(N)).alias("fpr"), (tp / F.lit(P)).alias("tpr"),
                                (tp / (tp + fp)).alias("precision"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = num(df, label), num(df, prediction)
    mean = df.agg(F.avg(y)).first()[0]
    e = y - p
    eps = np.finfo("float64").eps
    mae, mse, sst, mape, var_e, var_y = agg_row(df, [
        F.avg(F.abs(e)), F.avg(e * e), F.avg((y - F.lit(mean)) * (y - F.lit(mean))),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(eps))), F.var_pop(e), F.var_pop(y)])
    rows = {"mae": mae, "mse": mse, "rmse": math.sqrt(mse), "r2": 1.0 - mse / sst if sst else (1.0 if mse == 0 else 0.0),
            "mape": mape, "explained_variance": 1.0 - var_e / var_y if var_y else (1.0 if var_e == 0 else 0.0)}
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in rows.items()], "metric string, value double")


def residual_sample(df: DataFrame, label: str, prediction: str, key: list[str], n: int = 1000) -> DataFrame:
    from ..operators.rows import sample_rows
    return sample_rows(df, n, key).select(*[q(k) for k in key], q(label).alias("actual"), q(prediction).alias("predicted"),
                                          (q(label) - q(prediction)).alias("residual"))


# --- clustering ------------------------------------------------------------------------------

def cluster_scores(df: DataFrame, cluster: str, features: Sequence[str]) -> dict[str, float]:
    """Calinski-Harabasz and Davies-Bouldin from centroids, two aggregations."""
    g = (df.groupBy(q(cluster).alias("g")).agg(F.count("*").alias("n"), *[F.avg(num(df, c)).alias(f"m{i}") for i, c in enumerate(features)])
         .collect())
    k, n = len(g), sum(r["n"] for r in g)
    if not 1 < k < n:
        return {}
    cent = {r["g"]: np.array([r[f"m{i}"] for i in range(len(features))]) for r in g}
    size = {r["g"]: r["n"] for r in g}
    mean = sum(cent[c] * size[c] for c in cent) / n
    sq = F.lit(0.0)
    for i, c in enumerate(features):
        m = F.lit(None).cast("double")
        for key, v in cent.items():
            m = F.when(q(cluster) == F.lit(key), F.lit(float(v[i]))).otherwise(m)
        d = num(df, c) - m
        sq = sq + d * d
    per = {r["g"]: (r["w"], r["s"]) for r in df.groupBy(q(cluster).alias("g")).agg(F.sum(sq).alias("w"), F.avg(F.sqrt(sq)).alias("s")).collect()}
    within = sum(w for w, _ in per.values())
    between = sum(size[c] * float(np.sum((cent[c] - mean) ** 2)) for c in cent)
    worst = []
    for a in cent:
        r = [(per[a][1] + per[b][1]) / float(np.linalg.norm(cent[a] - cent[b])) for b in cent
             if b != a and np.linalg.norm(cent[a] - cent[b]) > 0]
        worst.append(max(r, default=0.0))
    return {"n_clusters": float(k), "calinski_harabasz_score": between * (n - k) / (within * (k - 1)) if within else 1.0,
            "davies_bouldin_score": sum(worst) / k}


def silhouette_squared(df: DataFrame, cluster: str, features: Sequence[str]) -> float | None:
    """Silhouette of squared Euclidean distances over all rows; None for fewer than two clusters.

    A row's mean squared distance to a cluster follows from the cluster's size, mean and mean square, so one
    aggregate and one pass settle all pairs exactly. Rows with a missing coordinate or cluster take no part.
    """
    names = [f"f{i}" for i in range(len(features))]
    d = df.select(q(cluster).cast("string").alias("g"), *[num(df, c).alias(f) for c, f in zip(features, names)]).na.drop()
    centre = agg_row(d, [F.avg(f) for f in names])
    d = d.select("g", *[(F.col(f) - F.lit(m)).alias(f) for m, f in zip(centre, names)])  # near zero, so squares keep their digits
    square = sum((q(f) * q(f) for f in names), F.lit(0.0))
    rows = d.groupBy("g").agg(F.count("*").alias("n"), F.avg(square).alias("s"), *[F.avg(f).alias(f) for f in names]).collect()  # a row for each cluster
    if len(rows) < 2:
        return None
    place = {r["g"]: i for i, r in enumerate(rows)}
    size = np.array([r["n"] for r in rows], float)
    mean = np.array([[r[f] for f in names] for r in rows])
    means = np.array([r["s"] for r in rows])

    def score(batches):
        for pdf in batches:
            v, own = pdf[names].to_numpy("float64"), pdf["g"].map(place).to_numpy()
            r = np.arange(len(v))
            dist = np.maximum((v * v).sum(axis=1)[:, None] - 2 * v @ mean.T + means[None, :], 0.0)
            a = dist[r, own] * size[own] / np.maximum(size[own] - 1, 1)
            dist[r, own] = np.inf
            b = dist.min(axis=1) if len(v) else np.zeros(0)
            yield pd.DataFrame({"s": np.where(size[own] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))})
    return d.mapInPandas(score, "s double").agg(F.avg("s")).first()[0]


def silhouette(df: DataFrame, cluster: str, features: Sequence[str], key: list[str], sample: int = 10_000, seed: int = 42) -> dict:
    """Euclidean silhouette over a sample that holds every cluster.

    The sampled score is the feature. The sample (a bounded number of rows) is shipped once and
    each sampled row sums its distances per cluster inside its task.
    """
    from ..operators.splitting import hash_order
    d = df.select(*[q(k) for k in key], q(cluster).cast("string").alias("g"), *[num(df, c).alias(f"f{i}") for i, c in enumerate(features)])
    order = hash_order(key, seed)
    firsts = d.groupBy("g").agg(F.min_by(F.struct(*[q(c) for c in d.columns if c != "g"]), order[0]).alias("r")).select("g", "r.*")
    n_clusters = firsts.count()
    if sample <= n_clusters:
        raise ValueError("the sample must be larger than the number of clusters")
    rest = d.join(firsts.select(*[q(k) for k in key]), key, "left_anti").orderBy(*order).limit(sample - n_clusters)
    s = firsts.select(*d.columns).unionByName(rest).toPandas()
    names = [f"f{i}" for i in range(len(features))]
    x, codes = s[names].to_numpy(dtype="float64"), pd.factorize(s["g"], sort=True)
    shared = df.sparkSession.sparkContext.broadcast((x, codes[0], len(codes[1])))
    src = df.sparkSession.createDataFrame([(int(a), int(min(a + 256, len(x)))) for a in range(0, len(x), 256)], "a int, b int").repartition(
        max(1, min(64, len(x) // 256 + 1)))

    def run(batches):
        px, g, k = shared.value
        size = np.bincount(g, minlength=k).astype("float64")
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"]):
                dist = np.zeros((b - a, len(px)))
                for j in range(px.shape[1]):
                    dd = px[a:b, j, None] - px[None, :, j]
                    dist += dd * dd
                dist = np.sqrt(dist)
                tot = np.zeros((b - a, k))
                for c in range(k):
                    tot[:, c] = dist[:, g == c].sum(axis=1)
                own = g[a:b]
                r = np.arange(b - a)
                alone = size[own] == 1
                ai = tot[r, own] / np.maximum(size[own] - 1, 1)
                other = tot / size[None, :]
                other[r, own] = np.inf
                bi = other.min(axis=1)
                sc = np.where(alone, 0.0, (bi - ai) / np.maximum(np.maximum(ai, bi), 1e-300))
                yield pd.DataFrame({"s": sc})
    score = src.mapInPandas(run, "s double").agg(F.avg("s")).first()[0]
    return {"silhouette_score": score, "silhouette_sample_size": float(len(x))}


# --- thresholds ------------------------------------------------------------------------------

def apply_thresholds(df: DataFrame, probability: str, thresholds, classes: Sequence[str], out: str = "prediction") -> DataFrame:
    """Binary: second class from p >= t; multiclass: class with the largest p / t."""
    if len(classes) == 2 and (not isinstance(thresholds, dict) or len(thresholds) == 1):
        t = float(next(iter(thresholds.values())) if isinstance(thresholds, dict) else thresholds)
        return df.withColumn(out, F.when(q(probability)[1] >= F.lit(t), F.lit(classes[1])).otherwise(F.lit(classes[0])))
    absent = [c for c in classes if c not in (thresholds or {})]
    if absent:
        raise ValueError(f"no threshold for classes {absent}")
    scaled = F.array(*[q(probability)[i] / F.lit(float(thresholds[c])) for i, c in enumerate(classes)])
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, F.get(names, (F.array_position(scaled, F.array_max(scaled)) - 1).cast("int")))


def threshold_grid(df: DataFrame, label: str, probability: str, classes: Sequence[str], grid_points: int = 99,
                   metric: str = "f1") -> DataFrame:
    """(threshold, <metric>) over an even grid inside (0, 1).

    Scores are first put into the grid cells they pass, so one small grouped count serves every
    threshold; the running sums over cells are driver arithmetic on grid_points + 1 rows.
    """
    ts = [(i + 1) / (grid_points + 1) for i in range(grid_points)]
    cut = F.array(*[F.lit(t) for t in ts])
    cell = F.aggregate(cut, F.lit(0), lambda a, t: a + (q(probability)[1] >= t).cast("int"))
    rows = df.groupBy(cell.alias("c"), q(label).cast("string").alias("y")).agg(F.count("*").alias("n")).collect()
    out = []
    for i, t in enumerate(ts):
        cells: dict = {}
        for r in rows:
            p = classes[1] if r["c"] > i else classes[0]
            cells[(r["y"], p)] = cells.get((r["y"], p), 0) + r["n"]
        out.append((t, float(metrics_from_counts(cells, classes[1])[metric])))
    return df.sparkSession.createDataFrame(out, "threshold double, score double")


def optimise_binary_threshold(df, label, probability, classes, grid_points: int = 99, metric: str = "f1") -> dict:
    rows = threshold_grid(df, label, probability, classes, grid_points, metric).collect()
    best = max(rows, key=lambda r: (r["score"], -r["threshold"]))
    return {"threshold": best["threshold"], "score": best["score"]}


def optimise_multiclass_thresholds(df: DataFrame, label: str, probability: str, classes: Sequence[str],
                                   metric: str = "f1_weighted", rounds: int = 3, grid: int = 9) -> dict:
    """Coordinate search over log thresholds; each coordinate tries its whole grid in one pass.

    Never worse than plain argmax, which is the starting point.
    """
    k = len(classes)
    names = F.array(*[F.lit(c) for c in classes])

    def scores(cands):
        preds = []
        for t in cands:
            s = F.array(*[q(probability)[i] / F.lit(math.exp(t[i])) for i in range(k)])
            preds.append(F.get(names, (F.array_position(s, F.array_max(s)) - 1).cast("int")))
        rows = (df.select(q(label).cast("string").alias("y"), F.posexplode(F.array(*preds)).alias("i", "p"))
                .groupBy("i", "y", "p").agg(F.count("*").alias("n")).collect())
        out = []
        for j in range(len(cands)):
            out.append(metrics_from_counts({(r["y"], r["p"]): r["n"] for r in rows if r["i"] == j})[metric])
        return out
    best = [0.0] * k
    value = scores([best])[0]
    start, span = value, 1.5
    for _ in range(rounds):
        for i in range(k):
            cands = [[*best[:i], best[i] + span * (2 * g / (grid - 1) - 1), *best[i + 1:]] for g in range(grid)]
            got = scores(cands)
            j = max(range(grid), key=lambda x: got[x])
            if got[j] > value:
                best, value = cands[j], got[j]
        span /= 2
    return {"thresholds": {c: math.exp(t) for c, t in zip(classes, best)}, "score": value, "argmax_score": start}


def evaluate(model, df: DataFrame) -> dict[str, float]:
    """Metrics of a fitted model on a table with its target. Rows are scored once and kept."""
    out = model.predict(df)
    if model.task == "clustering":
        return cluster_scores(out, "prediction", model.features)
    cols = [model.target, "prediction"] + (["probability"] if "probability" in out.columns else [])
    out = out.select(*[q(c) for c in cols]).persist()
    try:
        if model.task == "regression":
            return {r["metric"]: r["value"] for r in regression_metrics(out, model.target, "prediction").collect()}
        cells = {(r["actual"], r["predicted"]): r["count"] for r in confusion_counts(out, model.target, "prediction").collect()}
        m = metrics_from_counts(cells, model.classes[1] if len(model.classes) == 2 else None)
        if "probability" in out.columns:
            m["log_loss"] = log_loss(out, model.target, "probability", model.classes)
            if len(model.classes) == 2:
                m.update(binary_areas(out, q(model.target).cast("string") == F.lit(model.classes[1]), F.col("probability")[1]))
            else:
                m.update(multiclass_areas(out, model.target, "probability", model.classes))
        return m
    finally:
        out.unpersist()
