"""Above the sizes at which earlier versions cut or refused."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.core import fit_apply
from tabwright.models.evaluation import binary_areas, confusion_matrix, multiclass_areas, silhouette_squared
from tabwright.operators.resampling import class_targets
from tabwright.operators.selection import _chi2_scores
from tabwright.profiling import aggregates
from tabwright.profiling.aggregates import class_balance
from tabwright.profiling.drift import drift_report, numeric_distances
from tabwright.profiling.profile import normalities


def test_confusion_matrix_total(spark):
    d = spark.range(700 * 700).select((F.col("id") % 700).alias("a"), F.floor(F.col("id") / 700).alias("p"))
    cells, total = confusion_matrix(d, "a", "p").agg(F.count("*"), F.sum("count")).first()
    assert (cells, total) == (490_000, 490_000)
    gaps = {(r.actual, r.predicted): r["count"] for r in confusion_matrix(spark.createDataFrame([("x", "y"), (None, "x")], "a string, p string"), "a", "p").collect()}
    assert gaps == {("x", "x"): 0, ("x", "y"): 1, ("y", "x"): 0, ("y", "y"): 0, (None, "x"): 1}


def test_chi2_many_classes(spark):
    d = spark.range(8000).select((F.col("id") % 2000).alias("__y"), (F.col("id") % 7).cast("double").alias("v"))
    sums, total = {}, 0.0
    for i in range(8000):
        sums[i % 2000] = sums.get(i % 2000, 0.0) + i % 7
        total += i % 7
    want = sum((s - total / 2000) ** 2 / (total / 2000) for s in sums.values())
    assert _chi2_scores(d, ["v"])["v"][0] == pytest.approx(want)


def test_class_balance_many(spark):
    assert class_balance(spark.range(3000), "id").first()["classes"] == 3000


def test_class_targets():
    t = {"a": 10, "b": 4, "c": 1}
    assert class_targets(t, "auto", True) == {"a": 10, "b": 10, "c": 10} and class_targets(t, "minority", True) == {"a": 10, "b": 4, "c": 10}
    assert class_targets(t, "auto", False) == {"a": 1, "b": 1, "c": 1} and class_targets(t, "majority", False) == {"a": 1, "b": 4, "c": 1}
    assert class_targets({"a": 10, "b": 4}, 0.5, True) == {"a": 10, "b": 5} and class_targets({"a": 10, "b": 4}, 0.5, False) == {"a": 8, "b": 4}
    assert class_targets(t, {"c": 3}, True) == {"a": 10, "b": 4, "c": 3}
    for bad in ({"z": 3}, {"c": 0}, "no such"):
        with pytest.raises(ValueError):
            class_targets(t, bad, True)


@pytest.mark.parametrize("replacement", [False, True])
def test_sampling_strategy(spark, replacement):
    d = spark.range(300).select("id", F.rand(1).alias("x"), (F.col("id") < 60).cast("int").alias("y"))
    over = fit_apply("Oversampling", d, target_column="y", key_columns=["id"], method="random_over", sampling_strategy=0.5)
    assert {r["y"]: r["count"] for r in over.groupBy("y").count().collect()} == {0: 240, 1: 120}
    under = fit_apply("Undersampling", d, target_column="y", key_columns=["id"], method="random_under", sampling_strategy={0: 100}, replacement=replacement)
    assert {r["y"]: r["count"] for r in under.groupBy("y").count().collect()} == {0: 100, 1: 60}


def test_deduplicate_ties(spark):
    d = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 7, "c")], "k int, t int, v string").repartition(3)
    assert [r.v for r in fit_apply("Deduplicate", d, subset=["k"], keep="first", order_by=["t"]).collect()] == ["a"]


def jobs_of(spark, run):
    """Jobs that run needs."""
    context = spark.sparkContext
    context.setJobGroup(name := uuid.uuid4().hex, "")
    try:
        run()
        return len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context._jsc.clearJobGroup()


def wide(spark, n, shift=0):
    i = F.col("id")
    return spark.range(400).select(*[((i * (7 + k) + shift) % (31 + k)).cast("double").alias(f"n{k}") for k in range(n)], *[((i + shift) % (3 + k)).cast("string").alias(f"t{k}") for k in range(n)])


def test_jobs_do_not_grow_with_columns(spark):
    runs = {
        "drift": lambda n: drift_report(wide(spark, n), wide(spark, n, 5)).metrics.count(),
        "histograms": lambda n: aggregates.histograms(wide(spark, n), [f"n{k}" for k in range(n)]).count(),
        "categories": lambda n: aggregates.categorical_profiles(wide(spark, n), [f"t{k}" for k in range(n)]).count(),
        "normality": lambda n: normalities(wide(spark, n), [f"n{k}" for k in range(n)]),
    }
    for name, run in runs.items():
        assert jobs_of(spark, lambda: run(2)) == jobs_of(spark, lambda: run(9)), name


def test_batched_profiles_equal_one_column_at_a_time(spark):
    a, b = wide(spark, 4), wide(spark, 4, 5)
    found = numeric_distances(a, b, ["n0", "n1", "n2", "n3"])
    x, y = a.toPandas(), b.toPandas()
    for c, g in found.items():
        v = np.unique(np.concatenate([x[c], y[c]]))
        f, h = (np.searchsorted(np.sort(t[c]), v, "right") / 400 for t in (x, y))
        assert g["d"] == pytest.approx(np.abs(f - h).max()) and g["w"] == pytest.approx((np.abs(f - h)[:-1] * np.diff(v)).sum())
        assert np.allclose(g["edges"], np.quantile(x[c], np.arange(11) / 10))
    hist = aggregates.histograms(a, ["n0", "n3"]).toPandas()
    for c in ("n0", "n3"):
        lo, hi = x[c].min(), x[c].max()
        edges = np.array([lo + k * ((hi - lo) / 20) for k in range(20)] + [hi])
        want = np.bincount((x[c].to_numpy()[:, None] > edges[None, 1:-1]).sum(axis=1), minlength=20)
        assert hist[hist.column == c].sort_values("bin")["count"].tolist() == want.tolist()


def test_areas_of_all_classes_at_once(spark):
    d = spark.range(500).select((F.col("id") % 4).cast("string").alias("y"), F.array(*[((F.col("id") * (11 + k)) % (17 + k)) / 20.0 for k in range(4)]).alias("p"))
    got = multiclass_areas(d, "y", "p", ["0", "1", "2", "3"])
    one = [binary_areas(d, F.col("y") == str(i), F.col("p")[i]) for i in range(4)]
    assert got["roc_auc_ovr"] == pytest.approx(sum(x["roc_auc"] for x in one) / 4) and got["pr_auc_weighted"] == pytest.approx(sum(x["pr_auc"] for x in one) / 4)
    pairs = [binary_areas(d.where(F.col("y").isin(str(i), str(j))), F.col("y") == str(i), F.col("p")[i])["roc_auc"] for i in range(4) for j in range(4) if i != j]
    assert got["roc_auc_ovo"] == pytest.approx(sum(pairs) / 12)


def test_silhouette_of_all_rows(spark):
    rng = np.random.RandomState(1)
    x, g = 1e6 + rng.normal(size=(90, 2)), rng.randint(0, 3, 90)
    g[0] = 3  # a cluster of one row
    d = spark.createDataFrame([(int(c), float(a), float(b)) for c, (a, b) in zip(g, x)] + [(1, None, 1.0), (None, 1.0, 1.0)], "g int, a double, b double")
    far, want = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), []
    for i in range(90):
        mean = {c: far[i, g == c].sum() / ((g == c).sum() - (c == g[i]) or 1) for c in range(4)}
        a, b = mean.pop(g[i]), min(v for c, v in mean.items() if c != g[i])
        want.append(0.0 if (g == g[i]).sum() == 1 else (b - a) / max(a, b))
    assert silhouette_squared(d, "g", ["a", "b"]) == pytest.approx(np.mean(want), abs=1e-9)
    assert silhouette_squared(d.where("g = 1"), "g", ["a", "b"]) is None
