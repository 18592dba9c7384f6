"""Clustering by feature trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.models import fit_model, load_model
from tabwright.models.feature_trees import FeatureTree, joined, ward_groups


def plain_ward(n, mean, k):
    """Repeatedly join the cheapest pair of all."""
    groups = [[i] for i in range(len(n))]
    cf = [(n[i], mean[i], 0.0) for i in range(len(n))]
    while len(groups) > k:
        best = min(((joined(*cf[i], *cf[j])[2] - cf[i][2] - cf[j][2], i, j) for i in range(len(cf)) for j in range(i)), key=lambda e: e[0])
        _, i, j = best
        cf[j], groups[j] = joined(*cf[j], *cf[i]), groups[j] + groups[i]
        del cf[i], groups[i]
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed,threshold,branching", [(0, 0.3, 50), (1, 0.3, 4), (2, 0.0, 5), (3, 2.0, 3)])
def test_entries_hold_all_rows_within_the_threshold(seed, threshold, branching):
    x = np.random.RandomState(seed).normal(0, 1, (3000, 3)).round(1)
    t = FeatureTree(3, threshold, branching, max_entries=100_000)
    t.add_rows(x)
    n, mean, m2 = t.features()
    assert t.limit == threshold and len(n) == t.entries
    assert n.sum() == 3000 and np.allclose(n @ mean, x.sum(axis=0))
    assert np.isclose((m2 + n * (mean ** 2).sum(axis=1)).sum(), (x ** 2).sum())
    assert (m2 <= threshold ** 2 * n * (1 + 1e-9) + 1e-12).all()
    if threshold == 0:
        assert len(np.unique(mean.round(6), axis=0)) == len(np.unique(x, axis=0))


def test_a_full_tree_rises_its_limit_and_loses_no_row():
    x = np.random.RandomState(5).uniform(0, 1000, (5000, 2))
    t = FeatureTree(2, 0.0, 10, max_entries=60)
    t.add_rows(x)
    n, mean, m2 = t.features()
    assert len(n) <= 60 and t.limit > 0 and n.sum() == 5000 and np.allclose(n @ mean, x.sum(axis=0))
    assert (m2 <= t.limit ** 2 * n * (1 + 1e-9)).all()


@pytest.mark.parametrize("seed", range(4))
def test_ward_joins_the_cheapest_pairs(seed):
    r = np.random.RandomState(seed)
    n, mean = r.randint(1, 9, 40).astype(float), r.normal(0, 3, (40, 2))
    got = ward_groups(n, mean, 5)
    assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got)} == plain_ward(n, mean, 5)


def test_model_over_many_tasks(spark, tmp_path):
    d = spark.range(0, 6000, 1, 20).select("id", ((F.col("id") % 3) * 50 + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    d = d.unionByName(spark.createDataFrame([(-1, None, 0.5), (-2, float("nan"), 0.5), (-3, float("inf"), 0.5)], "id long, x double, y double"))
    m = fit_model("birch", d, ["x", "y"], n_clusters=3, threshold=0.2)
    assert m.data["limit"] == 0.2 and sum(m.data["rows"]) == 6000
    out = m.predict(d)
    assert out.where("id < 0 and prediction is not null").count() == 0
    assert out.where("id >= 0").select("prediction", (F.col("id") % 3).alias("g")).distinct().count() == 3
    m.save(str(tmp_path / "birch"))
    assert load_model(str(tmp_path / "birch")).predict(d).exceptAll(out).count() == 0
    each = fit_model("birch", d, ["x", "y"], n_clusters=None, threshold=0.2)
    assert sorted(each.data["cluster"]) == list(range(len(each.data["rows"])))


def test_tables_without_complete_rows(spark):
    with pytest.raises(ValueError):
        fit_model("birch", spark.createDataFrame([(None, 1.0)], "x double, y double"), ["x", "y"])
    one = spark.createDataFrame([(1.0, 1.0)] * 5, "x double, y double")
    assert fit_model("birch", one, ["x", "y"]).predict(one).where("prediction = 0").count() == 5
