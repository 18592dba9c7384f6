"""How learners get their rows: bounded tasks on all cores, and several starts of k-means at a time."""

import threading
import time

import pytest
from pyspark.ml import classification as MC, clustering as ML, regression as MR
from pyspark.sql import functions as F

from tabwright.models import fit_model, learners as L


@pytest.fixture
def seen(monkeypatch):
    """Partitions and columns that each fit got, and how many ran at once."""
    found, lock = {"parts": [], "columns": set(), "now": 0, "most": 0}, threading.Lock()

    def watched(fit):
        def run(self, data, *rest):
            with lock:
                found["parts"].append(data.rdd.getNumPartitions())
                found["columns"] |= set(data.columns)
                found["now"] += 1
                found["most"] = max(found["most"], found["now"])
            try:
                time.sleep(0.1)
                return fit(self, data, *rest)
            finally:
                with lock:
                    found["now"] -= 1
        return run
    for kind in (ML.KMeans, MR.GBTRegressor, MC.GBTClassifier, MC.RandomForestClassifier):
        monkeypatch.setattr(kind, "fit", watched(kind.fit))
    return found


def one_split(spark):
    i = F.col("id")
    return spark.range(4000).coalesce(1).select((i % 97).cast("double").alias("x"), (i % 31).cast("double").alias("z"), (i % 97 + i % 5).cast("double").alias("v"),
                                                (i % 97 > 40).cast("int").alias("label"), F.repeat(F.lit("w"), 50).alias("wide"))


@pytest.mark.parametrize("name, target", [("gradient_boosting_regressor", "v"), ("gradient_boosting_classifier", "label"), ("random_forest_classifier", "label"), ("minibatch_kmeans", None)])
def test_rows_come_in_bounded_tasks(spark, seen, monkeypatch, name, target):
    monkeypatch.setattr(L, "SPREAD_ROWS", 1000)
    monkeypatch.setattr(L, "TASK_ROWS", 200)
    fit_model(name, one_split(spark), ["x", "z"], target, n_estimators=2, max_depth=2, n_init=2)
    assert set(seen["parts"]) == {20} and seen["columns"] <= {"__x", "__y", "__w"}


def test_few_rows_stay_as_they_are(spark, seen):
    fit_model("gradient_boosting_regressor", one_split(spark), ["x", "z"], "v", n_estimators=2, max_depth=2)
    assert seen["parts"] == [1]


def test_starts_run_together_and_the_cheapest_wins(spark, seen):
    d = one_split(spark)
    best = fit_model("minibatch_kmeans", d, ["x", "z"], n_init=4).parts[0].summary.trainingCost
    assert len(seen["parts"]) == 4 and seen["most"] > 1
    alone = [ML.KMeans(k=3, seed=42 + i, maxIter=100, featuresCol="__x").fit(L.assemble(d, ["x", "z"])).summary.trainingCost for i in range(4)]
    assert best == pytest.approx(min(alone), rel=1e-9)
