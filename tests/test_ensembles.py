"""Options of ensembles and clusterings, importances over many classes, schemas from a header or a sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright import sources as S
from tabwright.models import fit_model
from tabwright.operators.selection import importances


@pytest.fixture(scope="module")
def noisy(spark):
    r = np.random.RandomState(4)
    rows = []
    for i in range(240):
        x, y = r.normal(), r.normal()
        rows.append((i, float(x), float(y), int(x + 0.3 * r.normal() > 0), float(2 * x - y + 0.1 * r.normal()), "abc"[int(np.digitize(y, [-0.5, 0.5]))]))
    return spark.createDataFrame(rows, "id long, x double, y double, label int, v double, band string").cache()


def test_passthrough_gives_the_final_model_the_features(noisy):
    base = dict(base_estimators=[{"name": "decision_tree_regressor", "params": {"max_depth": 1}}], key_columns=["id"], cv=3, final_estimator="linear_regression")
    plain = fit_model("stacking_regressor", noisy, ["x", "y"], "v", **base)
    through = fit_model("stacking_regressor", noisy, ["x", "y"], "v", passthrough=True, **base)
    assert plain.parts[0].features == ["__z0"] and through.parts[0].features == ["__z0", "x", "y"]
    error = [m.predict(noisy).agg(F.avg(F.pow(F.col("prediction") - F.col("v"), 2))).first()[0] for m in (plain, through)]
    assert error[1] < 0.02 < error[0]


def test_calibrated_members(noisy):
    m = fit_model("voting_classifier", noisy, ["x", "y"], "label", base_estimators=["gaussian_nb", {"name": "decision_tree_classifier", "params": {"max_depth": 3}}], calibrate_base_models=True, key_columns=["id"])
    assert [p.name for p in m.parts] == ["calibrated_classifier"] * 2
    p = m.predict(noisy)
    assert p.where("abs(probability[0] + probability[1] - 1) > 1e-9").count() == 0
    assert abs(p.agg(F.avg(F.col("probability")[1])).first()[0] - noisy.agg(F.avg("label")).first()[0]) < 0.05
    assert p.where("prediction = label").count() > 200


def test_more_starts_never_cost_more(noisy):
    one, ten = (fit_model("kmeans", noisy, ["x", "y"], n_clusters=8, n_init=n) for n in (1, 10))
    assert ten.parts[0].summary.trainingCost <= one.parts[0].summary.trainingCost


def test_importances_see_every_class(noisy):
    imp = importances(noisy, ["x", "y"], "band", "logistic_regression", "classification")
    assert imp["y"] > 3 * imp["x"] > 0


def test_schema_of_a_csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    spark.range(2000).select("id", (F.col("id") / 2).alias("half"), F.lit("t").alias("note")).coalesce(1).write.option("header", True).csv(path)
    assert S.read_schema(spark, path, sample=0) == {"id": "string", "half": "string", "note": "string"}
    assert S.read_schema(spark, path, sample=0.5) == S.read_schema(spark, path) == {"id": "int", "half": "double", "note": "string"}
    for bad in (-1, 2):
        with pytest.raises(ValueError):
            S.read_schema(spark, path, sample=bad)
