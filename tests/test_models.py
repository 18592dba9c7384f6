"""Learners, evaluation, profiles, sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tabwright import sources as S
from tabwright.models import fit_model, load_model, model_names, summaries as SM
from tabwright.models.evaluation import evaluate, optimise_binary_threshold
from tabwright.models.validation import fold_pairs
from tabwright.profiling import advice, drift as D, expectations as X, profile as P


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.RandomState(0)
    rows = []
    for k, (cx, cy) in enumerate([(0, 0), (4, 0), (0, 4)]):
        for i in range(60):
            x, y = rng.normal(cx, 0.7), rng.normal(cy, 0.7)
            rows.append((k * 60 + i, float(x), float(y), ["a", "b", "c"][k], float(3 * x - 2 * y + rng.normal() * 0.1)))
    return spark.createDataFrame(rows, "id long, x double, y double, kind string, v double").cache()


def test_linear_models_match_closed_form(spark, blobs):
    pdf = blobs.toPandas()
    X1 = pdf[["x", "y"]].to_numpy() - pdf[["x", "y"]].to_numpy().mean(axis=0)
    t = pdf["v"].to_numpy() - pdf["v"].mean()
    ridge = np.linalg.solve(X1.T @ X1 + 5.0 * np.eye(2), X1.T @ t)
    m = fit_model("ridge_regression", blobs, ["x", "y"], "v", alpha=5.0)
    assert np.allclose(m.parts[0].coefficients.toArray(), ridge, atol=1e-5)
    assert evaluate(fit_model("linear_regression", blobs, ["x", "y"], "v"), blobs)["r2"] > 0.99


@pytest.mark.parametrize("name,params", [("logistic_regression", {}), ("gaussian_nb", {}), ("adaboost_classifier", {"n_estimators": 8}),
                                         ("k_neighbors_classifier", {"key_columns": ["id"]}), ("decision_tree_classifier", {"max_depth": 4}),
                                         ("voting_classifier", {"base_estimators": ["logistic_regression", "gaussian_nb"], "voting": "hard"})])
def test_classifiers_separate_blobs(blobs, name, params):
    out = fit_model(name, blobs, ["x", "y"], "kind", **params).predict(blobs)
    assert out.where("prediction = kind").count() > 0.85 * 180


def test_saved_model_predicts_the_same(spark, blobs, tmp_path):
    for name in ("logistic_regression", "adaboost_regressor"):
        extra = {} if "logistic" in name else {"n_estimators": 3}
        m = fit_model(name, blobs, ["x", "y"], "kind" if "logistic" in name else "v", **extra)
        m.save(str(tmp_path / name))
        again = load_model(str(tmp_path / name))
        assert again.predict(blobs).select("prediction").collect() == m.predict(blobs).select("prediction").collect()


def test_clusters_and_names(blobs):
    m = fit_model("kmeans", blobs, ["x", "y"])
    assert sorted(r["count"] for r in m.predict(blobs).groupBy("prediction").count().collect()) == [60, 60, 60] or evaluate(m, blobs)["calinski_harabasz_score"] > 300
    assert "stacking_classifier" in model_names()
    with pytest.raises(KeyError):
        fit_model("nothing", blobs, ["x"], "v")


def test_folds_are_disjoint_and_cover(blobs):
    for kind in ("k_fold", "stratified_k_fold"):
        seen = []
        for train, test in fold_pairs(blobs, kind, 4, ["id"], "kind"):
            a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
            assert not a & b and len(a | b) == 180
            seen += list(b)
        assert sorted(seen) == list(range(180))
    sizes = [(a.agg(F.max("id")).first()[0], b.agg(F.min("id")).first()[0]) for a, b in fold_pairs(blobs, "time_series_split", 3, ["id"], None, "id")]
    assert all(a < b for a, b in sizes)


def test_isolation_forest_finds_the_far_point(spark, blobs):
    far = blobs.select("id", "x", "y").union(spark.createDataFrame([(999, 60.0, -50.0)], "id long, x double, y double"))
    r = SM.outlier_report(far, ["x", "y"], ["id"], top=1)
    assert r["top"][0]["id"] == 999


def test_threshold_search(blobs):
    d = blobs.select(F.when(F.col("kind") == "a", "yes").otherwise("no").alias("k"), "x", "y")
    m = fit_model("logistic_regression", d, ["x", "y"], "k")
    best = optimise_binary_threshold(m.predict(d), "k", "probability", m.classes, 19)
    assert best["score"] > 0.9


def test_expectations(spark):
    d = spark.createDataFrame([(1, 2.0, "x"), (1, float("nan"), "y")], "a int, b double, c string")
    assert X.expect_columns_exist(d, ["a"]) is d
    for call in (lambda: X.expect_columns_exist(d, ["z"]), lambda: X.expect_no_nulls(d), lambda: X.expect_value_range(d, "a", 2, 3),
                 lambda: X.expect_unique(d, ["a"]), lambda: X.expect_schema(d, T.StructType().add("a", T.StringType()))):
        with pytest.raises(X.ExpectationError):
            call()


def test_drift_found_only_where_it_is(spark):
    rng = np.random.RandomState(1)
    a = spark.createDataFrame([(float(v), 1.0) for v in rng.normal(size=500)], "f double, one double")
    b = spark.createDataFrame([(float(v), 1.0) for v in rng.normal(5, 1, size=500)], "f double, one double")
    assert D.drift_report(a, a).drifted_columns == []
    r = D.drift_report(a, b.drop("one"))
    assert r.drifted_columns == ["f"] and r.missing_columns == ["one"] and r.suggestions["f"]


def test_profile_of_empty_and_small_tables(spark):
    d = spark.createDataFrame([(1, "a")], "n int, s string")
    r = P.analyze(d, filters=[{"column": "n", "operator": ">", "value": 5}])
    assert r["row_count"] == 0 and r["alerts"][0]["type"] == "Empty"
    assert advice.semantic_type(T.LongType(), 3, 1000) == "Categorical"


def test_sources(spark, tmp_path):
    d = spark.range(20).withColumn("v", F.col("id") * 0.5)
    cat = S.Catalog(spark, [str(tmp_path)])
    cat.save("t.parquet", d)
    assert cat.exists("t.parquet") and cat.load("t").count() == 20 and not cat.exists("u")
    S.write_table(d, str(tmp_path / "c.csv"))
    assert S.read_table(spark, str(tmp_path / "c.csv"), 5).count() == 5
    assert S.read_schema(spark, str(tmp_path / "t.parquet")) == {"id": "bigint", "v": "double"}
    assert len(S.sample_head(spark, str(tmp_path / "t.parquet"), 3)) == 3
    S.export(d, str(tmp_path / "e"), "csv", 7)
    assert S.read_csv(spark, str(tmp_path / "e")).count() == 7
