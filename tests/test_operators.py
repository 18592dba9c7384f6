"""Operators on small frames."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import tabwright as tw
from tabwright.core import artifact_from_json, artifact_to_json, fit_apply_train
from tabwright.operators.features import fit_power, power_gradients
from tabwright.plans import merging as M
from tabwright.plans.sequence import Pipeline


def test_every_operator_is_described():
    assert len(tw.operator_names()) > 50
    assert all(tw.get_operator(n).description for n in tw.operator_names())


def test_nan_is_missing(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    art = tw.fit("SimpleImputer", d, columns=["x"])
    assert art["missing_counts"] == {"x": 2}
    assert sorted(r["x"] for r in tw.apply(d, artifact_from_json(artifact_to_json(art))).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_detects_informative_numbers(spark):
    from tabwright.core import detect_numeric
    d = spark.createDataFrame([(1, 5, 0, None, 2.5), (2, 5, 1, None, 3.5)], "a int, b int, c int, d double, e double")
    assert detect_numeric(d) == ["a", "e"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=5, max_size=30))
def test_scalers_match_numpy(spark, values):
    x = np.array(values)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, x double")
    got = [r["x"] for r in tw.fit_apply("StandardScaler", d, columns=["x"]).orderBy("i").collect()]
    assert np.allclose(got, (x - x.mean()) / (x.std() or 1.0), atol=1e-6)
    art = tw.fit("RobustScaler", d, columns=["x"])["params"]["x"]
    assert math.isclose(art["center"], float(np.median(x)), rel_tol=1e-9, abs_tol=1e-6)


def test_order_dependent_operators_refuse_without_order(spark):
    d = spark.range(3)
    for name, cfg in (("LagFeatures", {"columns": ["id"]}), ("RollingAggregate", {"columns": ["id"]}), ("Deduplicate", {})):
        with pytest.raises(ValueError):
            tw.fit(name, d, **cfg)


def test_strict_cast_and_unknown_category(spark):
    d = spark.createDataFrame([("1",), ("x",)], "a string")
    with pytest.raises(ValueError):
        tw.fit("Casting", d, column_types={"a": "int"}, coerce_on_error=False)
    art = tw.fit("OrdinalEncoder", d.where("a = '1'"), columns=["a"], handle_unknown="error")
    with pytest.raises(Exception, match="unknown category"):
        tw.apply(d, art).collect()
    art = tw.fit("OneHotEncoder", d.where("a = '1'"), columns=["a"], handle_unknown="error")
    with pytest.raises(Exception, match="unknown category"):
        tw.apply(d, art).collect()


def test_large_category_map_goes_to_a_table(spark, monkeypatch):
    from tabwright.plans import lookup
    d = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("c"), (F.col("id") % 3).cast("double").alias("y"))
    art = lookup.build_map(d.select(F.col("c").alias("key"), F.col("y").alias("value")), limit=50)
    assert "table" in art
    out = lookup.map_column(d, "c", art, "v", default=-1.0)
    assert out.where("v <> y").count() == 0 and out.count() == 500


def test_slash_dates_and_bins(spark):
    d = spark.createDataFrame([("a 1/5/2023 b 12/01/2024, 123/01/20245 1/15/1999",)], "t string")
    out = tw.fit_apply("TextCleaning", d, columns=["t"], operations=[{"op": "regex", "mode": "normalize_slash_dates"}]).first()[0]
    assert out == "a 2023-01-05 b 2024-12-01, 123/01/20245 1999-01-15"
    x = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "x double")
    got = [r["x_binned"] for r in tw.fit_apply("GeneralBinning", x, columns=["x"], n_bins=3).orderBy("x").collect()]
    assert got == [None, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_similarity_scores(spark):
    d = spark.createDataFrame([("", ""), ("a", ""), ("abc", "abd"), ("new york mets", "mets new york")], "a string, b string")
    from tabwright.functions import similarity
    r = d.select(*[similarity(F.col("a"), F.col("b"), m).alias(m) for m in ("ratio", "token_sort_ratio", "token_set_ratio")]).collect()
    assert r[0]["ratio"] == 100.0 and r[1]["ratio"] == 0.0
    assert abs(r[2]["ratio"] - 200.0 * 2 / 6) < 1e-9 and r[3]["token_sort_ratio"] == 100.0 and r[3]["token_set_ratio"] == 100.0


def test_power_transform_finds_lambda(spark):
    x = np.exp(np.random.RandomState(0).normal(size=800))
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    art = tw.fit("PowerTransformer", d, columns=["x"], method="box-cox")
    assert abs(art["params"]["x"]["lambda"]) < 0.1


def imbalanced(spark):
    rng = np.random.RandomState(5)
    rows = [(i, float(rng.normal()), float(rng.normal()), 0) for i in range(90)] + [(100 + i, float(rng.normal() + 1.5), float(rng.normal()), 1) for i in range(25)]
    return spark.createDataFrame(rows, "id long, f1 double, f2 double, y int")


def test_smote_points_lie_between_class_members(spark):
    d = imbalanced(spark)
    out = tw.fit_apply("Oversampling", d, method="smote", target_column="y", key_columns=["id"]).toPandas()
    assert (out.groupby("y").size() == 90).all()
    base = out[(out.y == 1) & out.id.notna()][["f1", "f2"]].to_numpy()
    for p in out[out.id.isna()][["f1", "f2"]].to_numpy():
        gaps = [np.linalg.norm(a - p) + np.linalg.norm(b - p) - np.linalg.norm(a - b) for i, a in enumerate(base) for b in base[i + 1:]]
        assert min(gaps) < 1e-9


def test_undersampling_keeps_the_small_class(spark):
    d = imbalanced(spark)
    for m in ("random_under", "nearmiss", "tomek_links", "edited_nearest_neighbours"):
        out = tw.fit_apply("Undersampling", d, method=m, target_column="y", key_columns=["id"])
        n = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
        assert n[1] == 25 and n[0] <= 90, m
    with pytest.raises(ValueError):
        tw.fit("Undersampling", d, method="nope", target_column="y", key_columns=["id"])


def test_cross_fit_leaves_out_own_fold(spark):
    d = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i % 7)) for i in range(60)], "id long, c string, y double")
    art, train = fit_apply_train("TargetEncoder", d, columns=["c"], target_column="y", key_columns=["id"])
    assert train.count() == 60 and train.select("c").distinct().count() > 2
    assert tw.apply(d, art).select("c").distinct().count() == 2


def test_merge_rows_needs_shared_columns(spark):
    a, b = spark.range(2).toDF("x"), spark.range(2).toDF("y")
    with pytest.raises(ValueError):
        M.merge_rows([a, b])


def test_sequence_round_trip_and_stream_refusal(spark, tmp_path):
    d = imbalanced(spark)
    p = Pipeline([("TrainTestSplitter", {"stratify": True}), ("StandardScaler", {"columns": ["f1", "f2"]}), ("Oversampling", {"method": "random_over"})],
                 {"type": "logistic_regression", "params": {"features": ["f1", "f2"]}}, "y", ["id"]).fit(d)
    assert p.parts.test.count() == 23 and set(p.metrics) == {"train", "test"}
    with pytest.raises(ValueError):
        p.predict(d)
    want = p.predict(d.drop("y")).orderBy("id").collect()
    p.save(str(tmp_path / "p"))
    assert Pipeline.load(str(tmp_path / "p")).predict(d.drop("y")).orderBy("id").collect() == want
    lagged = Pipeline([("LagFeatures", {"columns": ["f1"], "sort_by": ["id"]})]).fit(d)
    d.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        lagged.transform(spark.readStream.schema(d.schema).parquet(str(tmp_path / "t")))


def test_iterative_imputer_recovers_a_linear_relation(spark):
    d = spark.createDataFrame([(i, None if i % 5 == 0 else 2.0 * i + 1, float(i)) for i in range(1, 80)], "id long, a double, b double")
    out = tw.fit_apply("IterativeImputer", d, columns=["a", "b"]).toPandas()
    assert np.allclose(out["a"], 2 * out["id"] + 1, atol=0.05)


def test_text_vectors(spark):
    d = spark.createDataFrame([(1, "the cat sat the"), (2, "cat dog"), (3, None)], "id long, t string")
    out = tw.fit_apply("count_vectorizer", d, columns=["t"]).orderBy("id").collect()
    assert out[0]["t__count__the"] == 2 and out[1]["t__count__dog"] == 1 and out[2]["t__count__cat"] == 0
    t = tw.fit_apply("tfidf_vectorizer", d, columns=["t"]).orderBy("id").collect()
    norm = sum(t[0][c] ** 2 for c in t[0].asDict() if "__tfidf__" in c)
    assert abs(norm - 1) < 1e-9 and t[2]["t__tfidf__cat"] == 0.0


def test_power_lambdas_settle_without_bounds(spark):
    rng = np.random.RandomState(4)
    x = {"a": np.exp(rng.normal(size=400)), "b": rng.normal(size=400) ** 3, "c": 20.0 + rng.rand(400) ** 0.2, "d": np.full(400, 3.0)}
    d = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values())], "a double, b double, c double, d double")
    got = fit_power(d, list(x), "yeo-johnson")
    g = power_gradients(d, {c: [got[c]] for c in "abc"}, "yeo-johnson")
    assert all(abs(v[0]) < 1e-8 for v in g.values()) and got["d"] == 1.0 and got["c"] > 5  # beyond any former bound
    cox = fit_power(d, ["a"], "box-cox")
    assert abs(cox["a"]) < 0.2 and abs(power_gradients(d, {"a": [cox["a"]]}, "box-cox")["a"][0]) < 1e-8

    def likelihood(v, lam):
        y = np.where(v >= 0, ((1 + np.abs(v)) ** lam - 1) / lam, -((1 + np.abs(v)) ** (2 - lam) - 1) / (2 - lam))
        return -0.5 * np.log(y.var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).mean()
    assert all(likelihood(x[c], got[c]) >= likelihood(x[c], got[c] + e) for c in "abc" for e in (-0.01, 0.01))
