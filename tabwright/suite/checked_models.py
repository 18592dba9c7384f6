"""Models on data for which SQL knows the answer: closed forms, and groups or steps that a right model finds exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import fit_apply
from ..models import fit_model, summaries as SM
from ..models.learners import class_list, class_weights
from ..plans.sequence import Pipeline
from .base import query, r6, rounded, table


# --- closed forms ----------------------------------------------------------------------------

@query("S12", """WITH d AS (SELECT c_custkey, c_mktsegment AS k, (c_acctbal / 10000 > 0.5)::INT AS a, (c_nationkey / 25.0 > 0.5)::INT AS b FROM customer),
  g AS (SELECT k, count(*) / (SELECT count(*) FROM d) AS pr, (sum(a) + 1) / (count(*) + 2) AS pa, (sum(b) + 1) / (count(*) + 2) AS pb FROM d GROUP BY 1),
  l AS (SELECT c_custkey, g.k, pr * CASE a WHEN 1 THEN pa ELSE 1 - pa END * CASE b WHEN 1 THEN pb ELSE 1 - pb END AS u FROM d, g)
  SELECT c_custkey, k AS class, round(u / sum(u) OVER (PARTITION BY c_custkey), 6) AS probability FROM l""")
def model_bernoulli_nb_scores(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 10000).alias("x"), (F.col("c_nationkey") / 25.0).alias("z"))
    m = fit_model("bernoulli_nb", d, ["x", "z"], "c_mktsegment", binarize=0.5)
    each = F.arrays_zip(F.array(*[F.lit(c) for c in m.classes]).alias("class"), F.col("probability"))
    return rounded(m.predict(d).select("c_custkey", F.explode(each).alias("e")).select("c_custkey", "e.class", "e.probability"), "probability")


@query("S23", "SELECT c_mktsegment, round((SELECT count(*) FROM customer) / ((SELECT count(DISTINCT c_mktsegment) FROM customer) * count(*)), 9) AS weight FROM customer GROUP BY 1")
def balanced_class_weights(spark, sf):
    d = table(spark, sf, "customer")
    w = class_weights(d, "c_mktsegment", class_list(d, "c_mktsegment"), "balanced")
    return rounded(d.select("c_mktsegment", w.alias("weight")).distinct(), "weight", digits=9)


@query("S25", """WITH r AS (SELECT abs(corr(c_acctbal, c_nationkey)) AS r FROM customer)
  SELECT i::INTEGER AS component, round((1 + CASE i WHEN 1 THEN r ELSE -r END) / 2, 6) AS explained, round(sqrt(0.5), 6) AS loading FROM r, range(1, 3) t(i)""")
def summary_components_of_two(spark, sf):
    """Of two standardised columns: shares (1 + r) / 2 and (1 - r) / 2, equal loadings."""
    s = SM.pca_summary(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return spark.createDataFrame([(r["component"], round(r["explained"], 6), round(abs(r["loadings"]["c_acctbal"]), 6)) for r in s], "component int, explained double, loading double")


LINE = "(SELECT l_quantity AS x, l_quantity / 10 + l_discount * 20 AS y FROM lineitem)"


@query("S21", f"""WITH s AS (SELECT covar_pop(y, x) / var_pop(x) AS a, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 1000000) AS b, avg(x) AS mx, avg(y) AS my FROM {LINE})
  SELECT DISTINCT x, round((2 * (my + a * (x - mx)) + my + b * (x - mx)) / 3, 5) AS prediction FROM {LINE}, s""")
def model_voting_regressor(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_quantity") / 10 + F.col("l_discount") * 20).alias("y"))
    m = fit_model("voting_regressor", d, ["x"], "y", base_estimators=["linear_regression", {"name": "ridge_regression", "params": {"alpha": 1_000_000}}], weights=[2, 1])
    return rounded(m.predict(d.select("x").distinct()), "prediction", digits=5)


NB = """d AS (SELECT c_custkey, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS z, {target} AS k FROM customer), e AS (SELECT 1e-9 * greatest(var_pop(x), var_pop(z)) AS e FROM d),
  g AS (SELECT k, count(*) / (SELECT count(*) FROM d) AS pr, avg(x) AS mx, var_pop(x) + e AS vx, avg(z) AS mz, var_pop(z) + e AS vz FROM d, e GROUP BY k, e),
  l AS (SELECT c_custkey, g.k, pr / sqrt(vx * vz) * exp(-pow(x - mx, 2) / (2 * vx) - pow(z - mz, 2) / (2 * vz)) AS u FROM d, g)"""


def _segments(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("z"))


@query("S21", f"WITH {NB.format(target='c_mktsegment')} SELECT c_custkey, max_by(k, u) AS prediction FROM l GROUP BY 1")
def model_hard_voting(spark, sf):
    """Two equal members outvote the third."""
    d = _segments(spark, sf)
    m = fit_model("voting_classifier", d, ["x", "z"], "c_mktsegment", base_estimators=["gaussian_nb", {"name": "decision_tree_classifier", "params": {"max_depth": 3}}, "gaussian_nb"], voting="hard")
    return m.predict(d).select("c_custkey", "prediction")


@query("R3 R10", f"""WITH {NB.format(target="(c_mktsegment = 'BUILDING')::INT")} SELECT c_custkey, CASE WHEN sum(u) FILTER (WHERE k = 1) / sum(u) >= 0.2 THEN '1' ELSE '0' END AS prediction FROM l GROUP BY 1""")
def batch_predictions_by_threshold(spark, sf):
    d = _segments(spark, sf).select("c_custkey", "x", "z", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))
    p = Pipeline([], {"type": "gaussian_nb", "params": {"features": ["x", "z"]}}, "y", ["c_custkey"]).fit(d)
    p.thresholds = 0.2
    return p.batch_predict(d, required=["x", "z"]).select("c_custkey", "prediction")


@query("R10", """WITH d AS (SELECT o_orderkey, o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders), s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d)
  SELECT o_orderkey, round(a + b * x, 3) AS prediction FROM d, s""")
def batch_predictions_linear(spark, sf):
    """Scaling first does not change a linear fit."""
    d = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    p = Pipeline([("StandardScaler", {"columns": ["x"]})], {"type": "linear_regression", "params": {"features": ["x"]}}, "y", ["o_orderkey"]).fit(d)
    return rounded(p.batch_predict(d, required=["x"]).select("o_orderkey", "prediction"), "prediction", digits=3)


# --- groups apart from each other ------------------------------------------------------------

APART = "(SELECT c_acctbal / 10000 + 10 * (c_custkey % 4) AS x, c_nationkey / 25.0 + 5 * (c_custkey % 2) AS y, c_custkey % 4 AS g FROM customer)"


def _apart(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select((F.col("c_acctbal") / 10000 + 10 * (key % 4)).alias("x"), (F.col("c_nationkey") / 25.0 + 5 * (key % 2)).alias("y"))


for _n, _id, _k in (("kmeans", "S18", "n_clusters"), ("minibatch_kmeans", "S18", "n_clusters"), ("gaussian_mixture", "S19", "n_components"), ("bisecting_kmeans", "S20", "n_clusters")):
    @query(_id, f"SELECT count(*) AS rows, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y FROM {APART} GROUP BY g", name=f"model_{_n}_sums")
    def _sums(spark, sf, n=_n, k=_k):
        d = _apart(spark, sf)
        p = fit_model(n, d, ["x", "y"], **{k: 4}).predict(d)
        return p.groupBy("prediction").agg(F.count("*").alias("rows"), r6(F.sum("x")).alias("sum_x"), r6(F.sum("y")).alias("sum_y")).drop("prediction")


@query("S26", f"SELECT count(*) AS size, round(count(*) / (SELECT count(*) FROM customer), 6) AS share, round(avg(x), 5) AS x, round(avg(y), 5) AS y FROM {APART} GROUP BY g")
def summary_segments_apart(spark, sf):
    s = SM.segmentation(_apart(spark, sf), ["x", "y"], k=4)
    return rounded(spark.createDataFrame([(r["size"], r["share"], r["center"]["x"], r["center"]["y"]) for r in s], "size long, share double, x double, y double").withColumn("share", r6("share")), "x", "y", digits=5)


@query("K3", f"SELECT (row_number() OVER (ORDER BY min(x)) - 1)::INTEGER AS bin, count(*) AS rows, round(min(x), 6) AS low, round(max(x), 6) AS high FROM {APART} GROUP BY g")
def bin_kmeans_apart(spark, sf):
    b = fit_apply("GeneralBinning", _apart(spark, sf), columns=["x"], strategy="kmeans", n_bins=4)
    return rounded(b.groupBy(F.col("x_binned").cast("int").alias("bin")).agg(F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")), "low", "high")


# --- steps that trees find exactly, with the default number of trees -------------------------

def _steps(spark, sf):
    a, b = F.col("c_nationkey") >= 12, F.col("c_custkey") % 7 > 3
    return table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("n"), (F.col("c_custkey") % 7).cast("double").alias("w"), a.cast("int").alias("a"), b.cast("int").alias("b"),
                                               (a.cast("int") * 10.0 + b.cast("int") * 5.0).alias("value"), (a & b).cast("int").alias("label"))


STEPS = "(SELECT (c_nationkey >= 12)::INT AS a, (c_custkey % 7 > 3)::INT AS b FROM customer)"
EXACT = {"decision_tree_regressor": "S4", "gradient_boosting_regressor": "S5", "hist_gradient_boosting_regressor": "S6", "adaboost_regressor": "S7",
         "decision_tree_classifier": "S4", "random_forest_classifier": "S3", "gradient_boosting_classifier": "S5", "hist_gradient_boosting_classifier": "S6"}

_TREE = {"name": "decision_tree_classifier", "params": {"max_depth": 4}}
_CV = {"key_columns": ["c_custkey"], "cv": 3}
#: ensembles over an exact member: query, item, learner, parameters
OVER_TREES = {"stacking_classifier": ("S22", {"base_estimators": [_TREE, "logistic_regression"], **_CV}),
              "stacking_classifier_passthrough": ("S22", {"base_estimators": [_TREE], "passthrough": True, **_CV}),
              "calibrated_classifier_sigmoid": ("S2", {"base_estimator": "decision_tree_classifier", "base_params": {"max_depth": 4}, "method": "sigmoid", **_CV}),
              "voting_classifier_calibrated": ("S21", {"base_estimators": [_TREE, {"name": "random_forest_classifier", "params": {"max_depth": 4}}], "calibrate_base_models": True, **_CV})}

for _q, (_id, _p) in OVER_TREES.items():
    @query(_id, f"SELECT a, b, count(*) AS rows, min(a * b)::VARCHAR AS low, max(a * b)::VARCHAR AS high FROM {STEPS} GROUP BY 1, 2", name=f"model_{_q}_steps")
    def _over(spark, sf, n="_".join(_q.split("_")[:2]), p=_p):
        d = _steps(spark, sf)
        out = fit_model(n, d, ["n", "w"], "label", **p).predict(d)
        return out.groupBy("a", "b").agg(F.count("*").alias("rows"), F.min("prediction").alias("low"), F.max("prediction").alias("high"))

for _n, _id in EXACT.items():
    _want = "a * 10.0 + b * 5.0" if _n.endswith("regressor") else "(a * b)::DOUBLE"

    @query(_id, f"SELECT a, b, count(*) AS rows, round(min({_want}), 6)::DOUBLE AS low, round(max({_want}), 6)::DOUBLE AS high FROM {STEPS} GROUP BY 1, 2", name=f"model_{_n}_steps")
    def _found(spark, sf, n=_n):
        d = _steps(spark, sf)
        p = fit_model(n, d, ["n", "w"], "value" if n.endswith("regressor") else "label").predict(d).withColumn("prediction", F.col("prediction").cast("double"))
        return rounded(p.groupBy("a", "b").agg(F.count("*").alias("rows"), F.min("prediction").alias("low"), F.max("prediction").alias("high")), "low", "high")
