"""Models, evaluation, tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import q
from ..models import evaluation as EV, fit_model, summaries as SM, tuning as TU, validation as VA
from .base import query, r6, rounded, table


def _lines(spark, sf):
    """lineitem with a learnable class and value."""
    li = table(spark, sf, "lineitem")
    noise = (F.xxhash64("l_orderkey", "l_partkey", "l_linenumber") % 100) / 25.0
    score = F.col("l_quantity") / 10 + F.col("l_discount") * 20 - F.col("l_tax") * 30 + noise
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("id")
    return li.select(key, "l_quantity", "l_discount", "l_tax", score.alias("value"), (score > 3).cast("int").alias("label"),
                     F.when(score > 4, "high").when(score > 2, "mid").otherwise("low").alias("band"))


FEATS = ["l_quantity", "l_discount", "l_tax"]


def _metrics(spark, m, d):
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in EV.evaluate(m, d).items()], "metric string, value double")


CLASSIFIERS = {"logistic_regression": ("S1", {"class_weight": "balanced"}), "random_forest_classifier": ("S3", {"n_estimators": 10, "max_depth": 5}), "decision_tree_classifier": ("S4", {"max_depth": 5}),
               "gradient_boosting_classifier": ("S5", {"n_estimators": 5}), "hist_gradient_boosting_classifier": ("S6", {"max_iter": 4}), "adaboost_classifier": ("S7", {"n_estimators": 5}),
               "svc": ("S8", {"max_iter": 20}), "gaussian_nb": ("S10", {}), "multinomial_nb": ("S11", {}), "bernoulli_nb": ("S12", {"binarize": 0.05}), "sgd_classifier": ("S13", {})}
REGRESSORS = {"random_forest_regressor": ("S3", {"n_estimators": 10, "max_depth": 5}), "decision_tree_regressor": ("S4", {"max_depth": 5}), "gradient_boosting_regressor": ("S5", {"n_estimators": 5}),
              "hist_gradient_boosting_regressor": ("S6", {"max_iter": 4}), "adaboost_regressor": ("S7", {"n_estimators": 4}), "ridge_regression": ("S15", {}), "lasso_regression": ("S16", {"alpha": 0.05}), "elasticnet_regression": ("S17", {"alpha": 0.05})}
CLUSTERERS = {"kmeans": "S18", "minibatch_kmeans": "S18", "gaussian_mixture": "S19", "birch": "S20"}

for _n, (_id, _p) in CLASSIFIERS.items():
    query(f"{_id} S23 S24", name=f"model_{_n}")(lambda spark, sf, n=_n, p=_p: _metrics(spark, fit_model(n, _lines(spark, sf), FEATS, "label", **p), _lines(spark, sf)))
for _n, (_id, _p) in REGRESSORS.items():
    query(_id, name=f"model_{_n}")(lambda spark, sf, n=_n, p=_p: _metrics(spark, fit_model(n, _lines(spark, sf), FEATS, "value", **p), _lines(spark, sf)))
for _n, _id in CLUSTERERS.items():
    query(_id, name=f"model_{_n}")(lambda spark, sf, n=_n: fit_model(n, table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]).predict(table(spark, sf, "customer"))
                                   .groupBy("prediction").agg(F.count("*").alias("rows")))


@query("S20", """WITH g AS (SELECT c_custkey % 4 AS cluster, c_acctbal / 10000 + 10 * (c_custkey % 4) AS x, c_nationkey / 25.0 + 5 * (c_custkey % 2) AS y FROM customer)
  SELECT cluster::INTEGER AS cluster, count(*) AS rows, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y, count(*) AS entry_rows, round(sum(x), 6) AS entry_x, round(sum(y), 6) AS entry_y,
    round(sum(x * x + y * y), 4) AS entry_squares, true AS within_threshold FROM g GROUP BY 1""")
def model_birch_sums(spark, sf):
    """Four groups apart from each other: sums over the rows of each cluster, and the same out of the features of the tree's entries."""
    key = F.col("c_custkey")
    d = table(spark, sf, "customer").select((F.col("c_acctbal") / 10000 + 10 * (key % 4)).alias("x"), (F.col("c_nationkey") / 25.0 + 5 * (key % 2)).alias("y"))
    m = fit_model("birch", d, ["x", "y"], n_clusters=4, threshold=0.1)
    entries = spark.createDataFrame([(int(c), n, mean[0], mean[1], m2) for c, n, mean, m2 in zip(*(m.data[k] for k in ("cluster", "rows", "means", "deviations")))],
                                    "cluster int, n double, x double, y double, m2 double")
    squares = F.col("m2") + F.col("n") * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    e = entries.groupBy("cluster").agg(F.sum("n").cast("long").alias("entry_rows"), r6(F.sum(F.col("n") * F.col("x")), 6).alias("entry_x"), r6(F.sum(F.col("n") * F.col("y")), 6).alias("entry_y"),
                                       r6(F.sum(squares), 4).alias("entry_squares"), F.bool_and(F.col("m2") <= 0.1 * 0.1 * F.col("n") * (1 + 1e-9)).alias("within_threshold"))
    p = m.predict(d).groupBy(F.col("prediction").cast("int").alias("cluster")).agg(F.count("*").alias("rows"), r6(F.sum("x"), 6).alias("sum_x"), r6(F.sum("y"), 6).alias("sum_y"))
    return p.join(e, "cluster")


@query("S14", """WITH l AS (SELECT l_quantity AS x, l_quantity / 10 + l_discount * 20 AS y FROM lineitem) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM l""")
def model_linear_regression(spark, sf):
    d = table(spark, sf, "lineitem").select(q("l_quantity").alias("x"), (F.col("l_quantity") / 10 + F.col("l_discount") * 20).alias("y"))
    m = fit_model("linear_regression", d, ["x"], "y").parts[0]
    return rounded(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"), "slope", "intercept")


ONE = "(SELECT l_quantity AS x, l_quantity / 10 + l_discount * 20 AS y FROM lineitem)"


def _one_feature(spark, sf, name, **params):
    d = table(spark, sf, "lineitem").select(q("l_quantity").alias("x"), (F.col("l_quantity") / 10 + F.col("l_discount") * 20).alias("y"))
    m = fit_model(name, d, ["x"], "y", **params).parts[0]
    return rounded(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"), "slope", "intercept", digits=5)


@query("S15", f"""WITH s AS (SELECT covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 1000000) AS b, avg(x) AS mx, avg(y) AS my FROM {ONE}) SELECT round(b, 5) AS slope, round(my - b * mx, 5) AS intercept FROM s""")
def model_ridge_closed_form(spark, sf):
    return _one_feature(spark, sf, "ridge_regression", alpha=1_000_000)


@query("S16", f"""WITH s AS (SELECT greatest(covar_pop(y, x) - 2, 0) / var_pop(x) AS b, avg(x) AS mx, avg(y) AS my FROM {ONE}) SELECT round(b, 5) AS slope, round(my - b * mx, 5) AS intercept FROM s""")
def model_lasso_closed_form(spark, sf):
    return _one_feature(spark, sf, "lasso_regression", alpha=2)


@query("S17", f"""WITH s AS (SELECT greatest(covar_pop(y, x) - 2 * 0.25, 0) / (var_pop(x) + 2 * 0.75) AS b, avg(x) AS mx, avg(y) AS my FROM {ONE}) SELECT round(b, 5) AS slope, round(my - b * mx, 5) AS intercept FROM s""")
def model_elasticnet_closed_form(spark, sf):
    return _one_feature(spark, sf, "elasticnet_regression", alpha=2, l1_ratio=0.25)


@query("S10", """WITH d AS (SELECT c_custkey, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS z, c_mktsegment AS k FROM customer), e AS (SELECT 1e-9 * greatest(var_pop(x), var_pop(z)) AS e FROM d),
  g AS (SELECT k, count(*) / (SELECT count(*) FROM d) AS pr, avg(x) AS mx, var_pop(x) + e AS vx, avg(z) AS mz, var_pop(z) + e AS vz FROM d, e GROUP BY k, e),
  l AS (SELECT c_custkey, g.k, ln(pr) - 0.5 * ln(2 * pi() * vx) - pow(x - mx, 2) / (2 * vx) - 0.5 * ln(2 * pi() * vz) - pow(z - mz, 2) / (2 * vz) AS s FROM d, g),
  p AS (SELECT c_custkey, k, exp(s - max(s) OVER (PARTITION BY c_custkey)) AS u FROM l) SELECT c_custkey, max_by(k, u) AS prediction, round(max(u) / sum(u), 5) AS best FROM p GROUP BY 1""")
def model_gaussian_nb_scores(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("z"), "c_mktsegment")
    p = fit_model("gaussian_nb", d, ["x", "z"], "c_mktsegment").predict(d)
    return p.select("c_custkey", "prediction", r6(F.array_max("probability"), 5).alias("best"))


@query("S11", """WITH d AS (SELECT c_custkey, abs(c_acctbal) / 1000 AS x, c_nationkey::DOUBLE AS z, c_mktsegment AS k FROM customer),
  g AS (SELECT k, count(*) / (SELECT count(*) FROM d) AS pr, (sum(x) + 1) / (sum(x) + sum(z) + 2) AS tx, (sum(z) + 1) / (sum(x) + sum(z) + 2) AS tz FROM d GROUP BY k),
  l AS (SELECT c_custkey, g.k, ln(pr) + x * ln(tx) + z * ln(tz) AS s FROM d, g), p AS (SELECT c_custkey, k, exp(s - max(s) OVER (PARTITION BY c_custkey)) AS u FROM l)
  SELECT c_custkey, round(max(u) / sum(u), 3) AS best FROM p GROUP BY 1""")
def model_multinomial_nb_scores(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", (F.abs("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("z"), "c_mktsegment")
    p = fit_model("multinomial_nb", d, ["x", "z"], "c_mktsegment").predict(d)
    return p.select("c_custkey", r6(F.array_max("probability"), 3).alias("best"))


@query("S2")
def model_calibrated(spark, sf):
    d = _lines(spark, sf)
    return _metrics(spark, fit_model("calibrated_classifier", d, FEATS, "label", key_columns=["id"], cv=3, method="isotonic"), d)


@query("S21")
def model_voting(spark, sf):
    d = _lines(spark, sf)
    m = fit_model("voting_classifier", d, FEATS, "band", base_estimators=["logistic_regression", "gaussian_nb", {"name": "decision_tree_classifier", "params": {"max_depth": 4}}], weights=[2, 1, 1])
    return _metrics(spark, m, d)


@query("S22")
def model_stacking(spark, sf):
    d = _lines(spark, sf)
    m = fit_model("stacking_regressor", d, FEATS, "value", key_columns=["id"], cv=3, base_estimators=["linear_regression", {"name": "decision_tree_regressor", "params": {"max_depth": 4}}])
    return _metrics(spark, m, d)


@query("S25")
def summary_components(spark, sf):
    return spark.createDataFrame([(r["component"], round(r["explained"], 6)) for r in SM.pca_summary(table(spark, sf, "lineitem"), FEATS + ["l_extendedprice"])], "component int, explained double")


@query("S26")
def summary_segments(spark, sf):
    return spark.createDataFrame([(r["cluster"], r["size"], round(r["share"], 6)) for r in SM.segmentation(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])], "cluster int, size long, share double")


@query("S27")
def summary_rules(spark, sf):
    return spark.createDataFrame([(r,) for r in SM.surrogate_rules(_lines(spark, sf), FEATS, "band")["rules"]], "rule string")


# --- evaluation against fixed scores ---------------------------------------------------------

def _scored(spark, sf):
    """Orders with a made score, so that SQL can repeat every metric."""
    p = ((F.col("o_orderkey") * 37 + F.col("o_custkey")) % 101) / 100.0
    o = table(spark, sf, "orders")
    y = ((F.col("o_orderkey") * 7 + F.col("o_custkey") * 3) % 10 < F.col("p") * 10).cast("int")
    return o.withColumn("p", p).withColumn("y", y).select("o_orderkey", "o_totalprice", "p", "y", (F.col("p") > 0.45).cast("int").alias("pred"), F.array(1 - F.col("p"), F.col("p")).alias("probability"),
                                                          (F.col("o_orderkey") % 3).cast("string").alias("y3"), (F.col("o_custkey") % 3).cast("string").alias("p3"))


SC = """(SELECT *, (p > 0.45)::INT AS pred, (o_orderkey % 3)::VARCHAR AS y3, (o_custkey % 3)::VARCHAR AS p3 FROM (SELECT *, ((o_orderkey * 7 + o_custkey * 3) % 10 < p * 10)::INT AS y FROM
  (SELECT o_orderkey, o_custkey, o_totalprice, ((o_orderkey * 37 + o_custkey) % 101) / 100.0::DOUBLE AS p FROM orders)))"""


@query("T1", f"""WITH c AS (SELECT sum(y * pred)::DOUBLE AS tp, sum((1 - y) * pred)::DOUBLE AS fp, sum(y * (1 - pred))::DOUBLE AS fn, sum((1 - y) * (1 - pred))::DOUBLE AS tn, count(*)::DOUBLE AS n FROM {SC}),
  m AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, (tp + fn) / n AS w1 FROM c)
  SELECT 'accuracy' AS metric, round((tp + tn) / n, 6) AS value FROM m UNION ALL SELECT 'balanced_accuracy', round((r1 + r0) / 2, 6) FROM m UNION ALL SELECT 'precision_weighted', round(w1 * p1 + (1 - w1) * p0, 6) FROM m
  UNION ALL SELECT 'recall_weighted', round(w1 * r1 + (1 - w1) * r0, 6) FROM m UNION ALL SELECT 'f1_weighted', round(w1 * 2 * p1 * r1 / (p1 + r1) + (1 - w1) * 2 * p0 * r0 / (p0 + r0), 6) FROM m
  UNION ALL SELECT 'matthews_corrcoef', round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) FROM m UNION ALL SELECT 'precision', round(p1, 6) FROM m UNION ALL SELECT 'recall', round(r1, 6) FROM m
  UNION ALL SELECT 'f1', round(2 * p1 * r1 / (p1 + r1), 6) FROM m UNION ALL SELECT 'g_score', round(sqrt((w1 * r1 + (1 - w1) * r0) * (w1 * r0 + (1 - w1) * r1)), 6) FROM m""")
def evaluate_classes(spark, sf):
    return rounded(EV.classification_metrics(_scored(spark, sf), "y", "pred"), "value")


@query("T2", f"SELECT round(avg(-ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS log_loss FROM {SC}")
def evaluate_log_loss(spark, sf):
    v = EV.log_loss(_scored(spark, sf), "y", "probability", ["0", "1"])
    return rounded(spark.createDataFrame([(v,)], "log_loss double"), "log_loss")


AREAS = f"""WITH g AS (SELECT p, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM {SC} GROUP BY p), t AS (SELECT sum(a) AS pos, sum(b) AS neg FROM g), c AS (SELECT *, sum(b) OVER (ORDER BY p) - b / 2 AS below, sum(a) OVER (ORDER BY p DESC) AS tp, sum(b) OVER (ORDER BY p DESC) AS fp FROM g)"""


@query("T3", AREAS + " SELECT round(sum(a * below) / (pos * neg), 6) AS roc_auc, round(sum(a / pos * tp / (tp + fp)), 6) AS pr_auc FROM c, t GROUP BY pos, neg")
def evaluate_areas(spark, sf):
    a = EV.binary_areas(_scored(spark, sf), q("y"), q("p"))
    return rounded(spark.createDataFrame([(a["roc_auc"], a["pr_auc"])], "roc_auc double, pr_auc double"), "roc_auc", "pr_auc")


@query("T3", """WITH s AS (SELECT o_orderkey % 3 AS y, unnest([0, 1, 2]) AS i, unnest([((o_orderkey * 37 + o_custkey) % 101) / 101, (o_custkey % 17 + o_orderkey % 3) / 19, (o_orderkey % 13) / 13]) AS v FROM orders),
  t AS (SELECT i, y, v, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT o_orderkey % 3 AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
  u AS (SELECT a.i, b.y AS j, sum(a.n * b.n * CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END) AS u FROM t a JOIN t b ON a.i = b.i AND a.y = a.i AND b.y <> a.i GROUP BY ALL),
  r AS (SELECT u.i, sum(u) / (max(a.n) * sum(b.n)) AS auc, max(a.n) AS n FROM u JOIN k a ON a.y = u.i JOIN k b ON b.y = u.j GROUP BY u.i),
  o AS (SELECT u.i, u.j, u / (a.n * b.n) AS auc, a.n + b.n AS n FROM u JOIN k a ON a.y = u.i JOIN k b ON b.y = u.j),
  c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS called FROM (SELECT i, v, sum(n) AS n, sum(CASE WHEN y = i THEN n ELSE 0 END) AS p FROM t GROUP BY ALL) WINDOW w AS (PARTITION BY i ORDER BY v DESC)),
  ap AS (SELECT c.i, sum(p / k.n * tp / called) AS ap, max(k.n) AS n FROM c JOIN k ON k.y = c.i GROUP BY c.i)
  SELECT * FROM (SELECT 'roc_auc_ovr' AS metric, round(avg(auc), 6) AS value FROM r UNION ALL SELECT 'roc_auc_ovr_weighted', round(sum(auc * n) / sum(n), 6) FROM r UNION ALL SELECT 'roc_auc_weighted', round(sum(auc * n) / sum(n), 6) FROM r
   UNION ALL SELECT 'roc_auc_ovo', round(avg(auc), 6) FROM o UNION ALL SELECT 'roc_auc_ovo_weighted', round(sum(auc * n) / sum(n), 6) FROM o UNION ALL SELECT 'pr_auc_weighted', round(sum(ap * n) / sum(n), 6) FROM ap)""")
def evaluate_areas_multiclass(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    d = table(spark, sf, "orders").select((o % 3).alias("y"), F.array(((o * 37 + c) % 101) / 101.0, (c % 17 + o % 3) / 19.0, (o % 13) / 13.0).alias("probability"))
    got = EV.multiclass_areas(d, "y", "probability", ["0", "1", "2"])
    return rounded(spark.createDataFrame(sorted(got.items()), "metric string, value double"), "value")


@query("T4", f"SELECT a AS actual, b AS predicted, (SELECT count(*) FROM {SC} WHERE y3 = a AND p3 = b)::BIGINT AS count FROM (SELECT unnest(['0','1','2']) AS a), (SELECT unnest(['0','1','2']) AS b)")
def evaluate_confusion(spark, sf):
    return EV.confusion_matrix(_scored(spark, sf), "y3", "p3")


@query("T4", """WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_partkey % 97 AS VARCHAR) AS p, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT a AS x FROM c UNION SELECT p FROM c)
  SELECT r.x AS actual, s.x AS predicted, coalesce(c.n, 0)::BIGINT AS count FROM k r CROSS JOIN k s LEFT JOIN c ON c.a = r.x AND c.p = s.x""")
def evaluate_confusion_many_classes(spark, sf):
    return EV.confusion_matrix(table(spark, sf, "lineitem").withColumn("p", F.col("l_partkey") % 97), "l_suppkey", "p")


@query("T5", AREAS + " SELECT p AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM c, t")
def evaluate_curves(spark, sf):
    return rounded(EV.curve_points(_scored(spark, sf), q("y"), q("p")), "fpr", "tpr", "precision")


@query("T6", """WITH d AS (SELECT o_totalprice AS y, o_totalprice * 0.9 + o_custkey AS p FROM orders) SELECT 'mae' AS metric, round(avg(abs(y - p)), 4) AS value FROM d UNION ALL SELECT 'mse', round(avg(pow(y - p, 2)), 4) FROM d UNION ALL SELECT 'rmse', round(sqrt(avg(pow(y - p, 2))), 4) FROM d
  UNION ALL SELECT 'r2', round(1 - avg(pow(y - p, 2)) / var_pop(y), 4) FROM d UNION ALL SELECT 'mape', round(avg(abs(y - p) / abs(y)), 4) FROM d UNION ALL SELECT 'explained_variance', round(1 - var_pop(y - p) / var_pop(y), 4) FROM d""")
def evaluate_regression(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice", (F.col("o_totalprice") * 0.9 + F.col("o_custkey")).alias("p"))
    return rounded(EV.regression_metrics(o, "o_totalprice", "p"), "value", digits=4)


@query("T7", """SELECT o_orderkey, o_totalprice AS actual, o_custkey AS predicted, round(o_totalprice - o_custkey, 6) AS residual FROM orders ORDER BY substr(md5(o_orderkey::VARCHAR || ':42'), 1, 13), o_orderkey LIMIT 1000""")
def evaluate_residuals(spark, sf):
    return rounded(EV.residual_sample(table(spark, sf, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"]), "residual")


CLU = "(SELECT c_custkey, (c_nationkey // 9)::INTEGER AS g, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y FROM customer)"


@query("T8", f"""WITH d AS (SELECT a.c_custkey AS i, a.g AS ga, b.g AS gb, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS s, count(*) AS n FROM {CLU} a, {CLU} b GROUP BY 1, 2, 3),
  o AS (SELECT i, s / (n - 1) AS a FROM d WHERE ga = gb), p AS (SELECT i, min(s / n) AS b FROM d WHERE ga <> gb GROUP BY 1), sil AS (SELECT avg((b - a) / greatest(a, b)) AS s FROM o JOIN p USING (i)),
  c AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM {CLU} GROUP BY 1), w AS (SELECT c.g, sum(pow(x - mx, 2) + pow(y - my, 2)) AS w, avg(sqrt(pow(x - mx, 2) + pow(y - my, 2))) AS s FROM {CLU} t JOIN c ON t.g = c.g GROUP BY 1),
  t AS (SELECT avg(x) AS ax, avg(y) AS ay, count(*) AS n FROM {CLU}), bt AS (SELECT sum(c.n * (pow(mx - ax, 2) + pow(my - ay, 2))) AS b, count(*) AS k FROM c, t), r AS (SELECT a.g, max((wa.s + wb.s) / sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2))) AS r FROM c a, c b, w wa, w wb WHERE a.g <> b.g AND wa.g = a.g AND wb.g = b.g GROUP BY 1)
  SELECT round(sil.s, 6) AS silhouette, round(b * (n - k) / ((SELECT sum(w) FROM w) * (k - 1)), 4) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin FROM sil, bt, t""")
def evaluate_clusters(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_nationkey") / 9).cast("int").alias("g"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    s = EV.cluster_scores(c, "g", ["x", "y"])
    sil = EV.silhouette(c, "g", ["x", "y"], ["c_custkey"], sample=20_000)
    d = spark.createDataFrame([(sil["silhouette_score"], s["calinski_harabasz_score"], s["davies_bouldin_score"])], "silhouette double, calinski_harabasz double, davies_bouldin double")
    return rounded(rounded(d, "silhouette", "davies_bouldin"), "calinski_harabasz", digits=4)


@query("T8", f"""WITH d AS (SELECT a.c_custkey AS i, a.g AS ga, b.g AS gb, sum(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS s, count(*) AS n FROM {CLU} a, {CLU} b GROUP BY 1, 2, 3),
  o AS (SELECT i, s / (n - 1) AS a FROM d WHERE ga = gb), p AS (SELECT i, min(s / n) AS b FROM d WHERE ga <> gb GROUP BY 1)
  SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*)::BIGINT AS rows FROM o JOIN p USING (i)""")
def evaluate_clusters_all_rows(spark, sf):
    """The silhouette of squared distances over every row."""
    c = table(spark, sf, "customer").select("c_custkey", F.floor(F.col("c_nationkey") / 9).cast("int").alias("g"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    d = c.agg(F.count("*").alias("rows")).withColumn("silhouette", F.lit(EV.silhouette_squared(c, "g", ["x", "y"])))
    return rounded(d, "silhouette")


@query("T9", f"""SELECT o_orderkey, CASE WHEN p >= 0.3 THEN 'yes' ELSE 'no' END AS two, CASE WHEN (1 - p) / 0.5 >= (p * 0.6) / 0.2 AND (1 - p) / 0.5 >= (p * 0.4) / 0.3 THEN 'a' WHEN (p * 0.6) / 0.2 >= (p * 0.4) / 0.3 THEN 'b' ELSE 'c' END AS three FROM {SC}""")
def thresholds_applied(spark, sf):
    d = EV.apply_thresholds(_scored(spark, sf), "probability", 0.3, ["no", "yes"], "two")
    d = d.withColumn("probs", F.array(1 - F.col("p"), F.col("p") * 0.6, F.col("p") * 0.4))
    return EV.apply_thresholds(d, "probs", {"a": 0.5, "b": 0.2, "c": 0.3}, ["a", "b", "c"], "three").select("o_orderkey", "two", "three")


@query("T10", f"""WITH t AS (SELECT i / 20.0::DOUBLE AS t FROM range(1, 20) r(i)), c AS (SELECT t, sum(y * (p >= t)::INT)::DOUBLE AS tp, sum((1 - y) * (p >= t)::INT)::DOUBLE AS fp, sum(y * (p < t)::INT)::DOUBLE AS fn FROM {SC}, t GROUP BY t)
  SELECT t AS threshold, round(2 * tp / (2 * tp + fp + fn), 6) AS score FROM c""")
def thresholds_grid(spark, sf):
    return rounded(EV.threshold_grid(_scored(spark, sf), "y", "probability", ["0", "1"], 19), "score")


@query("T11")
def thresholds_multiclass(spark, sf):
    d = _scored(spark, sf).withColumn("probs", F.array(1 - F.col("p"), F.col("p") * 0.6, F.col("p") * 0.4))
    r = EV.optimise_multiclass_thresholds(d, "y3", "probs", ["0", "1", "2"], rounds=1, grid=5)
    return spark.createDataFrame([(r["score"] >= r["argmax_score"], round(r["score"], 6))], "never_worse boolean, score double")


@query("T12")
def cross_validated(spark, sf):
    r = VA.cross_validate("logistic_regression", _lines(spark, sf), FEATS, "label", ["id"], 3, "stratified_k_fold")
    return spark.createDataFrame([(k, round(v["mean"], 6), round(v["std"], 6)) for k, v in r["aggregated_metrics"].items()], "metric string, mean double, std double")


@query("T14")
def cross_validated_nested(spark, sf):
    r = VA.nested_cross_validate("decision_tree_classifier", _lines(spark, sf), FEATS, "label", ["id"], 2, 2, "accuracy", [{"max_depth": 2}, {"max_depth": 4}])
    return spark.createDataFrame([(k, round(v["mean"], 6)) for k, v in r["aggregated_metrics"].items()], "metric string, mean double")


def _search(spark, sf, strategy):
    r = TU.search("decision_tree_classifier", _lines(spark, sf), FEATS, "label", ["id"], {"max_depth": [2, 4, 6], "min_samples_leaf": [1]}, strategy, n_trials=3, cv=2)
    return spark.createDataFrame([(str(t["params"]["max_depth"]), int(t["rows"]), round(t["score"], 6)) for t in r["trials"]], "max_depth string, rows long, score double")


@query("T15")
def search_grid(spark, sf):
    return _search(spark, sf, "grid")


@query("T16")
def search_halving(spark, sf):
    return _search(spark, sf, "halving_random")
