"""Neighbour join and its users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import fit, fit_apply, q
from ..plans.neighbors import knn_join
from .base import query, r6, rounded, table


EMBEDDED = """SELECT l_vec_id, r_vec_id, round(d, 6) AS distance, rn::INTEGER AS rank FROM (SELECT a.vec_id AS l_vec_id, b.vec_id AS r_vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rn <= 5"""


@query("C7", EMBEDDED)
def nearest_embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    return rounded(knn_join(e, e, None, 5, ["vec_id"], ["vec_id"], vector="embedding", exclude_self=True), "distance")


@query("C7", EMBEDDED)
def nearest_embeddings_by_pivots(spark, sf):
    """Through the leaves of pivots, as on a large right side."""
    e = table(spark, sf, "embeddings")
    return rounded(knn_join(e, e, None, 5, ["vec_id"], ["vec_id"], vector="embedding", exclude_self=True, broadcast_bytes=0, leaf_rows=64), "distance")


@query("C7", """SELECT l_c_custkey, r_s_suppkey, round(d, 6) AS distance, rn::INTEGER AS rank FROM (SELECT c_custkey AS l_c_custkey, s_suppkey AS r_s_suppkey, sqrt(pow(c_acctbal / 1000 - s_acctbal / 1000, 2) + pow(c_nationkey - s_nationkey, 2)) AS d,
  row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt(pow(c_acctbal / 1000 - s_acctbal / 1000, 2) + pow(c_nationkey - s_nationkey, 2)), s_suppkey) AS rn FROM customer, supplier) WHERE rn <= 3""")
def nearest_suppliers_by_tree(spark, sf):
    """Always through the tree plan, as on a large right side."""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return rounded(knn_join(c, s, ["x", "y"], 3, ["c_custkey"], ["s_suppkey"], broadcast_bytes=0, leaf_rows=16), "distance")


GAPS = """(SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 1000 END AS x, CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey::DOUBLE END AS y, (c_custkey % 31)::DOUBLE AS z FROM customer)"""


@query("G6", f"""WITH g AS {GAPS}, p AS (SELECT a.c_custkey AS l, b.c_custkey AS r, b.x, CASE WHEN (a.y IS NOT NULL AND b.y IS NOT NULL) THEN sqrt(3.0 / 2 * (pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) ELSE sqrt(3.0 * pow(a.z - b.z, 2)) END AS d
   FROM g a, g b WHERE a.x IS NULL AND b.x IS NOT NULL), k AS (SELECT l, avg(x) AS x FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY round(d, 9), r) AS rn FROM p) WHERE rn <= 5 GROUP BY 1)
  SELECT c_custkey, round(coalesce(g.x, k.x), 6) AS x FROM g LEFT JOIN k ON l = c_custkey""")
def impute_nearest(spark, sf):
    c = F.col("c_custkey")
    g = table(spark, sf, "customer").select("c_custkey", F.when(c % 9 != 0, F.col("c_acctbal") / 1000).alias("x"), F.when(c % 13 != 0, F.col("c_nationkey").cast("double")).alias("y"), (c % 31).cast("double").alias("z"))
    return rounded(fit_apply("KNNImputer", g, columns=["x", "y", "z"], key_columns=["c_custkey"]).select("c_custkey", "x"), "x")


@query("G7")
def impute_iterative(spark, sf):
    li = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("a"), (F.col("o_totalprice") * 0.5 + F.col("o_custkey")).alias("b"), F.col("o_custkey").cast("double").alias("c"))
    return rounded(fit_apply("IterativeImputer", li, columns=["a", "b", "c"], max_iter=3), "a", digits=3)


def _rounds_sql(rounds: int) -> str:
    """One table for each column and round: y, then x, each the mean of the five nearest rows that have it."""
    parts, last = ["""g AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN round(c_acctbal / 100) END AS x, CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey::DOUBLE END AS y, (c_custkey % 31)::DOUBLE AS z FROM customer)""",
                   "s0 AS MATERIALIZED (SELECT k, x IS NULL AS mx, y IS NULL AS my, coalesce(x, avg(x) OVER ()) AS x, coalesce(y, avg(y) OVER ()) AS y, z FROM g)"], "s0"
    for i in range(1, 2 * rounds + 1):
        c, o = ("y", "x") if i % 2 else ("x", "y")
        parts.append(f"""p{i} AS (SELECT l, avg(v) AS v FROM (SELECT a.k AS l, b.{c} AS v, row_number() OVER (PARTITION BY a.k ORDER BY (a.{o} - b.{o}) * (a.{o} - b.{o}) + (a.z - b.z) * (a.z - b.z), b.k) AS rn
          FROM {last} a, {last} b WHERE a.m{c} AND NOT b.m{c}) WHERE rn <= 5 GROUP BY 1)""")
        parts.append(f"s{i} AS MATERIALIZED (SELECT k, mx, my, {'x, coalesce(v, y) AS y' if c == 'y' else 'coalesce(v, x) AS x, y'}, z FROM {last} LEFT JOIN p{i} ON l = k)")
        last = f"s{i}"
    return f"WITH {', '.join(parts)} SELECT k AS c_custkey, round(x, 6) AS x, round(y, 6) AS y FROM {last}"


@query("G7", _rounds_sql(10))
def impute_neighbour_rounds(spark, sf):
    """Ten rounds, fewer only if nothing moves any more."""
    c = F.col("c_custkey")
    g = table(spark, sf, "customer").select("c_custkey", F.when(c % 9 != 0, F.round(F.col("c_acctbal") / 100)).alias("x"), F.when(c % 13 != 0, F.col("c_nationkey").cast("double")).alias("y"), (c % 31).cast("double").alias("z"))
    done = fit_apply("IterativeImputer", g, columns=["x", "y", "z"], key_columns=["c_custkey"], estimator="KNeighbors", max_iter=10, tol=0.0)
    return rounded(done.select("c_custkey", "x", "y"), "x", "y")


def _classes(spark, sf):
    """Customers with a rare class in part of the plane."""
    c = table(spark, sf, "customer")
    rare = (F.col("c_custkey") % 7 == 0)
    return c.select("c_custkey", (F.col("c_acctbal") / 1000 + F.when(rare, 2.0).otherwise(0.0)).alias("x"), F.col("c_nationkey").cast("double").alias("y"), rare.cast("int").alias("label"))


CLS = "(SELECT c_custkey, c_acctbal / 1000 + CASE WHEN c_custkey % 7 = 0 THEN 2.0 ELSE 0.0 END AS x, c_nationkey::DOUBLE AS y, (c_custkey % 7 = 0)::INT AS label FROM customer)"
OVER = f"""SELECT label, count(*) AS original, (SELECT max(n) FROM (SELECT count(*) AS n FROM {CLS} GROUP BY label)) - count(*) AS synthetic,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {CLS} GROUP BY label)) - count(*) AS inside FROM {CLS} GROUP BY 1"""


def _counts(d, base):
    """Originals kept, how many synthetic rows came out, and how many of these lie in the box of their class's rows."""
    made = F.col("c_custkey").isNull()
    box = base.groupBy(F.col("label").alias("l")).agg(*[f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max))])
    inside = made & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return d.join(F.broadcast(box), F.col("label") == F.col("l")).groupBy("label").agg(F.count("c_custkey").alias("original"), F.count_if(made).alias("synthetic"), F.count_if(inside).alias("inside"))


for _m in ("smote", "adasyn", "borderline_smote", "svm_smote", "kmeans_smote"):
    def _run(spark, sf, m=_m):
        d = _classes(spark, sf)
        return _counts(fit_apply("Oversampling", d, method=m, target_column="label", key_columns=["c_custkey"]), d)
    # the others share by weights, with one row more or less for a seed
    query({"smote": "P5", "svm_smote": "P7"}.get(_m, "P6"), *([OVER] if _m in ("smote", "borderline_smote", "svm_smote") else []), name=f"oversample_{_m}")(_run)


@query("P7")
def oversample_smote_tomek(spark, sf):
    d = _classes(spark, sf)
    return _counts(fit_apply("Oversampling", d, method="smote_tomek", target_column="label", key_columns=["c_custkey"]), d)


DIST = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"


@query("P9", f"""WITH g AS {CLS}, nn AS (SELECT l, r FROM (SELECT a.c_custkey AS l, b.c_custkey AS r, row_number() OVER (PARTITION BY a.c_custkey ORDER BY {DIST}, b.c_custkey) AS rn FROM g a, g b WHERE a.c_custkey <> b.c_custkey) WHERE rn = 1),
  t AS (SELECT p.l FROM nn p JOIN nn s ON p.r = s.l AND s.r = p.l JOIN g a ON a.c_custkey = p.l JOIN g b ON b.c_custkey = p.r WHERE a.label <> b.label AND a.label = 0)
  SELECT c_custkey, label::INTEGER AS label FROM g WHERE c_custkey NOT IN (SELECT l FROM t)""")
def undersample_tomek(spark, sf):
    return fit_apply("Undersampling", _classes(spark, sf), method="tomek_links", target_column="label", key_columns=["c_custkey"]).select("c_custkey", "label")


NEAR = f"""WITH g AS {CLS}, d AS (SELECT a.c_custkey AS l, {DIST} AS d FROM g a, g b WHERE a.label = 0 AND b.label = 1),
  s AS (SELECT l, avg(d) AS s FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d {{o}}) AS rn FROM d) WHERE rn <= 3 GROUP BY 1),
  k AS (SELECT l FROM (SELECT l, row_number() OVER (ORDER BY s, substr(md5(l::VARCHAR || ':0'), 1, 13)) AS rn FROM s) WHERE rn <= (SELECT count(*) FROM g WHERE label = 1))
  SELECT c_custkey, label::INTEGER AS label FROM g WHERE label = 1 OR c_custkey IN (SELECT l FROM k)"""


@query("P10", NEAR.format(o="ASC"))
def undersample_near_miss(spark, sf):
    return fit_apply("Undersampling", _classes(spark, sf), method="nearmiss", version=1, target_column="label", key_columns=["c_custkey"]).select("c_custkey", "label")


@query("P10", NEAR.format(o="DESC"))
def undersample_near_miss_far(spark, sf):
    return fit_apply("Undersampling", _classes(spark, sf), method="nearmiss", version=2, target_column="label", key_columns=["c_custkey"]).select("c_custkey", "label")


@query("P10")
def undersample_near_miss_third(spark, sf):
    return fit_apply("Undersampling", _classes(spark, sf), method="nearmiss", version=3, target_column="label", key_columns=["c_custkey"]).select("c_custkey", "label")


@query("P11", f"""WITH g AS {CLS}, nn AS (SELECT l, y FROM (SELECT a.c_custkey AS l, b.label AS y, row_number() OVER (PARTITION BY a.c_custkey ORDER BY {DIST}, b.c_custkey) AS rn FROM g a, g b WHERE a.c_custkey <> b.c_custkey AND a.label = 0) WHERE rn <= 3)
  SELECT c_custkey, label::INTEGER AS label FROM g WHERE c_custkey NOT IN (SELECT l FROM nn GROUP BY l HAVING max(y) > 0)""")
def undersample_edited(spark, sf):
    return fit_apply("Undersampling", _classes(spark, sf), method="edited_nearest_neighbours", target_column="label", key_columns=["c_custkey"]).select("c_custkey", "label")


@query("S9", f"""WITH g AS {CLS}, t AS (SELECT * FROM g WHERE c_custkey % 3 <> 0), p AS (SELECT * FROM g WHERE c_custkey % 3 = 0),
  nn AS (SELECT l, label FROM (SELECT a.c_custkey AS l, b.label, row_number() OVER (PARTITION BY a.c_custkey ORDER BY {DIST}, b.c_custkey) AS rn FROM p a, t b) WHERE rn <= 5)
  SELECT l AS c_custkey, (CASE WHEN avg(label) > 0.5 THEN '1' ELSE '0' END) AS prediction, round(avg(label), 6) AS p1 FROM nn GROUP BY 1""")
def neighbours_classifier(spark, sf):
    from ..models import fit_model
    d = _classes(spark, sf)
    m = fit_model("k_neighbors_classifier", d.where("c_custkey % 3 <> 0"), ["x", "y"], "label", key_columns=["c_custkey"])
    return m.predict(d.where("c_custkey % 3 = 0")).select("c_custkey", "prediction", r6(F.col("probability")[1]).alias("p1"))


@query("S9", f"""WITH g AS {CLS}, t AS (SELECT * FROM g WHERE c_custkey % 3 <> 0), p AS (SELECT * FROM g WHERE c_custkey % 3 = 0),
  nn AS (SELECT l, v, d FROM (SELECT a.c_custkey AS l, b.x * 2 AS v, abs(a.y - b.y) + abs(a.c_custkey % 10 - b.c_custkey % 10) + 0.5 AS d, row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.y - b.y) + abs(a.c_custkey % 10 - b.c_custkey % 10), b.c_custkey) AS rn FROM p a, t b) WHERE rn <= 4)
  SELECT l AS c_custkey, round(avg(v), 6) AS prediction FROM nn GROUP BY 1""")
def neighbours_regressor(spark, sf):
    from ..models import fit_model
    d = _classes(spark, sf).select("c_custkey", (F.col("x") * 2).alias("v"), "y", (F.col("c_custkey") % 10).cast("double").alias("z"))
    m = fit_model("k_neighbors_regressor", d.where("c_custkey % 3 <> 0"), ["y", "z"], "v", key_columns=["c_custkey"], n_neighbors=4, metric="manhattan")
    return m.predict(d.where("c_custkey % 3 = 0")).select("c_custkey", r6("prediction").alias("prediction"))
