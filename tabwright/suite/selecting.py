"""Feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import fit, fit_apply, q
from ..operators import selection as S
from .base import query, r6, rounded, table


def _scores(spark, scores):
    return spark.createDataFrame([(c, float(s)) for c, (s, _) in scores.items()], "column string, score double")


@query("O1", """SELECT o_orderkey, o_totalprice FROM orders WHERE (SELECT var_pop(o_totalprice) FROM orders) > 100 AND (SELECT var_pop(o_custkey % 2) FROM orders) <= 100""")
def select_variance(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_totalprice", (F.col("o_custkey") % 2).alias("parity"))
    return fit_apply("VarianceThreshold", o, threshold=100).withColumn("o_orderkey", q("o_orderkey").cast("bigint"))


@query("O2", """SELECT c AS "column" FROM (SELECT 'double_qty' AS c, abs(corr(l_quantity, l_quantity * 2 + l_tax)) AS r FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_quantity, l_tax)) FROM lineitem) WHERE r > 0.95""")
def select_correlation(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_tax", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("double_qty"))
    art = fit("CorrelationThreshold", li)
    return spark.createDataFrame([(c,) for c in art["columns_to_drop"]], "column string")


@query("O2", """SELECT c AS "column" FROM (SELECT 'cube' AS c, count(*) AS n FROM part UNION ALL SELECT 'zz', 0) WHERE n > 0""")
def select_correlation_rank(spark, sf):
    p = table(spark, sf, "part").select("p_size", "p_retailprice", (F.col("p_size") * F.col("p_size") * F.col("p_size")).alias("cube"))
    out = {m: fit("CorrelationThreshold", p, correlation_method=m)["columns_to_drop"] for m in ("spearman", "kendall")}
    assert out["spearman"] == out["kendall"], out
    return spark.createDataFrame([(c,) for c in out["spearman"]], "column string")


@query("O4", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(pow(corr({c}, l_extendedprice), 2) * (count(*) - 2) / (1 - pow(corr({c}, l_extendedprice), 2)), 6) AS score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def score_f_regression(spark, sf):
    return rounded(_scores(spark, S.univariate_scores(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "f_regression")), "score")


CHI = """SELECT '{c}' AS "column", round(sum(pow(s - n * t / m, 2) / (n * t / m)), 6) AS score FROM (SELECT sum({c}) AS s, count(*) AS n, (SELECT sum({c}) FROM lineitem) AS t, (SELECT count(*) FROM lineitem) AS m FROM lineitem GROUP BY l_returnflag)"""


@query("O5", " UNION ALL ".join(CHI.format(c=c) for c in ("l_quantity", "l_extendedprice")))
def score_chi2(spark, sf):
    return rounded(_scores(spark, S.univariate_scores(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag", "chi2")), "score")


@query("O5", " UNION ALL ".join(CHI.format(c=c).replace("GROUP BY l_returnflag", "GROUP BY l_partkey") for c in ("l_quantity", "l_tax")))
def score_chi2_many_classes(spark, sf):
    return rounded(_scores(spark, S.univariate_scores(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "l_partkey", "chi2")), "score")


@query("O6", """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM lineitem),
  b AS (SELECT len(list_filter(e, lambda x: x < l_extendedprice)) AS b, l_returnflag AS y FROM lineitem, e), n AS (SELECT count(*)::DOUBLE AS n FROM b),
  c AS (SELECT b, y, count(*) AS k FROM b GROUP BY 1, 2), x AS (SELECT b, sum(k) AS kb FROM c GROUP BY 1), y AS (SELECT y, sum(k) AS ky FROM c GROUP BY 1)
  SELECT 'l_extendedprice' AS "column", round(sum(k / n * ln(k * n / (kb * ky))), 9) AS score FROM c JOIN x USING (b) JOIN y USING (y), n""")
def score_mutual_information(spark, sf):
    return rounded(_scores(spark, S.univariate_scores(table(spark, sf, "lineitem"), ["l_extendedprice"], "l_returnflag", "binned_mutual_info_classif")), "score", digits=9)


#: per column: the third nearest of its class among three rows on either side, counts by running totals, psi by harmonic sums
INFO = """SELECT '{c}' AS "column", round(greatest(0, (SELECT h FROM psi WHERE m = (SELECT count(*) FROM v)) + avg(k.h - y.h - a.h)), 6) AS score FROM (
  SELECT r, ny, CASE WHEN r = 0 THEN same - 1 ELSE least(3, ny - 1) END AS kth, CASE WHEN r = 0 THEN eq.n - 1 ELSE hi.cum - coalesce(lo.cum, 0) END AS m FROM (
    SELECT *, x - greatest(r - (abs(x) + r) * 1e-12, r / 2) AS lower, x + greatest(r - (abs(x) + r) * 1e-12, r / 2) AS upper FROM (
      SELECT x, y, ny, same, list_sort(list_filter([x - l1, x - l2, x - l3, r1 - x, r2 - x, r3 - x], lambda d: d IS NOT NULL))[least(3, ny - 1)] AS r FROM (
        SELECT x, y, count(*) OVER (PARTITION BY y) AS ny, count(*) OVER (PARTITION BY x, y) AS same, lag(x, 1) OVER o AS l1, lag(x, 2) OVER o AS l2, lag(x, 3) OVER o AS l3,
          lead(x, 1) OVER o AS r1, lead(x, 2) OVER o AS r2, lead(x, 3) OVER o AS r3 FROM v{i} WINDOW o AS (PARTITION BY y ORDER BY x)))) s
  JOIN t{i} eq USING (x) ASOF LEFT JOIN t{i} lo ON s.lower >= lo.x ASOF LEFT JOIN t{i} hi ON s.upper > hi.x) z
  JOIN psi k ON k.m = z.kth JOIN psi y ON y.m = z.ny JOIN psi a ON a.m = z.m"""
INFO_COLUMNS = {"l_extendedprice": "l_extendedprice", "level": "floor(l_extendedprice / 10000)"}
INFO_CLASS = "floor(l_extendedprice / 20000 + l_quantity / 25)"
INFO_SQL = "WITH v AS (SELECT * FROM lineitem), psi AS (SELECT i + 1 AS m, sum(CASE WHEN i = 0 THEN 0 ELSE 1.0::DOUBLE / i END) OVER (ORDER BY i) AS h FROM (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS i)), " + ", ".join(
    f"v{i} AS (SELECT {e}::DOUBLE AS x, {INFO_CLASS} AS y FROM lineitem), t{i} AS (SELECT x, count(*) AS n, sum(count(*)) OVER (ORDER BY x) AS cum FROM v{i} GROUP BY x)" for i, e in enumerate(INFO_COLUMNS.values())
) + " " + " UNION ALL ".join(INFO.format(c=c, i=i) for i, c in enumerate(INFO_COLUMNS))


@query("O6", INFO_SQL)
def score_neighbour_information(spark, sf):
    li = table(spark, sf, "lineitem").select(F.expr(INFO_CLASS).alias("class"), *[F.expr(e).cast("double").alias(c) for c, e in INFO_COLUMNS.items()])
    return rounded(_scores(spark, S.univariate_scores(li, list(INFO_COLUMNS), "class", "mutual_info_classif")), "score")


@query("O7", """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE (SELECT abs(corr(l_quantity, y)) > greatest(abs(corr(l_discount, y)), abs(corr(l_tax, y))) FROM (SELECT *, l_quantity + 100 * l_tax AS y FROM lineitem))""")
def select_k_best(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_quantity") + 100 * F.col("l_tax")).alias("y"))
    d = fit_apply("UnivariateSelection", li, columns=["l_quantity", "l_discount", "l_tax"], target_column="y", method="SelectKBest", k=1)
    return d.drop("y")


@query("O7", """WITH l AS (SELECT *, l_quantity + 100 * l_tax AS y FROM lineitem), f AS (SELECT 'l_quantity' AS c, abs(corr(l_quantity, y)) * sqrt(count(*)) AS z FROM l UNION ALL SELECT 'l_discount', abs(corr(l_discount, y)) * sqrt(count(*)) FROM l
  UNION ALL SELECT 'l_tax', abs(corr(l_tax, y)) * sqrt(count(*)) FROM l) SELECT c AS "column" FROM f WHERE z > 2.4""")
def select_by_error_rates(spark, sf):
    keep, li = None, table(spark, sf, "lineitem").withColumn("y", F.col("l_quantity") + 100 * F.col("l_tax"))
    for m in ("select_fpr", "select_fdr", "select_fwe"):
        art = fit("UnivariateSelection", li, columns=["l_quantity", "l_discount", "l_tax"], target_column="y", method=m)
        keep = art["selected_columns"] if keep is None else [c for c in keep if c in art["selected_columns"]]
    return spark.createDataFrame([(c,) for c in keep], "column string")


@query("O8")
def select_from_model(spark, sf):
    art = fit("ModelBasedSelection", table(spark, sf, "lineitem"), columns=["l_quantity", "l_discount", "l_tax"], target_column="l_extendedprice", threshold="median")
    return spark.createDataFrame([(c, round(v, 4), c in art["selected_columns"]) for c, v in art["importances"].items()], "column string, importance double, kept boolean")


@query("O9")
def select_by_elimination(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("y", (F.col("l_quantity") > 25).cast("int"))
    art = fit("ModelBasedSelection", d, columns=["l_quantity", "l_discount", "l_tax"], target_column="y", method="rfe", estimator="random_forest", n_features_to_select=1)
    return spark.createDataFrame([(c,) for c in art["selected_columns"]], "column string")


@query("O10", """SELECT 'o_orderstatus' AS "column", 'classification' AS kind, count(*)::BIGINT AS rows FROM orders UNION ALL SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) <= 10 THEN 'classification' ELSE 'regression' END, count(*)::BIGINT FROM orders
  UNION ALL SELECT 'digit', CASE WHEN count(DISTINCT o_orderkey % 10) <= 10 THEN 'classification' ELSE 'regression' END, count(*)::BIGINT FROM orders
  UNION ALL SELECT 'eleven', CASE WHEN count(DISTINCT o_orderkey % 11) <= 10 THEN 'classification' ELSE 'regression' END, count(*)::BIGINT FROM orders""")
def problem_type(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 10).alias("digit"), (F.col("o_orderkey") % 11).alias("eleven"))
    n = o.count()
    return spark.createDataFrame([(c, S.guess_problem_type(o, c), n) for c in o.columns], "column string, kind string, rows long")
