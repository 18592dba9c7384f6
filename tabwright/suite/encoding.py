"""Categorical encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import apply, fit, fit_apply, fit_apply_train, q
from ..operators.encoding import decode_labels
from .base import HOLES, holes, query, r6, rounded, table


@query("I1", f"""SELECT o_orderkey, (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::TINYINT AS "o_orderpriority_1-URGENT",
  (CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END)::TINYINT AS "o_orderpriority_2-HIGH",
  (CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END)::TINYINT AS "o_orderpriority_5-LOW",
  (CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END)::TINYINT AS "o_orderpriority___mlops_missing__" FROM {HOLES}""")
def encode_one_hot(spark, sf):
    d = fit_apply("OneHotEncoder", holes(spark, sf), columns=["o_orderpriority"], include_missing=True)
    return d.select("o_orderkey", *[q(f"o_orderpriority_{v}") for v in ("1-URGENT", "2-HIGH", "5-LOW", "__mlops_missing__")])


@query("I1", """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT p_brand, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM c)
  SELECT p_partkey, coalesce(sum(CASE WHEN k > 4 THEN 1 ELSE 0 END), 0)::BIGINT AS folded, coalesce(sum(CASE WHEN k <= 4 THEN 1 ELSE 0 END), 0)::BIGINT AS shown
  FROM part LEFT JOIN r USING (p_brand) GROUP BY 1""")
def encode_one_hot_folded(spark, sf):
    d = fit_apply("OneHotEncoder", table(spark, sf, "part"), columns=["p_brand"], max_categories=5)
    shown = [c for c in d.columns if c.startswith("p_brand_") and not c.endswith("infrequent_sklearn")]
    total = F.lit(0)
    for c in shown:
        total = total + q(c)
    return d.select("p_partkey", q("p_brand_infrequent_sklearn").cast("bigint").alias("folded"), total.cast("bigint").alias("shown"))


@query("I2", """SELECT c_custkey, (c_mktsegment = 'BUILDING')::INTEGER AS c_mktsegment_BUILDING, (c_mktsegment = 'MACHINERY')::INTEGER AS c_mktsegment_MACHINERY FROM customer""")
def encode_dummy(spark, sf):
    d = fit_apply("DummyEncoder", table(spark, sf, "customer"), columns=["c_mktsegment"], drop_first=True)
    return d.select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_MACHINERY")


@query("I3", f"""SELECT o_orderkey, (dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1)::BIGINT AS o_orderpriority FROM {HOLES}""")
def encode_label(spark, sf):
    return fit_apply("LabelEncoder", holes(spark, sf), columns=["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("I3", """WITH m AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) - 1 AS k FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey < 1))
  SELECT c_custkey, coalesce(k, -7)::BIGINT AS name FROM (SELECT *, CASE WHEN c_nationkey < 1 THEN c_mktsegment ELSE c_mktsegment || 'X' END AS nm FROM customer) LEFT JOIN m ON nm = s""")
def encode_label_unseen(spark, sf):
    c = table(spark, sf, "customer")
    art = fit("LabelEncoder", c.where("c_nationkey < 1").select(q("c_mktsegment").alias("name")), columns=["name"], missing_code=-7)
    d = c.select("c_custkey", F.when(F.col("c_nationkey") < 1, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit("X"))).alias("name"))
    return apply(d, art)


@query("I4", f"""SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0.0::DOUBLE WHEN '3-MEDIUM' THEN 1.0::DOUBLE WHEN '1-URGENT' THEN 2.0::DOUBLE ELSE -1.0::DOUBLE END AS o_orderpriority,
  (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS o_orderstatus FROM {HOLES}""")
def encode_ordinal(spark, sf):
    d = fit_apply("OrdinalEncoder", holes(spark, sf), columns=["o_orderpriority", "o_orderstatus"],
                  categories_order={"o_orderpriority": ["5-LOW", "3-MEDIUM", "1-URGENT"]})
    return d.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("I5", f"""SELECT o_orderkey, ('0x' || substr(md5(coalesce(o_orderpriority, 'nan')), 1, 8))::BIGINT % 10 AS o_orderpriority FROM {HOLES}""")
def encode_hash(spark, sf):
    return fit_apply("HashEncoder", holes(spark, sf), columns=["o_orderpriority"], hash="md5").select("o_orderkey", "o_orderpriority")


@query("I6", """WITH b AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, 'nan') AS k FROM orders),
  s AS (SELECT avg(y) AS mu, var_pop(y) AS v FROM b), g AS (SELECT k, count(*) AS n, avg(y) AS m, var_pop(y) AS w FROM b GROUP BY k),
  e AS (SELECT k, (v / (v + w / n)) * m + (1 - v / (v + w / n)) * mu AS e FROM g, s)
  SELECT o_orderkey, round(e, 6) AS o_orderpriority FROM b JOIN e USING (k)""")
def encode_target_auto(spark, sf):
    d = holes(spark, sf).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(fit_apply("TargetEncoder", d, columns=["o_orderpriority"], target_column="y").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("I6", """WITH g AS (SELECT l_returnflag AS k, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_partkey, l_linenumber, round((n * m + 100.0 * (SELECT avg(l_extendedprice) FROM lineitem)) / (n + 100.0), 6) AS l_returnflag
  FROM lineitem JOIN g ON l_returnflag = k""")
def encode_target_smooth(spark, sf):
    d = fit_apply("TargetEncoder", table(spark, sf, "lineitem"), columns=["l_returnflag"], target_column="l_extendedprice", smooth=100.0)
    return rounded(d.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@query("I6", """WITH g AS (SELECT c_mktsegment AS k, count(*) AS n, avg((c_nationkey % 3 = 0)::INT) AS m0, avg((c_nationkey % 3 = 1)::INT) AS m1, avg((c_nationkey % 3 = 2)::INT) AS m2 FROM customer GROUP BY 1),
  s AS (SELECT avg((c_nationkey % 3 = 0)::INT) AS u0, avg((c_nationkey % 3 = 1)::INT) AS u1, avg((c_nationkey % 3 = 2)::INT) AS u2 FROM customer)
  SELECT c_custkey, round((n * m0 + 10 * u0) / (n + 10), 6) AS c_mktsegment_cls0, round((n * m1 + 10 * u1) / (n + 10), 6) AS c_mktsegment_cls1,
   round((n * m2 + 10 * u2) / (n + 10), 6) AS c_mktsegment_cls2 FROM customer JOIN g ON c_mktsegment = k, s""")
def encode_target_multiclass(spark, sf):
    d = table(spark, sf, "customer").withColumn("y", (F.col("c_nationkey") % 3).cast("string"))
    d = fit_apply("TargetEncoder", d, columns=["c_mktsegment"], target_column="y", smooth=10)
    cols = [f"c_mktsegment_cls{i}" for i in range(3)]
    return rounded(d.select("c_custkey", *cols), *cols)


@query("I7", """WITH b AS (SELECT o_orderkey, o_orderpriority AS k, o_totalprice AS y, ('0x' || substr(md5(o_orderkey::VARCHAR || ':42'), 1, 13))::BIGINT % 5 AS f FROM orders),
  t AS (SELECT k, f, count(*) AS n, sum(y) AS s FROM b GROUP BY 1, 2), tt AS (SELECT k, sum(n) AS n, sum(s) AS s FROM t GROUP BY 1),
  ff AS (SELECT f, sum(n) AS n, sum(s) AS s FROM t GROUP BY 1), a AS (SELECT sum(n) AS n, sum(s) AS s FROM t)
  SELECT o_orderkey, round((tt.s - t.s + 20 * (a.s - ff.s) / (a.n - ff.n)) / (tt.n - t.n + 20), 4) AS o_orderpriority
  FROM b JOIN t USING (k, f) JOIN tt USING (k) JOIN ff USING (f), a""")
def encode_target_cross_fit(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    _, d = fit_apply_train("TargetEncoder", o, columns=["o_orderpriority"], target_column="o_totalprice", smooth=20, key_columns=["o_orderkey"])
    return rounded(d.select("o_orderkey", "o_orderpriority"), "o_orderpriority", digits=4)


WOE = f"""WITH b AS (SELECT o_orderkey, coalesce(o_orderpriority, 'nan') AS k, (o_orderstatus = 'F')::INT AS y FROM {HOLES}),
  s AS (SELECT sum(y) AS p, sum(1 - y) AS g FROM b), w AS (SELECT k, (sum(1 - y) + 0.5) / (g + 0.5) AS dn, (sum(y) + 0.5) / (p + 0.5) AS dp FROM b, s GROUP BY k, g, p)"""


@query("I8", WOE + " SELECT o_orderkey, round(ln(dn / dp), 6) + 0.0::DOUBLE AS o_orderpriority FROM b JOIN w USING (k)")
def encode_woe(spark, sf):
    d = holes(spark, sf).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(fit_apply("WOEEncoder", d, columns=["o_orderpriority"], target_column="y").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("I9", WOE + " SELECT 'o_orderpriority' AS \"column\", round(sum((dn - dp) * ln(dn / dp)), 9) AS iv FROM w")
def information_value(spark, sf):
    d = holes(spark, sf).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    art = fit("WOEEncoder", d, columns=["o_orderpriority"], target_column="y")
    return spark.createDataFrame([(c, v) for c, v in art["iv"].items()], "column string, iv double").select("column", r6("iv", 9).alias("iv"))


@query("I11", "SELECT o_orderkey, o_orderpriority AS decoded FROM orders")
def decode_label_codes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    art = fit("LabelEncoder", o, columns=["o_orderpriority"])
    return decode_labels(apply(o, art), "o_orderpriority", art, "o_orderpriority", "decoded").select("o_orderkey", "decoded")
