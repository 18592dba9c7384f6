"""Aggregates, correlations, expectations, drift, profiles and advice."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..core import fit, num, q
from ..profiling import advice as AD, aggregates as A, correlations as C, drift as DR, expectations as X, monitoring as MON, profile as P
from .base import HOLES, LINE_HOLES, holes, line_holes, query, r6, rounded, table


@query("E1", """SELECT 'Total' AS name, round(sum(l_extendedprice), 2) AS value, count(*)::BIGINT AS count, 1.0::DOUBLE AS ratio FROM lineitem WHERE l_returnflag = 'R'""")
def decompose_total(spark, sf):
    d = A.decompose(table(spark, sf, "lineitem"), "l_extendedprice", "sum", filters=[{"column": "l_returnflag", "operator": "==", "value": "R"}])
    return rounded(d, "value", digits=2)


@query("E2", f"""WITH g AS (SELECT coalesce(o_orderpriority, 'Unknown') AS name, coalesce(sum(o_totalprice), 0) AS value, count(*)::BIGINT AS count FROM {HOLES} GROUP BY 1)
  SELECT name, round(value, 2) AS value, count, round(value / sum(value) OVER (), 9) AS ratio FROM g""")
def decompose_split(spark, sf):
    d = A.decompose(holes(spark, sf), "o_totalprice", "sum", "o_orderpriority")
    return rounded(rounded(d, "value", digits=2), "ratio", digits=9)


@query("E2", """WITH g AS (SELECT event_type AS name, round(avg(value), 6) AS value, count(*)::BIGINT AS count FROM events GROUP BY 1)
  SELECT name, value, count, round(value / sum(value) OVER (), 6) AS ratio FROM g""")
def decompose_mean(spark, sf):
    d = A.decompose(table(spark, sf, "events"), "value", "mean", "event_type")
    return rounded(d, "value", "ratio")


@query("E4", f"""
  SELECT 'o_totalprice' AS "column", (count(*) - count(o_totalprice))::BIGINT AS null_count, (count(DISTINCT o_totalprice) + 1)::BIGINT AS distinct_count FROM {HOLES}
  UNION ALL SELECT 'o_orderpriority', (count(*) - count(o_orderpriority))::BIGINT, (count(DISTINCT o_orderpriority) + 1)::BIGINT FROM {HOLES}
  UNION ALL SELECT 'o_orderstatus', 0::BIGINT, count(DISTINCT o_orderstatus)::BIGINT FROM {HOLES}""")
def profile_basic(spark, sf):
    return A.basic_profile(holes(spark, sf), ["o_totalprice", "o_orderpriority", "o_orderstatus"])


def _num_sql(c):
    return f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std, round(var_samp({c}), 4) AS variance,
  min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, max(CASE WHEN r = floor(0.25 * (n - 1) + 0.5) THEN {c} END)::DOUBLE AS q25, max(CASE WHEN r = floor(0.75 * (n - 1) + 0.5) THEN {c} END)::DOUBLE AS q75,
  round(avg(pow({c} - m, 3)) / pow(var_pop({c}), 1.5), 6) + 0.0::DOUBLE AS skewness, round(kurtosis_pop({c}), 6) + 0.0::DOUBLE AS kurtosis, sum(({c} = 0)::INT)::BIGINT AS zeros, sum(({c} < 0)::INT)::BIGINT AS negatives
  FROM (SELECT *, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n, avg({c}) OVER () AS m FROM customer)"""


@query("E5", _num_sql("c_acctbal") + " UNION ALL " + _num_sql("c_nationkey"))
def profile_numeric(spark, sf):
    d = A.numeric_profile(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return rounded(rounded(d, "mean", "median", "std", "skewness", "kurtosis"), "variance", digits=4)


@query("E6", """WITH c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1)
  SELECT count(*)::BIGINT AS "distinct", sum((n < 5)::INT)::BIGINT AS rare_labels, (SELECT string_agg(v || ':' || n, ',' ORDER BY n DESC, v) FROM (SELECT * FROM c ORDER BY n DESC, v LIMIT 10)) AS top FROM c""")
def profile_categorical(spark, sf):
    return A.categorical_profile(table(spark, sf, "part"), "p_name")


@query("E7", """SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d') AS max_date, datediff('day', min(o_orderdate), max(o_orderdate))::BIGINT AS duration_days FROM orders""")
def profile_dates(spark, sf):
    d = A.date_profile(table(spark, sf, "orders"), "o_orderdate")
    return d.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("min_date", "max_date")], "duration_days")


@query("E8", """SELECT round(avg(strlen(text)), 6) AS avg_length, min(strlen(text))::INTEGER AS min_length, max(strlen(text))::INTEGER AS max_length FROM documents""")
def profile_text(spark, sf):
    return rounded(A.text_profile(table(spark, sf, "documents"), "text"), "avg_length")


@query("E9", """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), e AS (SELECT list_transform(range(20), lambda i: lo + i * ((hi - lo) / 20)) || [hi] AS e FROM m),
  b AS (SELECT greatest(len(list_filter(e, lambda x: x < l_extendedprice)) - 1, 0) AS bin FROM lineitem, e)
  SELECT i::INTEGER AS bin, round(e[i + 1], 6) AS start, round(e[i + 2], 6) AS "end", (SELECT count(*) FROM b WHERE bin = i)::BIGINT AS count FROM e, range(20) t(i)""")
def histogram_price(spark, sf):
    return rounded(A.histogram(table(spark, sf, "lineitem"), "l_extendedprice"), "start", "end")


@query("E10", """WITH x AS (SELECT strlen(text)::DOUBLE AS v FROM documents), m AS (SELECT min(v) AS lo, max(v) AS hi FROM x), e AS (SELECT list_transform(range(10), lambda i: lo + i * ((hi - lo) / 10)) || [hi] AS e FROM m),
  b AS (SELECT least(len(list_filter(e, lambda y: y <= v)) - 1, 9) AS bin FROM x, e)
  SELECT i::INTEGER AS bin, round(e[i + 1], 6) AS start, round(e[i + 2], 6) AS "end", (SELECT count(*) FROM b WHERE bin = i)::BIGINT AS count FROM e, range(10) t(i)""")
def histogram_text_lengths(spark, sf):
    return rounded(A.histogram10(table(spark, sf, "documents"), F.octet_length("text")), "start", "end")


@query("E10", """WITH x AS (SELECT epoch_ms(ts)::DOUBLE AS v FROM events), m AS (SELECT min(v) AS lo, max(v) AS hi FROM x), e AS (SELECT list_transform(range(10), lambda i: lo + i * ((hi - lo) / 10)) || [hi] AS e FROM m),
  b AS (SELECT least(len(list_filter(e, lambda y: y <= v)) - 1, 9) AS bin FROM x, e)
  SELECT i::INTEGER AS bin, (SELECT count(*) FROM b WHERE bin = i)::BIGINT AS count FROM e, range(10) t(i)""")
def histogram_dates(spark, sf):
    return A.histogram10(table(spark, sf, "events"), F.unix_millis(F.col("ts").cast("timestamp"))).select("bin", "count")


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CW = f"(SELECT * FROM {LINE_HOLES} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)"


@query("E11", " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({'min(1.0::DOUBLE)' if a == b else f'corr({a}, {b})'}, 6) + 0.0::DOUBLE AS r FROM {CW}" for a in COLS for b in COLS))
def correlation_matrix_rows(spark, sf):
    return rounded(C.profile_correlations(line_holes(spark, sf).select(*COLS)), "r")


def _pairs(m, cols):
    return [(a, cols[j], float(m[i, j])) for i, a in enumerate(cols) for j in range(i + 1, len(cols))]


def _spearman(a, b):
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(ra, rb), 6) + 0.0::DOUBLE AS r FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rb FROM (SELECT {a} AS x, {b} AS y FROM {LINE_HOLES} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""


@query("E12", " UNION ALL ".join(_spearman(a, b) for a, b in [("l_extendedprice", "l_tax"), ("l_extendedprice", "l_discount"), ("l_tax", "l_discount")]))
def correlation_spearman(spark, sf):
    cols = ["l_extendedprice", "l_tax", "l_discount"]
    m = C.spearman_matrix(line_holes(spark, sf), cols)
    return rounded(spark.createDataFrame(_pairs(m, cols), "column_a string, column_b string, r double"), "r")


@query("E12", """WITH c AS (SELECT p_size AS x, p_retailprice AS y, count(*) AS w FROM part GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM part),
  s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.w * b.w) / 2 AS s FROM c a, c b),
  tx AS (SELECT sum(k * (k - 1)) / 2.0 AS t FROM (SELECT count(*) AS k FROM part GROUP BY p_size)), ty AS (SELECT sum(k * (k - 1)) / 2.0 AS t FROM (SELECT count(*) AS k FROM part GROUP BY p_retailprice))
  SELECT round(s / sqrt((n * (n - 1) / 2.0 - tx.t) * (n * (n - 1) / 2.0 - ty.t)), 9) AS tau FROM s, n, tx, ty""")
def correlation_kendall(spark, sf):
    tau = C.kendall_tau(table(spark, sf, "part"), q("p_size"), q("p_retailprice"), rows_per_bucket=300)
    return rounded(spark.createDataFrame([(tau,)], "tau double"), "tau", digits=9)


@query("E13", """SELECT 'l_quantity' AS "column", round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 6) AS vif FROM lineitem
  UNION ALL SELECT 'l_extendedprice', round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 6) FROM lineitem""")
def variance_inflation(spark, sf):
    v = C.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(spark.createDataFrame(list(v.items()), "column string, vif double"), "vif")


@query("E14", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) + 0.0::DOUBLE AS r FROM {LINE_HOLES}" for c in ("l_quantity", "l_discount", "l_tax")))
def target_correlation(spark, sf):
    return rounded(C.target_correlations(line_holes(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), "r")


ETA = """SELECT '{c}' AS "column", round(sqrt(sum(n * pow(m - g, 2)) / (SELECT sum(pow({c} - (SELECT avg({c}) FROM lineitem), 2)) FROM lineitem)), 6) AS eta FROM
  (SELECT count(*) AS n, avg({c}) AS m, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag)"""


@query("E15", " UNION ALL ".join(ETA.format(c=c) for c in ("l_quantity", "l_extendedprice")))
def correlation_ratio(spark, sf):
    return rounded(C.correlation_ratio(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]), "eta")


@query("E16", """WITH r AS (SELECT event_type AS g, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT 'value' AS "column", g AS "group", min(v) AS min, max(CASE WHEN r = floor(0.25 * (n - 1) + 0.5) THEN v END) AS q1, max(CASE WHEN r = floor(0.5 * (n - 1) + 0.5) THEN v END) AS median,
  max(CASE WHEN r = floor(0.75 * (n - 1) + 0.5) THEN v END) AS q3, max(v) AS max FROM r GROUP BY g""")
def box_plot_groups(spark, sf):
    return A.box_plots(table(spark, sf, "events"), "event_type", ["value"])


@query("E16", """WITH r AS (SELECT c_nationkey AS g, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
  SELECT 'c_acctbal' AS "column", CAST(g AS VARCHAR) AS "group", min(v) AS min, max(CASE WHEN r = floor(0.25 * (n - 1) + 0.5) THEN v END) AS q1, max(CASE WHEN r = floor(0.5 * (n - 1) + 0.5) THEN v END) AS median,
  max(CASE WHEN r = floor(0.75 * (n - 1) + 0.5) THEN v END) AS q3, max(v) AS max FROM r GROUP BY g""")
def box_plot_many_groups(spark, sf):
    return A.box_plots(table(spark, sf, "customer"), "c_nationkey", ["c_acctbal"])


F_SQL = """SELECT '{c}' AS "column", round((sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(q) / (sum(n) - count(*))), 6) AS f FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) * count({c}) AS q,
  (SELECT avg({c}) FROM {t}) AS g FROM {t} GROUP BY {y})"""


@query("E17 O3", " UNION ALL ".join(F_SQL.format(c=c, t="lineitem", y="l_returnflag") for c in ("l_quantity", "l_extendedprice", "l_tax")))
def anova_f(spark, sf):
    a = C.anova(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(spark.createDataFrame([(c, f) for c, (f, _) in a.items()], "column string, f double"), "f")


@query("E18", """WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus) SELECT count(*)::BIGINT AS classes, min(n)::BIGINT AS min_count, max(n)::BIGINT AS max_count, round(min(n) / max(n), 6) AS ratio,
  CASE WHEN min(n) / max(n) < 0.2 THEN 'resample' WHEN min(n) / max(n) > 0.8 THEN 'balanced' ELSE 'none' END AS advice FROM c""")
def class_balance(spark, sf):
    return rounded(A.class_balance(table(spark, sf, "orders"), "o_orderstatus"), "ratio")


@query("E19", """WITH c AS (SELECT c_nationkey % 4 AS cluster, * FROM customer), g AS (SELECT avg(c_acctbal) AS ma, stddev_samp(c_acctbal) AS sa, avg(c_nationkey) AS mn, stddev_samp(c_nationkey) AS sn FROM customer),
  p AS (SELECT cluster, count(*)::BIGINT AS size, avg(c_acctbal) AS a, avg(c_nationkey) AS n FROM c GROUP BY 1)
  SELECT cluster::INTEGER AS cluster, size, round(a, 6) AS c_acctbal, round(n, 6) AS c_nationkey, CASE WHEN abs((a - ma) / sa) >= abs((n - mn) / sn) THEN la || ', ' || ln ELSE ln || ', ' || la END AS label FROM
  (SELECT *, CASE WHEN a >= ma THEN 'High c_acctbal' ELSE 'Low c_acctbal' END AS la, CASE WHEN n >= mn THEN 'High c_nationkey' ELSE 'Low c_nationkey' END AS ln FROM p, g)""")
def cluster_profile(spark, sf):
    c = table(spark, sf, "customer").withColumn("cl", F.col("c_nationkey") % 4)
    return rounded(A.cluster_profile(c, "cl", ["c_acctbal", "c_nationkey"]), "c_acctbal", "c_nationkey")


@query("E20", """SELECT p_brand AS a, (p_size // 10)::INTEGER AS b, count(*)::BIGINT AS count FROM part GROUP BY 1, 2""")
def crosstab_brand_size(spark, sf):
    return A.crosstab(table(spark, sf, "part").withColumn("s", F.floor(F.col("p_size") / 10).cast("int")), "p_brand", "s")


@query("E24", f"""SELECT count(*)::BIGINT AS rows, 5::INTEGER AS columns, (2 * count(*) - count(o_totalprice) - count(o_orderpriority))::BIGINT AS missing_cells,
  round(100.0 * (2 * count(*) - count(o_totalprice) - count(o_orderpriority)) / (5 * count(*)), 6) AS missing_percent FROM {HOLES}""")
def missing_cells(spark, sf):
    return rounded(A.missing_cells(holes(spark, sf)), "missing_percent")


@query("E25", f"""WITH q AS (SELECT 'o_totalprice' AS "column", (count(*) - count(o_totalprice))::BIGINT AS null_count, count(DISTINCT o_totalprice)::BIGINT AS unique_count, count(o_totalprice) / count(*) AS quality,
   min(o_totalprice) AS min, max(o_totalprice) AS max, avg(o_totalprice) AS mean FROM {HOLES}
  UNION ALL SELECT 'o_orderpriority', (count(*) - count(o_orderpriority))::BIGINT, count(DISTINCT o_orderpriority)::BIGINT, count(o_orderpriority) / count(*), NULL, NULL, NULL FROM {HOLES})
  SELECT "column", null_count, round(100 * (1 - quality), 6) AS null_percentage, unique_count, round(quality, 6) AS quality, min, max, round(mean, 6) AS mean, round(avg(quality) OVER (), 6) AS overall FROM q""")
def quality_score(spark, sf):
    d = A.quality_report(holes(spark, sf).select("o_totalprice", "o_orderpriority"))
    return rounded(d, "null_percentage", "quality", "mean", "overall")


@query("E26", f"""SELECT 'o_totalprice' AS "column", 'double' AS type, (count(*) - count(o_totalprice))::BIGINT AS null_count, (count(DISTINCT o_totalprice) + 1)::BIGINT AS unique_count, round(avg(o_totalprice), 6) AS mean,
  round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.5), 6) AS median, NULL::VARCHAR AS top_values FROM {HOLES}
  UNION ALL SELECT 'o_orderpriority', 'string', (count(*) - count(o_orderpriority))::BIGINT, (count(DISTINCT o_orderpriority) + 1)::BIGINT, NULL, NULL, NULL, NULL, NULL,
   (SELECT string_agg(v || ':' || n, ',' ORDER BY n DESC, v) FROM (SELECT o_orderpriority AS v, count(*) AS n FROM {HOLES} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) FROM {HOLES}""")
def ingest_profile(spark, sf):
    d = A.ingest_profile(holes(spark, sf).select("o_totalprice", "o_orderpriority")).drop("null_percentage")
    return rounded(d, "mean", "std", "median")


@query("E27", """SELECT 'l_quantity' AS "column", count(l_quantity)::BIGINT AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25,
  quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max FROM lineitem UNION ALL SELECT 'l_extendedprice', count(*)::BIGINT, round(avg(l_extendedprice), 6), round(stddev_samp(l_extendedprice), 6),
  min(l_extendedprice), round(quantile_cont(l_extendedprice, 0.25), 6), round(quantile_cont(l_extendedprice, 0.5), 6), round(quantile_cont(l_extendedprice, 0.75), 6), max(l_extendedprice) FROM lineitem""")
def dataset_profile(spark, sf):
    art = fit("DatasetProfile", table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"))
    rows = [(c, int(s["count"]), s["mean"], s["std"], s["min"], s["25%"], s["50%"], s["75%"], s["max"]) for c, s in art["numeric_stats"].items()]
    d = spark.createDataFrame(rows, "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    return rounded(d, "mean", "std", "q25", "q50", "q75")


# --- expectations ----------------------------------------------------------------------------

def _outcome(fn, *a, **k):
    try:
        fn(*a, **k)
        return "ok"
    except X.ExpectationError:
        return "broken"


@query("Q1", "SELECT 'ok' AS present, 'broken' AS absent, count(*)::BIGINT AS rows FROM orders")
def expect_columns(spark, sf):
    o = table(spark, sf, "orders")
    return o.agg(F.lit(_outcome(X.expect_columns_exist, o, ["o_orderkey"])).alias("present"), F.lit(_outcome(X.expect_columns_exist, o, ["nope"])).alias("absent"), F.count("*").alias("rows"))


@query("Q2", f"""SELECT 'o_totalprice' AS "column", sum((o_totalprice IS NULL)::INT)::BIGINT AS nulls FROM {HOLES} UNION ALL SELECT 'o_orderkey', sum((o_orderkey IS NULL)::INT)::BIGINT FROM {HOLES}""")
def expect_no_nulls(spark, sf):
    d = holes(spark, sf)
    assert _outcome(X.expect_no_nulls, d, ["o_totalprice"]) == "broken" and _outcome(X.expect_no_nulls, d, ["o_orderkey"]) == "ok"
    return X.null_counts(d, ["o_totalprice", "o_orderkey"])


@query("Q3", """SELECT min(c_acctbal) AS min, max(c_acctbal) AS max, sum((c_acctbal < 0 OR c_acctbal > 9000)::INT)::BIGINT AS violations FROM customer""")
def expect_value_range(spark, sf):
    return X.value_range(table(spark, sf, "customer"), "c_acctbal", 0, 9000)


@query("Q14", """SELECT 'missing' AS kind, 'o_clerk' AS "column", 'string' AS expected, NULL::VARCHAR AS actual, count(*)::BIGINT AS rows FROM orders UNION ALL SELECT 'dtype', 'o_custkey', 'int', 'bigint', count(*)::BIGINT FROM orders
  UNION ALL SELECT 'extra', 'o_orderdate', NULL, NULL, count(*)::BIGINT FROM orders""")
def schema_contract(spark, sf):
    from pyspark.sql import types as T
    o = table(spark, sf, "orders")
    expected = T.StructType([f for f in o.schema if f.name not in ("o_orderdate", "o_custkey")]).add("o_custkey", T.IntegerType()).add("o_clerk", T.StringType())
    d = X.schema_contract(o, expected).where("kind <> 'order'")
    d = d.withColumn("expected", F.when(q("kind") == "missing", "string").otherwise(q("expected")))
    return d.join(F.broadcast(o.agg(F.count("*").alias("rows"))))


# --- drift -----------------------------------------------------------------------------------

def _halves(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.col("value") * 1.2 + 3))
    half = F.col("event_id") % 2 == 0
    return e.where(half), e.where(~half)


BOTH = "(SELECT *, event_id % 2 = 0 AS ref, CASE WHEN event_id % 2 = 0 THEN value ELSE value * 1.2 + 3 END AS v FROM events)"
BINS = f"""e AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM {BOTH} WHERE ref),
  b AS (SELECT ref, least(greatest(len(list_filter(e, lambda x: x <= v)), 1), len(e) - 1) AS bin FROM {BOTH}, e),
  s AS (SELECT i, CASE WHEN r = 0 THEN 0.0001 ELSE r END AS r, CASE WHEN c = 0 THEN 0.0001 ELSE c END AS c FROM (SELECT i, (SELECT count(*) FROM b WHERE bin = i AND ref) / (SELECT count(*) FROM b WHERE ref)::DOUBLE AS r,
   (SELECT count(*) FROM b WHERE bin = i AND NOT ref) / (SELECT count(*) FROM b WHERE NOT ref)::DOUBLE AS c FROM range(1, 11) t(i)))"""


@query("Q5 Q6", f"WITH {BINS} SELECT round(sum((c - r) * ln(c / r)), 6) AS psi, round(sum(c / (SELECT sum(c) FROM s) * ln((c / (SELECT sum(c) FROM s)) / (r / (SELECT sum(r) FROM s)))), 6) AS kl FROM s")
def drift_psi_kl(spark, sf):
    a, b = _halves(spark, sf)
    s = DR.binned_shares(a, b, ["value"])["value"]
    return rounded(spark.createDataFrame([(DR.psi(*s), DR.kl(*s))], "psi double, kl double"), "psi", "kl")


@query("Q7 Q8", f"""WITH c AS (SELECT v, sum(sum(ref::INT)) OVER (ORDER BY v) / (SELECT count(*) FROM {BOTH} WHERE ref)::DOUBLE AS f, sum(sum((NOT ref)::INT)) OVER (ORDER BY v) / (SELECT count(*) FROM {BOTH} WHERE NOT ref)::DOUBLE AS g,
  lead(v) OVER (ORDER BY v) AS nx FROM {BOTH} GROUP BY v) SELECT round(max(abs(f - g)), 6) AS ks, round(sum(abs(f - g) * (nx - v)), 6) AS wasserstein FROM c""")
def drift_ks_wasserstein(spark, sf):
    d, w, _, _ = DR.distribution_distance(*_halves(spark, sf), "value")
    return rounded(spark.createDataFrame([(d, w)], "ks double, wasserstein double"), "ks", "wasserstein")


@query("Q9", """WITH k AS (SELECT CASE WHEN event_id % 2 = 1 AND event_id % 3 = 0 THEN 'other' ELSE event_type END AS k, event_id % 2 = 0 AS ref FROM events), n AS (SELECT sum(ref::INT)::DOUBLE AS r, sum((NOT ref)::INT)::DOUBLE AS c FROM k),
  g AS (SELECT k, sum(ref::INT) AS r, sum((NOT ref)::INT) AS c FROM k GROUP BY k), s AS (SELECT CASE WHEN g.r = 0 THEN 0.5 / n.r ELSE g.r / n.r END AS r, CASE WHEN g.c = 0 THEN 0.5 / n.c ELSE g.c / n.c END AS c FROM g, n)
  SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM s""")
def drift_categorical(spark, sf):
    e = table(spark, sf, "events")
    odd = F.col("event_id") % 2 == 1
    cur = e.where(odd).withColumn("event_type", F.when(F.col("event_id") % 3 == 0, "other").otherwise(F.col("event_type")))
    v = DR.categorical_psi(e.where(~odd), cur, "event_type")
    return rounded(spark.createDataFrame([(v,)], "psi double"), "psi")


@query("Q9", """WITH k AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id % 2 = 0 AS ref FROM events), n AS (SELECT sum(ref::INT)::DOUBLE AS r, sum((NOT ref)::INT)::DOUBLE AS c FROM k),
  g AS (SELECT k, sum(ref::INT) AS r, sum((NOT ref)::INT) AS c FROM k GROUP BY k), s AS (SELECT CASE WHEN g.r = 0 THEN 0.5 / n.r ELSE g.r / n.r END AS r, CASE WHEN g.c = 0 THEN 0.5 / n.c ELSE g.c / n.c END AS c FROM g, n)
  SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM s""")
def drift_many_categories(spark, sf):
    e, odd = table(spark, sf, "events"), F.col("event_id") % 2 == 1
    v = DR.categorical_psi(e.where(~odd), e.where(odd), "user_id")
    return rounded(spark.createDataFrame([(v,)], "psi double"), "psi")


@query("Q10", f"""WITH m AS (SELECT min(v) AS lo, max(v) AS hi FROM {BOTH}), e AS (SELECT list_transform(range(20), lambda i: lo + i * ((hi - lo) / 20)) || [hi] AS e FROM m),
  b AS (SELECT ref, least(len(list_filter(e, lambda x: x <= v)) - 1, 19) AS bin FROM {BOTH}, e)
  SELECT i::INTEGER AS bin, round(e[i + 1], 6) AS start, round(e[i + 2], 6) AS "end", (SELECT count(*) FROM b WHERE bin = i AND ref)::BIGINT AS reference_count, (SELECT count(*) FROM b WHERE bin = i AND NOT ref)::BIGINT AS current_count FROM e, range(20) t(i)""")
def drift_histogram(spark, sf):
    return rounded(DR.paired_histogram(*_halves(spark, sf), "value"), "start", "end")


@query("Q11", f"""WITH {BINS}, c AS (SELECT v, sum(sum(ref::INT)) OVER (ORDER BY v) / (SELECT count(*) FROM {BOTH} WHERE ref)::DOUBLE AS f, sum(sum((NOT ref)::INT)) OVER (ORDER BY v) / (SELECT count(*) FROM {BOTH} WHERE NOT ref)::DOUBLE AS g,
  lead(v) OVER (ORDER BY v) AS nx FROM {BOTH} GROUP BY v), w AS (SELECT sum(abs(f - g) * (nx - v)) AS w FROM c),
  k AS (SELECT event_type, sum(ref::INT) / (SELECT count(*) FROM {BOTH} WHERE ref)::DOUBLE AS r, sum((NOT ref)::INT) / (SELECT count(*) FROM {BOTH} WHERE NOT ref)::DOUBLE AS c FROM {BOTH} GROUP BY 1)
  SELECT 'value' AS "column", 'psi' AS metric, round(sum((c - r) * ln(c / r)), 6) AS value, sum((c - r) * ln(c / r)) > 0.2 AS has_drift, 0.2::DOUBLE AS threshold FROM s
  UNION ALL SELECT 'value', 'kl_divergence', round(sum(c / (SELECT sum(c) FROM s) * ln((c / (SELECT sum(c) FROM s)) / (r / (SELECT sum(r) FROM s)))), 6), sum(c * ln(c / r)) > 0.1, 0.1 FROM s
  UNION ALL SELECT 'value', 'wasserstein_distance', round(w, 6), w / (SELECT stddev_pop(v) FROM {BOTH} WHERE ref) > 0.1, 0.1 FROM w
  UNION ALL SELECT 'event_type', 'psi_categorical', round(sum((c - r) * ln(c / r)), 6), sum((c - r) * ln(c / r)) > 0.2, 0.2 FROM k""")
def drift_report_rows(spark, sf):
    a, b = _halves(spark, sf)
    r = DR.drift_report(a, b, columns=["value", "event_type"])
    return rounded(r.metrics.where("metric <> 'ks_test_p_value'"), "value")


@query("Q12", f"""SELECT 'critical' AS severity, 1::BIGINT AS drifted, 2::BIGINT AS columns FROM events LIMIT 1""")
def drift_severity(spark, sf):
    a, b = _halves(spark, sf)
    return MON.drift_severity(DR.drift_report(a, b, columns=["value", "event_type"]).metrics, [], [])


@query("Q13", f"""WITH {BINS}, k AS (SELECT event_type, sum(ref::INT) / (SELECT count(*) FROM {BOTH} WHERE ref)::DOUBLE AS r, sum((NOT ref)::INT) / (SELECT count(*) FROM {BOTH} WHERE NOT ref)::DOUBLE AS c FROM {BOTH} GROUP BY 1)
  SELECT 'value' AS "column", TRUE AS drifted, round(sum((c - r) * ln(c / r)), 6) AS psi, 0.7::DOUBLE AS importance FROM s UNION ALL SELECT 'event_type', FALSE, round(sum((c - r) * ln(c / r)), 6), 0.0 FROM k""")
def drift_by_importance(spark, sf):
    a, b = _halves(spark, sf)
    m = DR.drift_report(a, b, columns=["value", "event_type"]).metrics
    return rounded(MON.drift_importance(m, spark.createDataFrame([("value", 0.7), ("other", 0.3)], "column string, importance double")), "psi")


# --- types, alerts, advice -------------------------------------------------------------------

TYPES = {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "float"}


def _type_sql(c, k):
    if k == "float":
        return f"SELECT '{c}' AS \"column\", 'Numeric' AS kind FROM part LIMIT 1"
    few = "count(DISTINCT {c}) / count(*) < 0.05" + (" AND count(DISTINCT {c}) < 20" if k == "int" else "")
    return f"SELECT '{c}' AS \"column\", CASE WHEN {few.format(c=c)} THEN 'Categorical' ELSE '{'Numeric' if k == 'int' else 'Text'}' END AS kind FROM part"


@query("Q15", " UNION ALL ".join(f"({_type_sql(c, k)})" for c, k in TYPES.items()))
def semantic_types(spark, sf):
    return spark.createDataFrame(list(AD.semantic_types(table(spark, sf, "part")).items()), "column string, kind string")


@query("Q16", """SELECT 'ship_date' AS "column", 'MM/dd/yyyy' AS format, count(DISTINCT strftime(o_orderdate, '%Y-%m-%d'))::BIGINT AS days FROM orders UNION ALL SELECT 'created', 'generic', count(DISTINCT strftime(o_orderdate, '%Y-%m-%d'))::BIGINT FROM orders""")
def date_strings(spark, sf):
    d = table(spark, sf, "orders").select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("ship_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"),
                                          q("o_orderpriority").alias("date_note"))
    found = AD.detect_date_strings(d, sample=None)
    days = AD.cast_date_strings(d, found).agg(*[F.count_distinct(q(c)).alias(c) for c in found]).first()
    return spark.createDataFrame([(c, f, days[c]) for c, f in sorted(found.items())], "column string, format string, days long")


@query("Q17", """SELECT "column", type, severity FROM (SELECT 'c_custkey' AS "column", 'Possible ID' AS type, 'info' AS severity, count(DISTINCT c_custkey) = count(*) AND count(*) > 50 AS hit FROM customer
  UNION ALL SELECT 'c_name', 'Possible ID', 'info', count(DISTINCT c_name) = count(*) AND count(*) > 50 FROM customer
  UNION ALL SELECT 'gap', 'High Null', 'warning', 100.0 * sum((c_custkey % 5 = 0)::INT) / count(*) > 5 FROM customer
  UNION ALL SELECT 'one', 'Constant', 'warning', TRUE UNION ALL SELECT 'mail', 'PII', 'error', TRUE
  UNION ALL SELECT 'mail', 'Possible ID', 'info', count(*) > 50 FROM customer
  UNION ALL SELECT 'twice', 'Leakage', 'warning', corr(c_acctbal, c_acctbal * 2 + 1) > 0.95 FROM customer) WHERE hit""")
def profile_alerts(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") % 97).alias("gap"), F.lit(1.0).alias("one"),
                                            F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.org")).alias("mail"), (F.col("c_acctbal") * 2 + 1).alias("twice"))
    r = {x["column"]: x["r"] for x in C.target_correlations(c, "c_acctbal", ["gap", "twice"]).collect()}
    return AD.alerts(c, "c_acctbal", target_r=r).select("column", "type", "severity").where("type <> 'Outlier'")


@query("Q18", """SELECT 'c_custkey' AS "column", 'Drop' AS action, 'identifier' AS reason FROM (SELECT count(*) AS n FROM customer) WHERE n > 50 UNION ALL SELECT 'gap', 'Drop', 'missing' UNION ALL SELECT 'some', 'Impute', 'median'
  UNION ALL SELECT 'one', 'Drop', 'constant' UNION ALL SELECT * FROM (SELECT 'c_mktsegment', CASE WHEN min(n) / max(n) > 0.8 THEN 'Info' ELSE 'Resample' END, CASE WHEN min(n) / max(n) > 0.8 THEN 'balanced' ELSE 'imbalanced' END
   FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment) HAVING min(n) / max(n) > 0.8 OR min(n) / max(n) < 0.2)""")
def profile_recommendations(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(k % 5 == 0, F.col("c_acctbal")).alias("gap"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("some"), F.lit(1.0).alias("one"))
    return AD.recommendations(c, "c_mktsegment")


@query("Q19", """SELECT 'imputation' AS type, 'imputation_mean' AS rule_id, 'gap,some' AS columns UNION ALL SELECT 'cleaning', 'high_missing_drop', 'gap' UNION ALL SELECT 'encoding', 'one_hot_encoding', 'c_mktsegment'
  UNION ALL SELECT 'outlier', 'outlier_removal_iqr', 'peak' FROM (SELECT exp(c_acctbal / 1000) AS p FROM customer) HAVING max(p) > avg(p) + 3 * stddev_samp(p)
  UNION ALL SELECT 'transformation', 'power_transform_box_cox', 'peak' FROM (SELECT exp(c_acctbal / 1000) AS p FROM customer) HAVING skewness(p) > 1""")
def advisor_rules(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.when(k % 5 == 0, F.col("c_acctbal")).alias("gap"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("some"), F.exp(F.col("c_acctbal") / 1000).alias("peak"))
    return AD.advisor(c).select("type", "rule_id", "columns")


NUMBERS = ("o_custkey", "o_totalprice")


def _profile_sql():
    """(section, column, item, value, note) of the orders table, section by section."""
    row = lambda section, column, item, value, note="NULL::VARCHAR", source="orders": (
        f"""SELECT '{section}' AS section, {column} AS "column", {item} AS item, round(({value})::DOUBLE, 3) AS value, {note} AS note FROM {source}""")
    out = [row("row_count", "NULL::VARCHAR", "'row_count'", "count(*)"), row("column_count", "NULL::VARCHAR", "'column_count'", "CASE WHEN count(*) > 0 THEN 5 END"),
           row("missing", "NULL::VARCHAR", "'missing_cells'", " + ".join(f"sum(({c} IS NULL)::INT)" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))),
           row("duplicates", "NULL::VARCHAR", "'duplicates'", "coalesce(sum(n), 0)", source="(SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority HAVING count(*) > 1)")]
    for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"):
        out += [row("basic", f"'{c}'", "'null_count'", f"count(*) - count({c})"), row("basic", f"'{c}'", "'distinct_count'", f"count(DISTINCT {c})")]
    for c in NUMBERS:
        ranked = f"(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM orders)"
        out += [row("numeric", f"'{c}'", f"'{k}'", e) for k, e in (("mean", f"avg({c})"), ("median", f"quantile_cont({c}::DOUBLE, 0.5)"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})"),
                                                                 ("zeros", f"sum(({c} = 0)::INT)"), ("negatives", f"sum(({c} < 0)::INT)"))]
        out += [row("numeric", f"'{c}'", f"'{k}'", f"max(CASE WHEN r = floor({p} * (n - 1) + 0.5) THEN v END)", source=ranked) for k, p in (("q25", 0.25), ("q75", 0.75))]
        edged = f"(SELECT v, list_filter(range(1, 20), lambda k: lo + k * ((hi - lo) / 20) < v) AS below FROM (SELECT {c}::DOUBLE AS v FROM orders), (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM orders))"
        out.append(row("histogram", f"'{c}'", "'bin_' || b", "count(below)", source=f"range(20) t(b) LEFT JOIN {edged} ON len(below) = b GROUP BY b"))
    for c in ("o_orderstatus", "o_orderpriority"):
        counts = f"(SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1)"
        out.append(row("category", f"'{c}'", "'distinct'", "count(*)", "string_agg(v || ':' || n, ',' ORDER BY n DESC, v)", counts))
        out.append(row("category", f"'{c}'", "'rare_labels'", "coalesce(sum((n < 5)::INT), 0)", source=counts))
    out.append(row("date", "'o_orderdate'", "'duration_days'", "date_diff('day', min(o_orderdate), max(o_orderdate))", "strftime(min(o_orderdate), '%Y-%m-%d') || ' ' || strftime(max(o_orderdate), '%Y-%m-%d')"))
    out.append(row("correlation", "'o_custkey'", "'o_totalprice'", "corr(o_custkey, o_totalprice)"))
    out.append(row("target_correlation", "'o_custkey'", "'o_totalprice'", "corr(o_custkey, o_totalprice)"))
    weekly = "(SELECT date_trunc('week', o_orderdate) AS w, avg(o_custkey) AS a, avg(o_totalprice) AS b FROM orders GROUP BY 1)"
    out += [row("trend", f"'{c}'", "strftime(w, '%Y-%m-%d')", x, source=weekly) for c, x in zip(NUMBERS, "ab")]
    return " UNION ALL ".join(out)


@query("Q20", _profile_sql())
def full_profile(spark, sf):
    """The profile's sections with their values; tests (normality) and advice have queries of their own."""
    r = P.analyze(table(spark, sf, "orders"), target="o_totalprice", exclude=["o_orderkey"], multivariate=False)
    rows = [(k, None, k, r[k], None) for k in ("row_count", "column_count", "duplicates")] + [("missing", None, "missing_cells", r["missing"]["missing_cells"], None)]
    rows += [("basic", b["column"], k, b[k], None) for b in r["basic"] for k in ("null_count", "distinct_count")]
    rows += [("numeric", b["column"], k, b[k], None) for b in r["numeric"] for k in ("mean", "median", "std", "min", "max", "zeros", "negatives", "q25", "q75")]
    rows += [("histogram", c, f"bin_{b['bin']}", b["count"], None) for c, h in r["histograms"].items() for b in h]
    for c, x in r["categories"].items():
        rows += [("category", c, "distinct", x["distinct"], x["top"]), ("category", c, "rare_labels", x["rare_labels"], None)]
    rows += [("date", c, "duration_days", x["duration_days"], f"{x['min_date']:%Y-%m-%d} {x['max_date']:%Y-%m-%d}") for c, x in r["dates"].items()]
    rows += [("correlation", x["column_a"], x["column_b"], x["r"], None) for x in r["correlations"] if x["column_a"] < x["column_b"]]
    rows += [("target_correlation", c, "o_totalprice", x, None) for c, x in r["target_correlations"].items()]
    rows += [("trend", c, f"{x['date']:%Y-%m-%d}", x[c], None) for x in r["timeseries"]["trend"] for c in NUMBERS]
    return rounded(spark.createDataFrame([(*a, None if v is None else float(v), n) for *a, v, n in rows], "section string, column string, item string, value double, note string"), "value", digits=3)


@query("Q21")
def normality_test(spark, sf):
    t = P.normality(table(spark, sf, "orders"), "o_totalprice")
    return rounded(spark.createDataFrame([(t["statistic"], t["is_normal"])], "statistic double, is_normal boolean"), "statistic")


@query("Q22", """WITH r AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n FROM (SELECT l_quantity AS x, l_extendedprice AS y, l_quantity * 2 + l_tax * 100 AS z FROM lineitem)),
  p AS (SELECT 'x' AS source, 'y' AS target, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS p, n FROM r UNION ALL SELECT 'x', 'z', (xz - xy * yz) / sqrt((1 - xy * xy) * (1 - yz * yz)), n FROM r
  UNION ALL SELECT 'y', 'z', (yz - xy * xz) / sqrt((1 - xy * xy) * (1 - xz * xz)), n FROM r)
  SELECT source, target, round(p, 6) AS partial_r FROM p WHERE abs(atanh(p)) * sqrt(n - 4) > 1.959963984540054""")
def partial_correlations(spark, sf):
    li = table(spark, sf, "lineitem").select(q("l_quantity").alias("x"), q("l_extendedprice").alias("y"), (F.col("l_quantity") * 2 + F.col("l_tax") * 100).alias("z"))
    return rounded(C.partial_correlation_edges(li), "partial_r").select("source", "target", "partial_r")


@query("M20", """SELECT min(c - 5) AS min_lat, max(c - 5) AS max_lat, round(min(d), 6) AS min_lon, round(max(d), 6) AS max_lon, round(avg(c - 5), 6) AS centroid_lat, round(avg(d), 6) AS centroid_lon, count(*)::BIGINT AS points
  FROM (SELECT (o_custkey % 80)::DOUBLE AS c, (o_orderkey % 170) / 2.0::DOUBLE AS d FROM orders)""")
def geo_bounds(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 80 - 5).cast("double").alias("Lat"), ((F.col("o_orderkey") % 170) / 2.0).alias("lng"))
    return rounded(P.geo_bounds(o), "min_lon", "max_lon", "centroid_lat", "centroid_lon")


@query("L7", """SELECT 'o_totalprice' AS "column", min(o_totalprice) < q1 - 1.5 * (q3 - q1) OR max(o_totalprice) > q3 + 1.5 * (q3 - q1) AS outlier FROM orders,
  (SELECT max(CASE WHEN r = floor(0.25 * (n - 1) + 0.5) THEN v END) AS q1, max(CASE WHEN r = floor(0.75 * (n - 1) + 0.5) THEN v END) AS q3 FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n FROM orders)) GROUP BY q1, q3""")
def outlier_hint(spark, sf):
    p = A.numeric_profile(table(spark, sf, "orders"), ["o_totalprice"])
    iqr = F.col("q75") - F.col("q25")
    return p.select("column", ((F.col("min") < F.col("q25") - 1.5 * iqr) | (F.col("max") > F.col("q75") + 1.5 * iqr)).alias("outlier"))
