"""Imputation, scaling, cleaning, binning, outliers, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import apply, fit, fit_apply, q
from .base import HOLES, LINE_HOLES, holes, line_holes, query, r6, rounded, table

KEYS = "l_orderkey, l_partkey, l_linenumber"
LK = ["l_orderkey", "l_partkey", "l_linenumber"]


def _fill(sql_value, col="l_discount"):
    return f"SELECT {KEYS}, round(coalesce({col}, {sql_value}), 6) + 0.0::DOUBLE AS {col} FROM {LINE_HOLES}"


def _impute(spark, sf, strategy, col="l_discount", **kw):
    d = fit_apply("SimpleImputer", line_holes(spark, sf), columns=[col], strategy=strategy, **kw)
    return d.select(*LK, r6(col).alias(col))


@query("G1", _fill(f"(SELECT avg(l_discount) FROM {LINE_HOLES})"))
def impute_mean(spark, sf):
    return _impute(spark, sf, "mean")


@query("G2", _fill(f"(SELECT quantile_cont(l_quantity, 0.5) FROM {LINE_HOLES})", "l_quantity"))
def impute_median(spark, sf):
    return _impute(spark, sf, "median", "l_quantity")


@query("G3", f"""SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {HOLES} WHERE o_orderpriority IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM {HOLES}""")
def impute_most_frequent(spark, sf):
    return fit_apply("SimpleImputer", holes(spark, sf), columns=["o_orderpriority"], strategy="most_frequent").select(
        "o_orderkey", "o_orderpriority")


@query("G4", f"""SELECT o_orderkey, coalesce(o_orderpriority, 'none') AS o_orderpriority, 1.5::DOUBLE AS restored FROM {HOLES}""")
def impute_constant(spark, sf):
    d = holes(spark, sf)
    d = fit_apply("SimpleImputer", d, columns=["o_orderpriority"], strategy="constant", fill_value="none")
    art = fit("SimpleImputer", d.withColumn("restored", F.lit(None).cast("double")), columns=["restored"],
              strategy="constant", fill_value=1.5)
    return apply(d, art).select("o_orderkey", "o_orderpriority", "restored")


@query("G5", f"""SELECT * FROM (SELECT 'o_totalprice' AS "column", (count(*) - count(o_totalprice))::BIGINT AS missing FROM {HOLES}
  UNION ALL SELECT 'o_orderpriority', (count(*) - count(o_orderpriority))::BIGINT FROM {HOLES}
  UNION ALL SELECT 'total', (2 * count(*) - count(o_orderpriority) - count(o_totalprice))::BIGINT FROM {HOLES})""")
def impute_missing_counts(spark, sf):
    art = fit("SimpleImputer", holes(spark, sf), columns=["o_totalprice", "o_orderpriority"], strategy="most_frequent")
    rows = [*art["missing_counts"].items(), ("total", art["total_missing"])]
    return spark.createDataFrame([(c, int(n)) for c, n in rows], "column string, missing long")


# --- scaling ---------------------------------------------------------------------------------

SC = ["l_quantity", "l_extendedprice"]


def _scaled(spark, sf, op, **kw):
    d = fit_apply(op, line_holes(spark, sf), columns=SC, **kw)
    return d.select(*LK, *[r6(c).alias(c) for c in SC])


def _scale_sql(expr):
    cols = ", ".join(f"round({expr.format(c=c)}, 6) + 0.0::DOUBLE AS {c}" for c in SC)
    stats = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}, "
                      f"max(abs({c})) AS abs_{c}, quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS q2_{c}, "
                      f"quantile_cont({c}, 0.75) AS q3_{c}" for c in SC)
    return f"SELECT {KEYS}, {cols} FROM {LINE_HOLES} CROSS JOIN (SELECT {stats} FROM {LINE_HOLES})"


@query("H1", _scale_sql("({c} - mean_{c}) / std_{c}"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "StandardScaler")


@query("H2", _scale_sql("({c} - min_{c}) / (max_{c} - min_{c}) * 4 - 2"))
def scale_min_max(spark, sf):
    return _scaled(spark, sf, "MinMaxScaler", feature_range=[-2, 2])


@query("H3", _scale_sql("({c} - q2_{c}) / (q3_{c} - q1_{c})"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "RobustScaler")


@query("H4", _scale_sql("{c} / abs_{c}"))
def scale_max_abs(spark, sf):
    return _scaled(spark, sf, "MaxAbsScaler")


# --- cleaning --------------------------------------------------------------------------------

def _clean(spark, sf, column, name, ops):
    t = table(spark, sf, name)
    return fit_apply("TextCleaning", t, columns=[column], operations=ops)


@query("J1 J2", r"""SELECT doc_id, lower(regexp_replace(regexp_replace('  ' || text || ' ', '^\s+', ''), '\s+$', '')) AS text FROM documents""")
def clean_trim_lower(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))
    return fit_apply("TextCleaning", t, columns=["text"], operations=[{"op": "trim", "mode": "both"}, {"op": "case", "mode": "lower"}])


@query("J2", """SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS c_mktsegment FROM customer""")
def clean_sentence_case(spark, sf):
    return _clean(spark, sf, "c_mktsegment", "customer", [{"op": "case", "mode": "sentence"}]).select("c_custkey", "c_mktsegment")


@query("J2", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '1-urgent' WHEN '2-HIGH' THEN '2-high'
  WHEN '3-MEDIUM' THEN '3-medium' WHEN '4-NOT SPECIFIED' THEN '4-not Specified' ELSE '5-low' END AS o_orderpriority FROM orders""")
def clean_title_case(spark, sf):
    return _clean(spark, sf, "o_orderpriority", "orders", [{"op": "case", "mode": "title"}]).select("o_orderkey", "o_orderpriority")


@query("J3", r"""SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9\s]', '_', 'g') AS url FROM pages""")
def clean_remove_special(spark, sf):
    return _clean(spark, sf, "url", "pages", [{"op": "remove_special", "mode": "keep_alphanumeric_space", "replacement": "_"}]
                  ).select("page_id", "url")


@query("J4", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '') AS text FROM documents""")
def clean_collapse_whitespace(spark, sf):
    return _clean(spark, sf, "text", "documents", [{"op": "regex", "mode": "collapse_whitespace"}]).select("doc_id", "text")


@query("J4", r"""SELECT event_id, nullif(regexp_extract(props, '(\d+)', 1), '') AS props FROM events""")
def clean_extract_digits(spark, sf):
    return _clean(spark, sf, "props", "events", [{"op": "regex", "mode": "extract_digits"}]).select("event_id", "props")


@query("J4", r"""SELECT page_id, regexp_replace(url, '^https?://([^/]+)/', '\1|', 'g') AS url FROM pages""")
def clean_custom_pattern(spark, sf):
    return _clean(spark, sf, "url", "pages", [{"op": "regex", "mode": "custom", "pattern": "^https?://([^/]+)/", "repl": r"\1|"}]
                  ).select("page_id", "url")


@query("J5", """SELECT o_orderkey, 'due ' || strftime(o_orderdate, '%Y-%m-%d') || ' ref 123/01/20245' AS note FROM orders""")
def clean_slash_dates(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    note = F.concat(F.lit("due "), F.month(d).cast("string"), F.lit("/"), F.dayofmonth(d).cast("string"), F.lit("/"),
                    F.year(d).cast("string"), F.lit(" ref 123/01/20245"))
    return fit_apply("TextCleaning", o.select("o_orderkey", note.alias("note")), columns=["note"],
                     operations=[{"op": "regex", "mode": "normalize_slash_dates"}])


@query("J6", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus,
  CASE o_orderpriority WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def replace_values(spark, sf):
    return fit_apply("ValueReplacement", table(spark, sf, "orders"), columns=["o_orderstatus", "o_orderpriority"],
                     mapping={"o_orderstatus": {"F": "final", "O": "open"}, "o_orderpriority": {"5-LOW": "low"}}
                     ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("J7", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Yes' ELSE 'perhaps' END AS flag,
  CASE o_orderkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'United Kingdom' ELSE 'Atlantis' END AS country FROM orders""")
def replace_aliases(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 4 == 0, " YES!").when(k % 4 == 1, "off").when(k % 4 == 2, "T.").otherwise("perhaps").alias("flag"),
        F.when(k % 3 == 0, "U.S.A.").when(k % 3 == 1, "Great Britain").otherwise("Atlantis").alias("country"))
    o = fit_apply("AliasReplacement", o, columns=["flag"], alias_type="boolean")
    return fit_apply("AliasReplacement", o, columns=["country"], alias_type="country")


@query("J8", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_nationkey > 20 OR c_nationkey < 3 THEN -1 ELSE c_nationkey END AS c_nationkey FROM customer""")
def replace_invalid(spark, sf):
    c = fit_apply("InvalidValueReplacement", table(spark, sf, "customer"), columns=["c_acctbal"], rule="negative")
    return fit_apply("InvalidValueReplacement", c, columns=["c_nationkey"], rule="custom_range", min_value=3, max_value=20,
                     replacement=-1).select("c_custkey", "c_acctbal", "c_nationkey")


@query("J8", "SELECT p_partkey, CASE WHEN p_retailprice > 100 OR p_retailprice < 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part")
def replace_percentage_bounds(spark, sf):
    return fit_apply("InvalidValueReplacement", table(spark, sf, "part"), columns=["p_retailprice"], rule="percentage_bounds"
                     ).select("p_partkey", "p_retailprice")


@query("J9", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders""")
def replace_infinite(spark, sf):
    k = F.col("o_orderkey") % 5
    o = table(spark, sf, "orders").select("o_orderkey", F.when(k == 0, float("inf")).when(k == 1, float("-inf"))
                                          .otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return fit_apply("InvalidValueReplacement", o, columns=["o_totalprice"], replace_inf=True, replace_neg_inf=True, value=0.0)


# --- bins ------------------------------------------------------------------------------------

def _bin_sql(edges, col="l_quantity"):
    """Right-closed bins over a list of edges, lowest included."""
    return f"""WITH e AS (SELECT list_sort(list_distinct({edges})) AS e FROM {LINE_HOLES})
  SELECT {KEYS}, CASE WHEN {col} IS NULL OR {col} < e[1] OR {col} > e[len(e)] THEN NULL
    ELSE CAST(greatest(len(list_filter(e, lambda x: x < {col})) - 1, 0) AS INTEGER) END AS {col}_binned FROM {LINE_HOLES}, e"""


def _binned(spark, sf, col="l_quantity", op="GeneralBinning", **kw):
    d = fit_apply(op, line_holes(spark, sf), columns=[col], **kw)
    return d.select(*LK, f"{col}_binned")


@query("K1 K7", _bin_sql("""[min(l_extendedprice) + i * ((max(l_extendedprice) - min(l_extendedprice)) / 5) for i in range(5)]
   || [max(l_extendedprice)]""", "l_extendedprice"))
def bin_equal_width(spark, sf):
    return _binned(spark, sf, "l_extendedprice", strategy="equal_width", n_bins=5)


@query("K2", _bin_sql("quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0])", "l_extendedprice"))
def bin_equal_frequency(spark, sf):
    return _binned(spark, sf, "l_extendedprice", strategy="equal_frequency", n_bins=4)


@query("K4", f"""WITH s AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS r, count(*) OVER () AS n FROM {LINE_HOLES}
  WHERE l_quantity IS NOT NULL),
 p AS (SELECT unnest([1,2,3]) AS i),
 inner_edges AS (SELECT i, avg(v) AS v FROM s, p WHERE r = CAST(ceil(n * i / 4.0) AS BIGINT)
   OR (n * i % 4 = 0 AND r = CAST(n * i / 4 AS BIGINT) + 1) GROUP BY i),
 e AS (SELECT list_sort(list_distinct(list(v))) AS e FROM (SELECT v FROM inner_edges UNION ALL SELECT min(v) FROM s UNION ALL SELECT max(v) FROM s))
 SELECT {KEYS}, CASE WHEN l_quantity IS NULL THEN NULL ELSE CAST(greatest(len(list_filter(e, lambda x: x < l_quantity)) - 1, 0) AS INTEGER) END
  AS l_quantity_binned FROM {LINE_HOLES}, e""")
def bin_averaged_quantiles(spark, sf):
    return _binned(spark, sf, op="KBinsDiscretizer", n_bins=4)


@query("K5 K8", f"""SELECT {KEYS}, CASE WHEN l_quantity IS NULL OR l_quantity > 40 THEN 'Missing' WHEN l_quantity <= 10 THEN 'small'
  WHEN l_quantity <= 25 THEN 'middle' ELSE 'large' END AS l_quantity_binned FROM {LINE_HOLES}""")
def bin_custom_labels(spark, sf):
    return _binned(spark, sf, strategy="custom", custom_bins={"l_quantity": [0, 10, 25, 40]},
                   custom_labels={"l_quantity": ["small", "middle", "large"]}, missing_strategy="label")


@query("K6 K7", f"""SELECT {KEYS}, CASE WHEN l_quantity <= 20 THEN '[0.0, 20.0]' WHEN l_quantity <= 50 THEN '[20.0, 50.0]' END AS l_quantity_binned,
  CASE WHEN l_tax <= 0.02 THEN '[0.0, 0.02]' WHEN l_tax <= 0.04 THEN '[0.02, 0.04]' WHEN l_tax <= 0.06 THEN '[0.04, 0.06]'
   ELSE '[0.06, 0.08]' END AS l_tax_binned FROM {LINE_HOLES}""")
def bin_mixed_ranges(spark, sf):
    d = fit_apply("GeneralBinning", line_holes(spark, sf), columns=["l_quantity", "l_tax"], label_format="range", strategy="custom",
                  column_strategies={"l_quantity": {"strategy": "custom", "custom_bins": [0, 20, 50]},
                                     "l_tax": {"strategy": "custom", "custom_bins": [0, 0.02, 0.04, 0.06, 0.08]}})
    return d.select(*LK, "l_quantity_binned", "l_tax_binned")


@query("K3")
def bin_kmeans(spark, sf):
    return _binned(spark, sf, "l_extendedprice", strategy="kmeans", n_bins=4).groupBy("l_extendedprice_binned").agg(F.count("*").alias("n"))


# --- outliers --------------------------------------------------------------------------------

@query("L1", f"""SELECT o_orderkey, o_totalprice FROM {HOLES}, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM {HOLES})
  WHERE o_totalprice IS NULL OR (o_totalprice >= a - 0.5 * (b - a) AND o_totalprice <= b + 0.5 * (b - a))""")
def outliers_iqr(spark, sf):
    return fit_apply("IQR", holes(spark, sf), columns=["o_totalprice"], multiplier=0.5).select("o_orderkey", "o_totalprice")


@query("L2", f"""SELECT o_orderkey, o_totalprice FROM {HOLES}, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM {HOLES})
  WHERE o_totalprice IS NULL OR abs((o_totalprice - m) / s) <= 1.5""")
def outliers_zscore(spark, sf):
    return fit_apply("ZScore", holes(spark, sf), columns=["o_totalprice"], threshold=1.5).select("o_orderkey", "o_totalprice")


@query("L3", f"""SELECT o_orderkey, round(CASE WHEN o_totalprice < a THEN a WHEN o_totalprice > b THEN b ELSE o_totalprice END, 6) AS o_totalprice
  FROM {HOLES}, (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM {HOLES})""")
def outliers_winsorize(spark, sf):
    return rounded(fit_apply("Winsorize", holes(spark, sf), columns=["o_totalprice"]).select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("L4", f"""SELECT o_orderkey, o_totalprice FROM {HOLES} WHERE (o_totalprice IS NULL OR o_totalprice BETWEEN 50000 AND 200000)
  AND o_custkey <= 1000""")
def outliers_manual(spark, sf):
    return fit_apply("ManualBounds", holes(spark, sf), bounds={"o_totalprice": {"lower": 50000, "upper": 200000},
                                                              "o_custkey": {"upper": 1000}}).select("o_orderkey", "o_totalprice")


@query("L5", """WITH x AS (SELECT c_custkey, c_acctbal AS v FROM customer),
 s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM x),
 h AS (SELECT (count(*) + 3) // 2 AS h, count(*) AS n FROM x),
 w AS (SELECT a.v AS lo, b.v AS hi, b.v - a.v AS d FROM s a, h, s b WHERE b.r = a.r + h.h AND a.r < h.n - h.h),
 c AS (SELECT avg((lo + hi) / 2) AS c FROM w WHERE d = (SELECT min(d) FROM w)),
 m AS (SELECT quantile_cont((v - c) * (v - c), 0.5) AS m FROM x, c),
 l AS (SELECT avg(v) AS l FROM x, c, m WHERE (v - c) * (v - c) < 5.023886187314888 * m / 0.45493642311957283),
 t AS (SELECT quantile_cont((v - l) * (v - l), 0.95) AS t FROM x, l)
 SELECT c_custkey, v AS c_acctbal FROM x, l, t WHERE (v - l) * (v - l) <= t""")
def outliers_elliptic(spark, sf):
    return fit_apply("EllipticEnvelope", table(spark, sf, "customer"), columns=["c_acctbal"], contamination=0.05).select("c_custkey", "c_acctbal")


@query("L6")
def isolation_scores(spark, sf):
    from ..models.summaries import isolation_forest
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    s = isolation_forest(o, ["o_totalprice", "o_custkey"], ["o_orderkey"], trees=50)
    return s.select("o_orderkey", r6("anomaly_score").alias("anomaly_score"))


# --- transforms ------------------------------------------------------------------------------

TR = "SELECT c_custkey, round({0}, 6) + 0.0::DOUBLE AS c_acctbal FROM customer"


def _transform(spark, sf, method):
    d = fit_apply("SimpleTransformation", table(spark, sf, "customer"), transformations=[{"column": "c_acctbal", "method": method}])
    return d.select("c_custkey", r6("c_acctbal").alias("c_acctbal"))


for _name, _method, _sql, _id in [
        ("transform_log", "log", "CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END", "M1"),
        ("transform_sqrt", "sqrt", "CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END", "M2"),
        ("transform_cube_root", "cube_root", "cbrt(c_acctbal)", "M3"),
        ("transform_reciprocal", "reciprocal", "CASE WHEN c_acctbal <> 0 THEN 1 / c_acctbal END", "M4"),
        ("transform_square", "square", "c_acctbal * c_acctbal", "M5")]:
    query(_id, TR.format(_sql), name=_name)(lambda spark, sf, m=_method: _transform(spark, sf, m))


@query("M6", """SELECT l_orderkey, l_partkey, l_linenumber, round(exp(least(l_tax * 10, 700)), 6) AS e FROM lineitem""")
def transform_exp(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_tax") * 10).alias("e"))
    return rounded(fit_apply("SimpleTransformation", li, transformations=[{"column": "e", "method": "exp"}]), "e")


@query("M7 M8", """WITH y AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.7) - 1) / 0.7
  ELSE -(pow(1 - c_acctbal, 1.3) - 1) / 1.3 END AS y, sqrt(c_nationkey) AS n FROM customer)
  SELECT c_custkey, round((y - (SELECT avg(y) FROM y)) / (SELECT stddev_pop(y) FROM y), 6) + 0.0::DOUBLE AS c_acctbal, round(n, 6) AS c_nationkey FROM y""")
def transform_mixed(spark, sf):
    d = fit_apply("GeneralTransformation", table(spark, sf, "customer"), transformations=[
        {"column": "c_acctbal", "method": "yeo-johnson", "params": {"lambdas": {"c_acctbal": 0.7}}},
        {"column": "c_nationkey", "method": "square_root"}])
    return d.select("c_custkey", r6("c_acctbal").alias("c_acctbal"), r6("c_nationkey").alias("c_nationkey"))


@query("M9", """WITH y AS (SELECT p_partkey, (pow(p_retailprice, 0.5) - 1) / 0.5 AS y FROM part)
  SELECT p_partkey, round((y - (SELECT avg(y) FROM y)) / (SELECT stddev_pop(y) FROM y), 6) + 0.0::DOUBLE AS p_retailprice FROM y""")
def transform_box_cox(spark, sf):
    d = fit_apply("PowerTransformer", table(spark, sf, "part"), columns=["p_retailprice"], method="box-cox", lambdas={"p_retailprice": 0.5})
    return d.select("p_partkey", r6("p_retailprice").alias("p_retailprice"))


# the SQL side finds the same zero by bisection
FITTED = """WITH RECURSIVE b AS (SELECT 0 AS k, -5.3::DOUBLE AS lo, 4.9::DOUBLE AS hi UNION ALL
  SELECT k + 1, CASE WHEN g > 0 THEN m ELSE lo END, CASE WHEN g > 0 THEN hi ELSE m END FROM (
    SELECT k, any_value(lo) AS lo, any_value(hi) AS hi, any_value(m) AS m, avg(u) - covar_pop(y, (u * e - y) / m) / var_pop(y) AS g
    FROM (SELECT *, (e - 1) / m AS y FROM (SELECT *, exp(m * u) AS e FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m, ln({x}) AS u FROM b, {t} WHERE k < 42))) GROUP BY k)),
  l AS (SELECT (lo + hi) / 2 AS m FROM b WHERE k = 42), y AS (SELECT {key}, (pow({x}, m) - 1) / m AS y FROM {t}, l)
  SELECT {key}, round((y - (SELECT avg(y) FROM y)) / (SELECT stddev_pop(y) FROM y), 4) + 0.0::DOUBLE AS {c} FROM y"""


@query("M9", FITTED.format(x="p_retailprice", t="part", key="p_partkey", c="p_retailprice"))
def transform_box_cox_fitted(spark, sf):
    d = fit_apply("PowerTransformer", table(spark, sf, "part"), columns=["p_retailprice"], method="box-cox")
    return d.select("p_partkey", r6("p_retailprice", 4).alias("p_retailprice"))


@query("M8", FITTED.format(x="o_totalprice + 1", t="orders", key="o_orderkey", c="o_totalprice"))
def transform_power_fitted(spark, sf):
    d = fit_apply("PowerTransformer", table(spark, sf, "orders"), columns=["o_totalprice"])
    return d.select("o_orderkey", r6("o_totalprice", 4).alias("o_totalprice"))


def _math(spark, sf, op):
    d = fit_apply("FeatureGeneration", line_holes(spark, sf), operations=[{**op, "output_column": "v"}])
    return d.select(*LK, r6("v").alias("v"))


MATH = f"SELECT {KEYS}, round({{0}}, 6) + 0.0::DOUBLE AS v FROM {LINE_HOLES}"


@query("M10", MATH.format("coalesce(l_quantity, 0) + coalesce(l_discount, 0) + 2.5"))
def feature_add(spark, sf):
    return _math(spark, sf, {"operation_type": "arithmetic", "method": "add", "input_columns": ["l_quantity"], "secondary_columns": ["l_discount"], "constants": [2.5]})


@query("M10", MATH.format("coalesce(l_extendedprice, 1) - coalesce(l_quantity, 1) - 3"))
def feature_subtract(spark, sf):
    return _math(spark, sf, {"operation_type": "arithmetic", "method": "subtract", "input_columns": ["l_extendedprice", "l_quantity"], "constants": [3], "fillna": 1})


@query("M10", MATH.format("l_extendedprice * coalesce(l_discount, 0)"))
def feature_multiply(spark, sf):
    return _math(spark, sf, {"operation_type": "arithmetic", "method": "multiply", "input_columns": ["l_extendedprice", "l_discount"]})


@query("M10", MATH.format("l_tax / CASE WHEN abs(coalesce(l_discount, 0)) < 1e-9 THEN 1e-9 ELSE coalesce(l_discount, 0) END"))
def feature_divide(spark, sf):
    return _math(spark, sf, {"operation_type": "arithmetic", "method": "divide", "input_columns": ["l_tax", "l_discount"]})


@query("M11 M15", f"""SELECT {KEYS}, round((coalesce(l_quantity, 0) + l_tax) / (CASE WHEN abs(coalesce(l_discount, 0) + l_tax) < 1e-9 THEN 1e-9
  ELSE coalesce(l_discount, 0) + l_tax END), 6) AS pre_ratio_0 FROM {LINE_HOLES}""")
def feature_ratio_named(spark, sf):
    d = fit_apply("FeatureGeneration", line_holes(spark, sf), operations=[
        {"operation_type": "ratio", "input_columns": ["l_quantity", "l_tax"], "secondary_columns": ["l_discount", "l_tax"], "output_prefix": "pre"}])
    return rounded(d.select(*LK, "pre_ratio_0"), "pre_ratio_0")


@query("M12", """SELECT p_partkey, round(CASE WHEN p_name = '' AND p_type = '' THEN 100 ELSE 100.0::DOUBLE * (1 - levenshtein(p_name, p_type)
  / greatest(length(p_name), length(p_type))::DOUBLE) END, 6) AS score FROM part""")
def feature_similarity_levenshtein(spark, sf):
    d = fit_apply("FeatureGeneration", table(spark, sf, "part"), operations=[{"operation_type": "similarity", "method": "levenshtein",
                  "input_columns": ["p_name"], "secondary_columns": ["p_type"], "output_column": "score"}])
    return d.select("p_partkey", r6("score").alias("score"))


@query("M12")
def feature_similarity_ratio(spark, sf):
    ops = [{"operation_type": "similarity", "method": m, "input_columns": ["p_name"], "secondary_columns": ["p_type"], "output_column": m}
           for m in ("ratio", "token_sort_ratio", "token_set_ratio")]
    d = fit_apply("FeatureGeneration", table(spark, sf, "part"), operations=ops)
    return rounded(d.select("p_partkey", *[o["method"] for o in ops]), *[o["method"] for o in ops])


@query("M13", """SELECT event_id, year(ts)::INTEGER AS ts_year, quarter(ts)::INTEGER AS ts_quarter, month(ts)::INTEGER AS ts_month, monthname(ts) AS ts_month_name, week(ts)::INTEGER AS ts_week,
  day(ts)::INTEGER AS ts_day, dayname(ts) AS ts_day_name, (isodow(ts) - 1)::INTEGER AS ts_weekday, (CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END)::INTEGER AS ts_is_weekend,
  hour(ts)::INTEGER AS ts_hour, minute(ts)::INTEGER AS ts_minute, second(ts)::INTEGER AS ts_second,
  CASE WHEN month(ts) IN (12,1,2) THEN 'Winter' WHEN month(ts) <= 5 THEN 'Spring' WHEN month(ts) <= 8 THEN 'Summer' ELSE 'Autumn' END AS ts_season,
  CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'Afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'Evening'
   ELSE 'Night' END AS ts_time_of_day FROM events""")
def feature_datetime(spark, sf):
    parts = ["year", "quarter", "month", "month_name", "week", "day", "day_name", "weekday", "is_weekend", "hour", "minute", "second", "season", "time_of_day"]
    d = fit_apply("FeatureGeneration", table(spark, sf, "events"), operations=[{"operation_type": "datetime_extract", "input_columns": ["ts"], "datetime_features": parts}])
    return d.select("event_id", *[f"ts_{p}" for p in parts])


@query("M16", f"""SELECT {KEYS}, round(l_tax * l_tax, 6) AS poly_l_tax_pow_2, round(l_tax * l_extendedprice, 6) AS poly_l_tax_l_extendedprice,
  round(l_extendedprice * l_extendedprice, 4) AS poly_l_extendedprice_pow_2 FROM lineitem""")
def feature_polynomial(spark, sf):
    d = fit_apply("PolynomialFeatures", table(spark, sf, "lineitem"), columns=["l_tax", "l_extendedprice"])
    d = rounded(d.select(*LK, "poly_l_tax_pow_2", "poly_l_tax_l_extendedprice", "poly_l_extendedprice_pow_2"), "poly_l_tax_pow_2", "poly_l_tax_l_extendedprice")
    return rounded(d, "poly_l_extendedprice_pow_2", digits=4)


@query("M17", f"""SELECT {KEYS}, round(l_discount * l_quantity * l_tax, 6) AS l_discount_x_l_quantity_x_l_tax, 1.0::DOUBLE AS interaction_bias FROM lineitem""")
def feature_interaction(spark, sf):
    d = fit_apply("FeatureInteraction", table(spark, sf, "lineitem"), columns=["l_tax", "l_quantity", "l_discount"], degree=3, include_bias=True)
    return rounded(d.select(*LK, "l_discount_x_l_quantity_x_l_tax", "interaction_bias"), "l_discount_x_l_quantity_x_l_tax")


GEO = "(SELECT o_orderkey, (o_orderkey % 180) - 89.5 AS a, (o_custkey % 360) - 179.5 AS b, (o_custkey % 170) - 84.25 AS c, (o_orderkey % 350) - 174.75 AS d FROM orders)"


def _coords(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select("o_orderkey", (k % 180 - 89.5).alias("a"), (c % 360 - 179.5).alias("b"), (c % 170 - 84.25).alias("c"), (k % 350 - 174.75).alias("d"))


@query("M18", f"""SELECT o_orderkey, round(6371.0088 * 2 * atan2(sqrt(h), sqrt(1 - h)), 4) AS km, round(6371.0088 * 0.6213711922 * sqrt(x * x + y * y), 4) AS flat FROM (
  SELECT o_orderkey, pow(sin((radians(c) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin((radians(d) - radians(b)) / 2), 2) AS h,
   (radians(d) - radians(b)) * cos((radians(a) + radians(c)) / 2) AS x, radians(c) - radians(a) AS y FROM {GEO})""")
def feature_geo_distance(spark, sf):
    cols = dict(lat1_col="a", lon1_col="b", lat2_col="c", lon2_col="d")
    d = fit_apply("GeoDistance", _coords(spark, sf), **cols, output_column="km")
    d = fit_apply("GeoDistance", d, **cols, method="euclidean", unit="mi", output_column="flat")
    return rounded(d.select("o_orderkey", "km", "flat"), "km", "flat", digits=4)


@query("M19", f"""SELECT o_orderkey, substr(al, 1 + v1, 1) || substr(al, 1 + v2, 1) || substr(al, 1 + v3, 1) || substr(al, 1 + v4, 1) AS geo_cell FROM (
  SELECT o_orderkey, '0123456789bcdefghjkmnpqrstuvwxyz' AS al,
   ((x >> 9) & 1) * 16 + ((y >> 9) & 1) * 8 + ((x >> 8) & 1) * 4 + ((y >> 8) & 1) * 2 + ((x >> 7) & 1) AS v1,
   ((y >> 7) & 1) * 16 + ((x >> 6) & 1) * 8 + ((y >> 6) & 1) * 4 + ((x >> 5) & 1) * 2 + ((y >> 5) & 1) AS v2,
   ((x >> 4) & 1) * 16 + ((y >> 4) & 1) * 8 + ((x >> 3) & 1) * 4 + ((y >> 3) & 1) * 2 + ((x >> 2) & 1) AS v3,
   ((y >> 2) & 1) * 16 + ((x >> 1) & 1) * 8 + ((y >> 1) & 1) * 4 + (x & 1) * 2 + (y & 1) AS v4
  FROM (SELECT o_orderkey, CAST(floor((b + 180) / 360 * 1024) AS BIGINT) AS x, CAST(floor((a + 90) / 180 * 1024) AS BIGINT) AS y FROM {GEO}))""")
def feature_grid_cell(spark, sf):
    return fit_apply("GridCell", _coords(spark, sf), lat_col="a", lon_col="b", resolution=4).select("o_orderkey", "geo_cell")
