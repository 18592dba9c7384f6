"""Sources, row and column selection, merges, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as S
from ..core import apply, fit, fit_apply, q
from ..operators import rows as R
from ..operators.timeseries import sort_by_time
from ..plans import merging as M
from ..plans.lookup import map_join
from ..profiling import aggregates as A
from ..session import shared_table_path
from ..core import Splits
from .base import HOLES, holes, query, r6, table

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("A1 A6", CUSTOMER)
def read_csv_customer(spark, sf):
    c = table(spark, sf, "customer")
    path = S.write_table(c, shared_table_path(spark, "customer") + ".csv")
    return S.read_csv(spark, path, schema=c.schema)


@query("A2 A6", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def read_parquet_orders(spark, sf):
    path = S.write_table(table(spark, sf, "orders"), shared_table_path(spark, "orders"), partition_by=["o_orderstatus"])
    return S.read_table(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("A3", CUSTOMER)
def read_json_customer(spark, sf):
    c = table(spark, sf, "customer")
    path = shared_table_path(spark, "customer") + ".json"
    c.write.json(path)
    return S.read_json(spark, path, schema=c.schema, lines=True).select(*c.columns)


@query("A4", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def read_object_store_supplier(spark, sf):
    path = sf if "://" in sf else "file:" + sf
    return S.read_object_store(spark, f"{path.rstrip('/')}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")


@query("A7", "SELECT least(count(*), 1000)::BIGINT AS rows FROM orders")
def export_orders(spark, sf):
    path = S.export(table(spark, sf, "orders"), shared_table_path(spark, "export"), "parquet", 1000)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"))


@query("A8", """SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type
  FROM (DESCRIBE orders)""")
def read_schema_orders(spark, sf):
    return spark.createDataFrame(list(S.read_schema(spark, f"{sf}/orders.parquet").items()), "column string, type string")


@query("A9", "SELECT least(count(*), 5)::BIGINT AS rows, least(count(*), 5)::BIGINT AS found FROM orders")
def sample_head_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    head = spark.createDataFrame([(r["o_orderkey"], r["o_custkey"], r["o_totalprice"]) for r in S.sample_head(spark, f"{sf}/orders.parquet")], o.schema)
    return head.join(o.withColumn("there", F.lit(1)), o.columns, "left").agg(F.count("*").alias("rows"), F.count("there").alias("found"))


# --- rows and columns ------------------------------------------------------------------------

@query("B1", "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus AS target FROM orders")
def split_features_target(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    R.feature_target_split(o, "o_orderstatus")
    x = fit_apply("feature_target_split", o, target_column="o_orderstatus")
    return M.merge_columns([x, o.select("o_orderkey", q("o_orderstatus").alias("target"))], ["o_orderkey"])


@query("B2", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {HOLES}")
def drop_missing_columns(spark, sf):
    return fit_apply("DropMissingColumns", holes(spark, sf), missing_threshold=12)


@query("B3", f"SELECT * FROM {HOLES} WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
def drop_missing_rows_any(spark, sf):
    return fit_apply("DropMissingRows", holes(spark, sf))


@query("B3", f"""SELECT * FROM {HOLES} WHERE (CASE WHEN o_totalprice IS NULL THEN 0 ELSE 1 END)
  + (CASE WHEN o_orderpriority IS NULL THEN 0 ELSE 1 END) >= 1""")
def drop_missing_rows_threshold(spark, sf):
    return fit_apply("DropMissingRows", holes(spark, sf), subset=["o_totalprice", "o_orderpriority"], threshold=1)


DEDUP = """SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type ORDER BY event_id {0}) AS rn FROM events) WHERE rn = 1"""


def _dedup(spark, sf, keep):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return fit_apply("Deduplicate", e, subset=["user_id", "event_type"], keep=keep, order_by=["event_id"])


@query("B4", DEDUP.format("ASC"))
def deduplicate_first(spark, sf):
    return _dedup(spark, sf, "first")


@query("B4", DEDUP.format("DESC"))
def deduplicate_last(spark, sf):
    return _dedup(spark, sf, "last")


@query("B4", """SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1""")
def deduplicate_none(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return fit_apply("Deduplicate", li, keep="none")


@query("B5", f"""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END AS o_totalprice_missing,
  CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END AS o_orderpriority_missing FROM {HOLES}""")
def missing_indicator(spark, sf):
    return fit_apply("MissingIndicator", holes(spark, sf)).select(
        "o_orderkey", "o_totalprice_missing", "o_orderpriority_missing")


@query("B6", """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag IN ('A','R')
  AND l_discount <> 0.05""")
def filter_line_rows(spark, sf):
    d, _ = R.filter_rows(table(spark, sf, "lineitem"), [
        {"column": "l_quantity", "operator": ">=", "value": 30},
        {"column": "l_returnflag", "operator": "in", "value": ["A", "R"]},
        {"column": "l_discount", "operator": "!=", "value": 0.05},
        {"column": "nowhere", "operator": "==", "value": 1}])
    return d.select("l_orderkey", "l_partkey", "l_quantity")


@query("B7", f"SELECT o_orderkey, o_custkey FROM {HOLES} WHERE o_custkey >= 100 AND o_orderpriority IS NULL")
def filter_rows_text_values(spark, sf):
    return R.filter_rows_coerced(holes(spark, sf), [
        {"column": "o_custkey", "operator": ">=", "value": "100.0"},
        {"column": "o_orderpriority", "operator": "==", "value": "Unknown"}]).select("o_orderkey", "o_custkey")


@query("B8", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def exclude_part_columns(spark, sf):
    return R.exclude_columns(table(spark, sf, "part"), ["p_type", "p_retailprice"])


@query("B10", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS flag,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS cust, CAST(trunc(o_totalprice) AS BIGINT) AS price,
  CAST(o_custkey AS VARCHAR) AS custtext FROM orders""")
def cast_columns(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, " Yes ").when(F.col("o_orderkey") % 4 == 1, "off")
        .when(F.col("o_orderkey") % 4 == 2, "T").otherwise("maybe").alias("flag"),
        F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("cust"),
        F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("custtext"))
    return fit_apply("Casting", o, column_types={"flag": "boolean", "cust": "int", "price": "int64", "custtext": "text"})


@query("B11", "SELECT o_orderkey, o_orderstatus, o_totalprice * 2 AS doubled FROM orders")
def strip_dropped_columns(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    a = base.drop("o_totalprice")
    b = base.withColumn("doubled", F.col("o_totalprice") * 2)
    return R.strip_upstream_dropped_columns(M.merge_columns([a, b], ["o_orderkey"]), base.columns, [a.columns, b.columns])


@query("B12 T7", """SELECT o_orderkey, o_totalprice FROM orders
  ORDER BY substr(md5(concat(o_orderkey::VARCHAR, ':42')), 1, 13), o_orderkey LIMIT 500""")
def sample_orders(spark, sf):
    return R.sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 500, ["o_orderkey"])


@query("B9 D6", "SELECT 5::BIGINT AS rows, count(*)::BIGINT AS passed FROM orders")
def snapshot_orders(spark, sf):
    o = table(spark, sf, "orders")
    art = fit("DataSnapshot", o, n_rows=5)
    return apply(o, art).agg(F.lit(len(art["rows"])).cast("bigint").alias("rows"), F.count("*").alias("passed"))


# --- merges ----------------------------------------------------------------------------------

def _branches(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    a = base.withColumn("o_totalprice", F.col("o_totalprice") / 2).withColumn("extra", F.col("o_orderkey") % 5)
    b = base.withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1))
    return base, a, b


@query("C1", """SELECT o_orderkey, o_totalprice, substr(o_orderpriority, 1, 1) AS o_orderpriority, o_orderkey % 5 AS extra FROM orders""")
def merge_columns_last(spark, sf):
    _, a, b = _branches(spark, sf)
    return M.merge_columns([a, b], ["o_orderkey"], "last_wins")


@query("C1", """SELECT o_orderkey, o_totalprice / 2 AS o_totalprice, o_orderpriority, o_orderkey % 5 AS extra FROM orders""")
def merge_columns_first(spark, sf):
    _, a, b = _branches(spark, sf)
    return M.merge_columns([a, b], ["o_orderkey"], "first_wins")


@query("C2", """SELECT o_orderkey, o_totalprice / 2 AS o_totalprice, substr(o_orderpriority, 1, 1) AS o_orderpriority,
  o_orderkey % 5 AS extra FROM orders""")
def merge_columns_by_owner(spark, sf):
    base, a, b = _branches(spark, sf)
    return M.merge_columns_owned([a, b], base, ["o_orderkey"])


@query("C3 D1", """SELECT nationkey, acctbal FROM (SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
  UNION ALL SELECT s_nationkey, s_acctbal FROM supplier)""")
def merge_rows_common(spark, sf):
    c = table(spark, sf, "customer").select(q("c_nationkey").alias("nationkey"), q("c_acctbal").alias("acctbal"), "c_mktsegment")
    s = table(spark, sf, "supplier").select(q("s_acctbal").alias("acctbal"), q("s_nationkey").alias("nationkey"), "s_name")
    return M.merge_rows([c, s])[0]


@query("C4", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0")
def union_train_validation(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey") % 5
    return M.train_plus_validation(Splits(o.where(k > 1), o.where(k == 0), o.where(k == 1)))


@query("C5", """SELECT o_orderkey, o_totalprice, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM orders""")
def merge_split_parts(spark, sf):
    o = table(spark, sf, "orders")
    test = F.col("o_orderkey") % 4 == 0

    def parts(*cols):
        d = o.select("o_orderkey", *cols)
        return Splits(d.where(~test), d.where(test))
    m = M.merge_splits([parts("o_totalprice"), parts("o_custkey")], ["o_orderkey"])
    return m.train.withColumn("part", F.lit("train")).unionByName(m.test.withColumn("part", F.lit("test")))


@query("C6", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0::DOUBLE WHEN 'MACHINERY' THEN 2.0::DOUBLE
  ELSE -1.0::DOUBLE END AS code FROM customer""")
def map_values(spark, sf):
    c = table(spark, sf, "customer")
    return map_join(c, "c_mktsegment", {"BUILDING": 1.0, "MACHINERY": 2.0}, default=-1.0, out="code").select("c_custkey", "code")


# --- duplicates, order -----------------------------------------------------------------------

@query("D2 Q4", """SELECT coalesce(sum(n), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicate_line_rows(spark, sf):
    return A.duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("D4", """SELECT event_id, value FROM events ORDER BY ts""")
def events_by_time(spark, sf):
    return sort_by_time(table(spark, sf, "events")).select("event_id", "value")


@query("D5", """SELECT l_partkey::VARCHAR AS value, count(*)::BIGINT AS count FROM lineitem GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 10""")
def top_parts(spark, sf):
    return A.value_counts(table(spark, sf, "lineitem"), "l_partkey", 10)
