"""Registry of queries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core import q


@dataclass
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    def wrap(fn):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(key, covers, fn, sql)
        return fn
    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v.run for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.sql for k, v in REGISTRY.items() if v.sql}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = q(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[(r6(c, digits).alias(c) if c in names else q(c)) for c in df.columns])


def holes(spark: SparkSession, sf: str) -> DataFrame:
    """orders with missing prices and priorities."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus",
                    F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"),
                    F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))


HOLES = """(SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""


def line_holes(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem numbers with missing discounts and quantities."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", "l_tax",
                     F.when(F.col("l_orderkey") % 10 != 0, F.col("l_discount")).alias("l_discount"),
                     F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"))


LINE_HOLES = """(SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice, l_tax,
  CASE WHEN l_orderkey % 10 <> 0 THEN l_discount END AS l_discount,
  CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS l_quantity FROM lineitem)"""
