"""Value-to-value maps: inline when small, broadcast when checked, joined when large."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..core import q
from ..session import cut_lineage, shared_table_path

INLINE_KEYS = 1_000
BROADCAST_KEYS = 200_000


def key_text(c: Column) -> Column:
    return c.cast("string")


def build_map(pairs: DataFrame, name: str = "map", limit: int = BROADCAST_KEYS) -> dict:
    """Artifact of a (key, value) table: a plain dict up to ``limit`` keys, else a shared table."""
    rows = pairs.select("key", "value").limit(limit + 1).collect()
    if len(rows) <= limit:
        return {"pairs": [[r["key"], r["value"]] for r in rows]}
    path = shared_table_path(pairs.sparkSession, name)
    pairs.select("key", "value").write.parquet(path)
    return {"table": path}


def map_column(df: DataFrame, column: str, art: dict, out: str, key: Column | None = None,
               default: Any = None, value_type: str = "double") -> DataFrame:
    """Replace values by their mapped value, ``default`` where there is none (rows kept as is)."""
    key = key_text(q(column)) if key is None else key
    default_col = F.lit(default).cast(value_type)
    pairs = art.get("pairs")
    if pairs is not None and len(pairs) <= INLINE_KEYS:
        if not pairs:
            return df.withColumn(out, default_col)
        flat = [F.lit(v) for kv in pairs for v in kv]
        hit = F.try_element_at(F.create_map(*flat), key).cast(value_type)
        return df.withColumn(out, F.coalesce(hit, default_col))
    spark = df.sparkSession
    if pairs is not None:
        right = F.broadcast(spark.createDataFrame([(k, v) for k, v in pairs],
                                                  f"__k string, __v {value_type}"))
    else:
        # a shared table: unique keys, so only the left side can be skewed and AQE splits it
        right = spark.read.parquet(art["table"]).select(
            F.col("key").alias("__k"), F.col("value").cast(value_type).alias("__v"))
    cols = [c for c in df.columns if c != out]
    joined = df.withColumn("__key", key).join(right, F.col("__key") == F.col("__k"), "left")
    return joined.select(*[q(c) for c in cols], F.coalesce("__v", default_col).alias(out))


def map_join(df: DataFrame, column: str, mapping: dict, default: Any = None, out: str | None = None,
             value_type: str = "double") -> DataFrame:
    """Public form: map a column through a Python dict."""
    art = {"pairs": [[str(k), v] for k, v in mapping.items()]}
    return map_column(df, column, art, out or column, default=default, value_type=value_type)


def size_checked_join(df: DataFrame, small: DataFrame, on, how: str = "left",
                      limit: int = BROADCAST_KEYS) -> DataFrame:
    """Join a side that is unique on its key: broadcast below the checked size, shuffle above.

    The side is computed once, into the shared folder, and counted there; a condition on its columns stays valid.
    """
    rows = cut_lineage(small)
    n = rows.limit(limit + 1).count()
    return df.join(F.broadcast(rows) if n <= limit else rows, on, how)
