"""CSV, Parquet, JSON and object-store tables."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

EXPORT_ONE_FILE = 50_000


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(int(limit))


def read_csv(spark: SparkSession, path: str, limit: int | None = None, schema: T.StructType | str | None = None,
             **options) -> DataFrame:
    """CSV with a header; lines that do not fit become nulls instead of stopping the read.

    Give a schema for large inputs: without one Spark reads the data once more to infer types.
    """
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").options(**options)
    return _limited(r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path), limit)


def read_parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return _limited(spark.read.parquet(path), limit)


def read_json(spark: SparkSession, path: str, limit: int | None = None, schema: T.StructType | str | None = None,
              lines: bool = True) -> DataFrame:
    """JSON records, one per line; ``lines=False`` for a document over many lines, which is one task a file."""
    r = spark.read.option("multiLine", not lines)
    return _limited((r.schema(schema) if schema else r).json(path), limit)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, path: str) -> str:
    """A name without suffix is tried as it is, then as .parquet, then as .csv."""
    if os.path.splitext(path)[1] or _exists(spark, path):
        return path
    for suffix in (".parquet", ".csv"):
        if _exists(spark, path + suffix):
            return path + suffix
    return path


def read_table(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """By suffix; Parquet when unknown."""
    path = resolve(spark, path)
    suffix = os.path.splitext(path)[1].lower()
    reader = {".csv": read_csv, ".json": read_json}.get(suffix, read_parquet)
    return reader(spark, path, limit)


def read_object_store(spark: SparkSession, uri: str, limit: int | None = None, endpoint: str | None = None,
                      key: str | None = None, secret: str | None = None) -> DataFrame:
    """Same formats from s3:// addresses through the s3a file system."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in (("fs.s3a.endpoint", endpoint), ("fs.s3a.access.key", key), ("fs.s3a.secret.key", secret)):
        if value:
            conf.set(name, value)
    if endpoint:
        conf.set("fs.s3a.path.style.access", "true")
    return read_table(spark, "s3a://" + uri[5:] if uri.startswith("s3://") else uri, limit)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """CSV or Parquet by suffix, Parquet by default."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path.lower().endswith(".csv"):
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def export(df: DataFrame, path: str, fmt: str = "csv", limit: int = 10_000) -> str:
    """The first ``limit`` rows as CSV or Parquet; one file up to 50,000 rows."""
    if fmt not in ("csv", "parquet"):
        raise ValueError("format is csv or parquet")
    n = max(1, int(limit))
    rows = df.limit(n)
    w = (rows.coalesce(1) if n <= EXPORT_ONE_FILE else rows).write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)
    return path


def read_schema(spark: SparkSession, path: str, sample: float | None = None) -> dict[str, str]:
    """Column -> type. Parquet has them in its footers; CSV and JSON types are inferred from all rows, or from a
    share ``sample`` of them. ``sample=0`` reads a CSV's header only and calls every type a string."""
    path = resolve(spark, path)
    if sample is not None and not 0 <= sample <= 1:
        raise ValueError("sample is a share between 0 and 1")
    low = path.lower()
    if low.endswith(".csv") and sample == 0:
        return dict(spark.read.option("header", True).csv(path).dtypes)
    if low.endswith(".json") and sample == 0:
        raise ValueError("JSON rows have no header: give a share above 0")
    if low.endswith((".csv", ".json")) and sample is not None:
        r = spark.read.option("samplingRatio", sample)
        return dict((r.option("header", True).option("inferSchema", True).csv(path) if low.endswith(".csv") else r.json(path)).dtypes)
    if low.endswith((".csv", ".json")):
        return dict(read_table(spark, path, None).dtypes)
    return dict(spark.read.parquet(path).dtypes)


def sample_head(spark: SparkSession, path: str, limit: int = 5) -> list[dict]:
    return [r.asDict() for r in read_table(spark, path).limit(int(limit)).collect()]


@dataclass
class Catalog:
    """Tables by id under one or more roots (local folders or object-store prefixes)."""

    spark: SparkSession
    roots: list[str]

    def _path(self, table_id: str) -> str:
        if "://" in table_id or os.path.isabs(table_id):
            return table_id
        for root in self.roots:
            p = resolve(self.spark, root.rstrip("/") + "/" + table_id)
            if _exists(self.spark, p):
                return p
        return self.roots[0].rstrip("/") + "/" + table_id

    def load(self, table_id: str, limit: int | None = None) -> DataFrame:
        return read_table(self.spark, self._path(table_id), limit)

    def save(self, table_id: str, df: DataFrame) -> str:
        return write_table(df, self._path(table_id))

    def exists(self, table_id: str) -> bool:
        return _exists(self.spark, self._path(table_id))
