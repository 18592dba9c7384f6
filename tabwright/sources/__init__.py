"""Readers, writers and a dataset catalog over spark.read and df.write."""

from .tables import (Catalog, export, read_csv, read_json, read_object_store, read_parquet, read_schema, read_table,
                     sample_head, write_table)

__all__ = ["Catalog", "export", "read_csv", "read_json", "read_object_store", "read_parquet", "read_schema",
           "read_table", "sample_head", "write_table"]
