"""Data expectations: each returns the frame unchanged or raises with what it found."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..core import SchemaReport, agg_row, compare_schemas, nn, q
from .aggregates import duplicate_rows


class ExpectationError(ValueError):
    """A table broke an expectation."""


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls), NaN counted as null."""
    cols = list(columns or df.columns)
    row = agg_row(df, [F.count_if(nn(df, c).isNull()) for c in cols])
    return df.sparkSession.createDataFrame([(c, int(v)) for c, v in zip(cols, row)], "column string, nulls long")


def value_range(df: DataFrame, column: str, min_value=None, max_value=None, inclusive: bool = True) -> DataFrame:
    """(min, max, violations) of one column; nulls are ignored."""
    x, bad = nn(df, column), F.lit(False)
    if min_value is not None:
        bad = bad | ((x < F.lit(min_value)) if inclusive else (x <= F.lit(min_value)))
    if max_value is not None:
        bad = bad | ((x > F.lit(max_value)) if inclusive else (x >= F.lit(max_value)))
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(bad).alias("violations"))


def expect_columns_exist(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ExpectationError(f"missing columns: {absent}")
    return df


def expect_no_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    expect_columns_exist(df, columns or [])
    bad = {r["column"]: r["nulls"] for r in null_counts(df, columns).collect() if r["nulls"]}
    if bad:
        raise ExpectationError(f"null values found: {bad}")
    return df


def expect_value_range(df: DataFrame, column: str, min_value=None, max_value=None, inclusive: bool = True) -> DataFrame:
    expect_columns_exist(df, [column])
    r = value_range(df, column, min_value, max_value, inclusive).first()
    if r["violations"]:
        raise ExpectationError(f"{column!r}: {r['violations']} values outside the range; observed {r['min']} to {r['max']}")
    return df


def expect_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    expect_columns_exist(df, columns)
    n = duplicate_rows(df.select(*[q(c) for c in columns])).first()[0]
    if n:
        raise ExpectationError(f"{n} rows share values of {list(columns)}")
    return df


def expect_schema(df: DataFrame, expected, check_order: bool = False) -> DataFrame:
    r: SchemaReport = compare_schemas(expected, df.schema, check_order)
    if not r.ok:
        raise ExpectationError(f"schema differs: missing {r.missing}, extra {r.extra}, dtype {r.dtype}, order {r.order}")
    return df


def schema_contract(df: DataFrame, expected) -> DataFrame:
    """(kind, column, expected, actual) rows of every difference."""
    r = compare_schemas(expected, df.schema, True)
    rows = ([("missing", c, None, None) for c in r.missing] + [("extra", c, None, None) for c in r.extra]
            + [("dtype", c, e, a) for c, e, a in r.dtype] + ([("order", None, None, None)] if r.order else []))
    return df.sparkSession.createDataFrame(rows, "kind string, column string, expected string, actual string")
