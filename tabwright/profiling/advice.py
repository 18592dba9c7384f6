"""Semantic types, alerts and recommendations: rules over small profile tables."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..core import DATE_TYPES, FLOAT_TYPES, INT_TYPES, agg_row, dtype_of, nn, num, numeric_candidates, q
from ..operators.text import pii_condition
from .aggregates import basic_profile, duplicate_rows, numeric_profile

ALERTS_SCHEMA = "column string, type string, severity string, message string"
DATE_NAME_HINTS = ["date", "time", "year", "month", "day", "ts", "created", "updated", "at"]
# Formats tried after the generic parse.
DATE_FORMATS = ["MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "yyyy-MM-dd"]


def semantic_type(t: T.DataType, distinct: int, rows: int) -> str:
    share = distinct / rows if rows else 0.0
    if isinstance(t, FLOAT_TYPES + (T.DecimalType,)):
        return "Numeric"
    if isinstance(t, INT_TYPES):
        return "Categorical" if share < 0.05 and distinct < 20 else "Numeric"
    if isinstance(t, T.BooleanType):
        return "Boolean"
    if isinstance(t, DATE_TYPES + (T.DayTimeIntervalType,)):
        return "DateTime"
    if isinstance(t, T.StringType):
        return "Categorical" if share < 0.05 else "Text"
    return "Text"


def semantic_types(df: DataFrame, basic: list | None = None, rows: int | None = None) -> dict[str, str]:
    basic = basic_profile(df).collect() if basic is None else basic
    rows = df.count() if rows is None else rows
    return {r["column"]: semantic_type(dtype_of(df, r["column"]), r["distinct_count"], rows) for r in basic}


def detect_date_strings(df: DataFrame, sample: int | None = None) -> dict[str, str]:
    """Text columns with date-like names whose values all parse -> winning format.

    One aggregate tries every format on every candidate: all values must parse, and the format
    with the most distinct months wins. All rows are looked at, or only ``sample`` (any of them) if a caller asks so.
    """
    cand = [c for c, t in df.dtypes if t == "string" and any(k in c.lower() for k in DATE_NAME_HINTS)]
    if not cand:
        return {}
    d = df.select(*[q(c) for c in cand])
    d = d if sample is None else d.limit(sample)
    exprs = []
    for c in cand:
        x = q(c)
        exprs.append(F.count(x))
        for f in [None] + DATE_FORMATS:
            p = F.try_to_timestamp(x) if f is None else F.try_to_timestamp(x, F.lit(f))
            exprs += [F.count(p), F.bit_count(F.bit_or(F.pow(F.lit(2), F.month(p)).cast("int")))]
    row = agg_row(d, exprs)
    k, out = 1 + 2 * (1 + len(DATE_FORMATS)), {}
    for i, c in enumerate(cand):
        vals = row[k * i:k * i + k]
        best = None
        for j, f in enumerate(["generic"] + DATE_FORMATS):
            parsed, months = vals[1 + 2 * j], vals[2 + 2 * j]
            if vals[0] and parsed == vals[0] and (best is None or months > best[0]):
                best = (months, f)
        if best:
            out[c] = best[1]
    return out


def cast_date_strings(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    from ..core import with_columns
    return with_columns(df, {c: (F.try_to_timestamp(q(c)) if f == "generic" else F.try_to_timestamp(q(c), F.lit(f)))
                             .cast("timestamp_ntz") for c, f in formats.items()})


def alerts(df: DataFrame, target: str | None = None, basic: list | None = None, numeric: list | None = None,
           vifs: dict | None = None, target_r: dict | None = None) -> DataFrame:
    """(column, type, severity, message)."""
    basic = basic_profile(df).collect() if basic is None else basic
    numeric = numeric_profile(df).collect() if numeric is None else numeric
    texts = [c for c, t in df.dtypes if t == "string"]
    row = agg_row(df, [F.count("*")] + [F.coalesce(F.bool_or(pii_condition(q(c))), F.lit(False)) for c in texts])
    n, pii = row[0], dict(zip(texts, row[1:]))
    types = semantic_types(df, basic, n)
    uniq = {r["column"]: r["distinct_count"] for r in basic}
    nums = {r["column"]: r for r in numeric}
    rows = []
    cells = sum(r["null_count"] for r in basic)
    if n and basic and 100.0 * cells / (n * len(basic)) > 50:
        rows.append((None, "High Null", "warning", f"{100.0 * cells / (n * len(basic)):.1f}% of all cells are missing."))
    for r in basic:
        c, kind = r["column"], types[r["column"]]
        share = 100.0 * r["null_count"] / n if n else 0.0
        if share > 5:
            rows.append((c, "High Null", "warning", f"{share:.1f}% of values are missing."))
        s = nums.get(c)
        if kind == "Numeric" and s is not None:
            iqr = (s["q75"] or 0) - (s["q25"] or 0)
            if iqr > 0 and (s["min"] < s["q25"] - 1.5 * iqr or s["max"] > s["q75"] + 1.5 * iqr):
                rows.append((c, "Outlier", "info", "Values lie outside the quartile whiskers."))
            if s["std"] == 0:
                rows.append((c, "Constant", "warning", "The column has one value."))
        if kind in ("Categorical", "Text", "Numeric") and uniq[c] == n and uniq[c] > 50:
            rows.append((c, "Possible ID", "info", "Every value is different."))
        elif kind == "Categorical" and uniq[c] > 1000:
            rows.append((c, "High Cardinality", "warning", f"{uniq[c]} different values."))
        if kind in ("Categorical", "Text") and pii.get(c):
            rows.append((c, "PII", "error", "Values look like e-mail addresses or phone numbers."))
    for c, v in (vifs or {}).items():
        if v > 5:
            rows.append((c, "Multicollinearity", "warning" if v > 10 else "info", f"Variance inflation {v:.1f}."))
    for c, r in (target_r or {}).items():
        if abs(r) > 0.95 and c != target:
            rows.append((c, "Leakage", "warning", f"Correlation {r:.2f} with the target."))
    return df.sparkSession.createDataFrame(rows, ALERTS_SCHEMA)


def recommendations(df: DataFrame, target: str | None = None, basic: list | None = None, numeric: list | None = None
                    ) -> DataFrame:
    """(column, action, reason): what to do before modelling."""
    from .aggregates import class_balance
    basic = basic_profile(df).collect() if basic is None else basic
    numeric = numeric_profile(df).collect() if numeric is None else numeric
    n = df.count()
    types = semantic_types(df, basic, n)
    nums = {r["column"]: r for r in numeric}
    rows = []
    for r in basic:
        share = 100.0 * r["null_count"] / n if n else 0.0
        if share > 50:
            rows.append((r["column"], "Drop", "missing"))
        elif share > 0:
            rows.append((r["column"], "Impute", "median" if types[r["column"]] == "Numeric" else "mode"))
    for c, s in nums.items():
        if types[c] == "Numeric" and s["skewness"] is not None and abs(s["skewness"]) > 1.5:
            rows.append((c, "Transform", "skewness"))
    for r in basic:
        if types[r["column"]] == "Categorical" and r["distinct_count"] > 50:
            rows.append((r["column"], "Encode", "cardinality"))
    for c, s in nums.items():
        if types[c] == "Numeric" and s["std"] == 0:
            rows.append((c, "Drop", "constant"))
    for r in basic:
        if types[r["column"]] in ("Categorical", "Text", "Numeric") and r["distinct_count"] == n and n > 50:
            rows.append((r["column"], "Drop", "identifier"))
    if not any(a in ("Drop", "Impute") for _, a, _ in rows):
        rows.append((None, "Keep", "clean"))
    if target and types.get(target) == "Categorical":
        b = class_balance(df, target).first()
        if b and b["advice"] == "balanced":
            rows.append((target, "Info", "balanced"))
        elif b and b["advice"] == "resample":
            rows.append((target, "Resample", "imbalanced"))
    return df.sparkSession.createDataFrame(rows, "column string, action string, reason string")


def sample_skew(s: float | None, n: int) -> float | None:
    """Sample-adjusted skewness from the population value."""
    return None if s is None or n < 3 else s * (n * (n - 1)) ** 0.5 / (n - 2)


def advisor(df: DataFrame, count_duplicates: bool = True) -> DataFrame:
    """(type, rule_id, columns, message): which operators to add."""
    basic = basic_profile(df).collect()
    n = df.count()
    nums = {}
    cols = numeric_candidates(df)
    row = agg_row(df, [f(num(df, c)) for c in cols for f in (F.avg, F.stddev_samp, F.min, F.max, F.skewness, F.count)])
    for i, c in enumerate(cols):
        nums[c] = row[6 * i:6 * i + 6]
    rows = []

    def add(kind, rule, names, text):
        if names is None or names:
            rows.append((kind, rule, ",".join(names or []), text))
    add("imputation", "imputation_mean", [r["column"] for r in basic if r["null_count"] > 0], "columns with missing values")
    dup = duplicate_rows(df).first()[0] if count_duplicates else 0
    if dup:
        add("cleaning", "duplicate_rows_drop", None, "duplicate rows")
    add("cleaning", "high_missing_drop", [r["column"] for r in basic if n and r["null_count"] / n > 0.5], "columns mostly missing")
    add("encoding", "one_hot_encoding", [r["column"] for r in basic if r["column"] not in nums
        and r["distinct_count"] - (1 if r["null_count"] else 0) < 20], "columns with few categories")
    add("outlier", "outlier_removal_iqr", [c for c, (m, s, lo, hi, _, _) in nums.items()
        if s and s > 0 and (hi > m + 3 * s or lo < m - 3 * s)], "columns with values beyond three deviations")
    skewed = {c: v for c, v in nums.items() if abs(sample_skew(v[4], v[5]) or 0.0) > 1.0}
    add("transformation", "power_transform_box_cox", [c for c, v in skewed.items() if v[2] > 0], "skewed positive columns")
    add("transformation", "power_transform_yeo_johnson", [c for c, v in skewed.items() if not v[2] > 0], "skewed columns")
    return df.sparkSession.createDataFrame(rows, "type string, rule_id string, columns string, message string")
