"""Row and column selection."""

from __future__ import annotations

from typing import Any, Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..core import NUMERIC_TYPES, Operator, agg_row, choose_columns, dtype_of, nn, operator, q, with_columns
from ..functions.expressions import hash_rank


def feature_target_split(df: DataFrame, target_column: str) -> tuple[DataFrame, DataFrame]:
    if target_column not in df.columns:
        raise ValueError(f"target column {target_column!r} is not in the table")
    return df.select(*[q(c) for c in df.columns if c != target_column]), df.select(q(target_column))


@operator("feature_target_split")
class FeatureTargetSplit(Operator):
    description = "Features of a table: everything but the target"

    def fit(self, df, cfg):
        feature_target_split(df, cfg["target_column"])
        return {"target_column": cfg["target_column"]}

    def apply(self, df, art):
        return df.drop(art["target_column"])


@operator("DropMissingColumns")
class DropMissingColumns(Operator):
    description = "Drop named columns and columns with too many missing values"

    def fit(self, df, cfg):
        asked = [c for c in dict.fromkeys(cfg.get("columns") or []) if c in df.columns]
        limit = cfg.get("missing_threshold", cfg.get("threshold"))
        try:
            limit = float(limit) if limit is not None else 0.0
        except (TypeError, ValueError):
            limit = 0.0
        drop = list(asked)
        if limit > 0:
            row = agg_row(df, [F.count("*")] + [F.count(nn(df, c)) for c in df.columns])
            n = row[0]
            for c, have in zip(df.columns, row[1:]):
                if n and 100.0 * (n - have) / n >= limit and c not in drop:
                    drop.append(c)
        return {"columns_to_drop": drop}

    def apply(self, df, art):
        return df.drop(*art["columns_to_drop"])


@operator("DropMissingRows")
class DropMissingRows(Operator):
    description = "Drop rows by the number of missing values"
    defaults = {"subset": None, "how": "any", "threshold": None}

    def fit(self, df, cfg):
        return {k: cfg.get(k) for k in ("subset", "how", "threshold")}

    def apply(self, df, art):
        cols = [c for c in (art.get("subset") or df.columns) if c in df.columns]
        if not cols:
            return df
        if art.get("threshold") is not None:
            return df.na.drop(thresh=int(art["threshold"]), subset=cols)
        return df.na.drop(how=art.get("how") or "any", subset=cols)


@operator("Deduplicate")
class Deduplicate(Operator):
    """First or last row of every duplicate group, or only rows without a twin.

    Works as a grouped minimum, so copies are reduced before the shuffle: a row repeated over a
    third of the table reaches the reducer as one row per input partition.
    """

    description = "Remove duplicate rows"
    defaults = {"subset": None, "keep": "first"}
    stateless = False

    def fit(self, df, cfg):
        keep = cfg.get("keep", "first")
        keep = "none" if keep in (False, None, "none", "False") else keep
        if keep in ("first", "last") and not cfg.get("order_by"):
            raise ValueError("Deduplicate keep='first'/'last' needs order_by: Spark rows have no order")
        return {"subset": cfg.get("subset"), "keep": keep, "order_by": list(cfg.get("order_by") or [])}

    def apply(self, df, art):
        subset = [c for c in (art.get("subset") or df.columns) if c in df.columns]
        if not subset:
            return df
        row = F.struct(*[q(c) for c in df.columns])
        groups = df.groupBy(*[q(c).alias(f"__g{i}") for i, c in enumerate(subset)])
        if art["keep"] == "none":
            kept = groups.agg(F.count("*").alias("__n"), F.first(row).alias("__r")).where("__n = 1")
        else:
            pick = F.min_by if art["keep"] == "first" else F.max_by
            # rows equal in order_by are told apart by their other columns that have an order
            rest = [c for c in df.columns if c not in art["order_by"] and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
            kept = groups.agg(pick(row, F.struct(*[q(c) for c in [*art["order_by"], *rest]])).alias("__r"))
        return kept.select("__r.*")


@operator("MissingIndicator")
class MissingIndicator(Operator):
    description = "0/1 column per input telling where values are missing"
    defaults = {"flag_suffix": "_missing"}

    def fit(self, df, cfg):
        cols = choose_columns(df, cfg, None)
        if cfg.get("columns") is None:
            row = agg_row(df, [F.count("*")] + [F.count(nn(df, c)) for c in df.columns])
            cols = [c for c, have in zip(df.columns, row[1:]) if have < row[0]]
        return {"columns": cols, "flag_suffix": cfg["flag_suffix"]}

    def apply(self, df, art):
        return with_columns(df, {f"{c}{art['flag_suffix']}": nn(df, c).isNull().cast("int")
                                 for c in art["columns"] if c in df.columns})


# --- filters ---------------------------------------------------------------------------------

def _compare(c: Column, op: str, value: Any) -> Column | None:
    if op == "in":
        vals = list(value) if isinstance(value, (list, tuple, set)) else [value]
        return c.isin(vals)
    table = {"==": lambda: c == F.lit(value), "!=": lambda: c != F.lit(value),
             ">": lambda: c > F.lit(value), "<": lambda: c < F.lit(value),
             ">=": lambda: c >= F.lit(value), "<=": lambda: c <= F.lit(value)}
    return table[op]() if op in table else None


def filter_rows(df: DataFrame, filters: Iterable[dict]) -> tuple[DataFrame, list[dict]]:
    """AND of simple predicates; unknown columns or operators are skipped and handed back."""
    skipped = []
    for f in filters:
        if f.get("column") not in df.columns:
            skipped.append(f)
            continue
        cond = _compare(q(f["column"]), f.get("operator"), f.get("value"))
        if cond is None:
            skipped.append(f)
        else:
            df = df.where(cond)
    return df, skipped


def _coerce(value: Any, t: T.DataType) -> Any:
    if isinstance(value, (list, tuple)):
        return [_coerce(v, t) for v in value]
    if isinstance(value, str) and isinstance(t, NUMERIC_TYPES):
        try:
            v = float(value)
            return int(v) if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and v == int(v) else v
        except ValueError:
            return value
    if isinstance(t, T.StringType) and not isinstance(value, str) and value is not None:
        return str(value)
    return value


def filter_rows_coerced(df: DataFrame, filters: Iterable[dict]) -> DataFrame:
    """As filter_rows, with text values read in the column's type and "Unknown" meaning null."""
    for f in filters:
        name, op, value = f.get("column"), f.get("operator", "=="), f.get("value")
        if name not in df.columns:
            continue
        if value == "Unknown" and op in ("==", "!="):
            df = df.where(nn(df, name).isNull() if op == "==" else nn(df, name).isNotNull())
            continue
        cond = _compare(nn(df, name), op, _coerce(value, dtype_of(df, name)))
        if cond is not None:
            df = df.where(cond)
    return df


def exclude_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def strip_upstream_dropped_columns(merged: DataFrame, baseline: Iterable[str],
                                   branches: Iterable[Iterable[str]]) -> DataFrame:
    """A baseline column that any branch dropped does not come back through another branch."""
    gone = set()
    for cols in branches:
        gone |= set(baseline) - set(cols)
    return merged.drop(*[c for c in merged.columns if c in gone])


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Repeatable uniform sample without replacement: the n smallest key hashes."""
    from .splitting import hash_order, smallest
    return df.where(smallest(df, hash_order(key, seed), n))


# --- casting ---------------------------------------------------------------------------------

def spark_type(name: str) -> str:
    for t, names in V.CAST_TYPE_NAMES.items():
        if name.lower() in names:
            return t
    return name


@operator("Casting")
class Casting(Operator):
    description = "Change column types"
    defaults = {"coerce_on_error": True}

    def fit(self, df, cfg):
        types = dict(cfg.get("column_types") or cfg.get("type_map") or {})
        if not types and cfg.get("columns") and cfg.get("target_type"):
            types = {c: cfg["target_type"] for c in cfg["columns"]}
        types = {c: spark_type(t) for c, t in types.items() if c in df.columns}
        art = {"type_map": types, "coerce_on_error": bool(cfg["coerce_on_error"])}
        if not art["coerce_on_error"] and types:
            row = agg_row(df, [F.count_if(nn(df, c).isNotNull() & self._cast(df, c, t, True).isNull())
                               for c, t in types.items()])
            bad = {c: n for c, n in zip(types, row) if n}
            if bad:
                raise ValueError(f"values cannot be cast: {bad}")
        return art

    def _cast(self, df, c, t, coerce) -> Column:
        x = nn(df, c)
        if t == "boolean" and isinstance(dtype_of(df, c), T.StringType):
            w = F.lower(F.trim(x))
            return F.when(w.isin(V.BOOL_TRUE_WORDS), F.lit(True)).when(w.isin(V.BOOL_FALSE_WORDS), F.lit(False))
        if t == "timestamp_ntz" and isinstance(dtype_of(df, c), T.StringType):
            return F.try_to_timestamp(x).cast("timestamp_ntz")
        if t in ("bigint", "int") and isinstance(dtype_of(df, c), T.StringType):
            return x.try_cast("double").try_cast(t)
        return x.try_cast(t) if coerce else x.cast(t)

    def apply(self, df, art):
        return with_columns(df, {c: self._cast(df, c, t, art["coerce_on_error"])
                                 for c, t in art["type_map"].items() if c in df.columns})
