"""Operator registry, artifacts, column choice and the missing-value rule."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any, Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = INT_TYPES + FLOAT_TYPES + (T.DecimalType,)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# One aggregation carries at most this many expressions, so generated code stays compilable.
MAX_AGG_EXPRESSIONS = 240


def q(name: str) -> Column:
    """Column by exact name (names may hold dots, blanks or brackets)."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype_of(df, name), NUMERIC_TYPES)


def nn(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    c = q(name)
    if isinstance(dtype_of(df, name), FLOAT_TYPES):
        # one reference to the column, so chained steps stay one flat expression
        return F.nanvl(c, F.lit(None).cast(dtype_of(df, name)))
    return c


def num(df: DataFrame, name: str) -> Column:
    """Numeric column as double with NaN read as missing."""
    c = nn(df, name)
    return c if isinstance(dtype_of(df, name), T.DoubleType) else c.cast("double")


def agg_row(df: DataFrame, exprs: list[Column]) -> list:
    """One row of aggregates, split into several jobs only for very wide requests."""
    out: list = []
    for i in range(0, len(exprs), MAX_AGG_EXPRESSIONS):
        part = [e.alias(f"a{j}") for j, e in enumerate(exprs[i:i + MAX_AGG_EXPRESSIONS])]
        out.extend(list(df.agg(*part).first()))
    return out


def with_columns(df: DataFrame, new: dict[str, Column], drop: Iterable[str] = ()) -> DataFrame:
    """One projection that replaces, adds and drops columns."""
    drop = set(drop)
    keep = [new[c].alias(c) if c in new else q(c) for c in df.columns if c not in drop]
    add = [e.alias(c) for c, e in new.items() if c not in df.columns or c in drop]
    return df.select(*keep, *add)


# --- column choice ---------------------------------------------------------------------------

def numeric_candidates(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def detect_numeric(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns that carry information: not all missing, not 0/1, not constant."""
    cols = numeric_candidates(df, exclude)
    if not cols:
        return []
    exprs = []
    for c in cols:
        x = num(df, c)
        exprs += [F.min(x), F.max(x), F.count(x), F.count_if(~x.isin(0.0, 1.0))]
    row = agg_row(df, exprs)
    kept = []
    for i, c in enumerate(cols):
        lo, hi, n, other = row[4 * i:4 * i + 4]
        if n and other and lo != hi:
            kept.append(c)
    return kept


def detect_categorical(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))
            and f.name not in ex]


def choose_columns(df: DataFrame, cfg: dict, auto: Callable[[DataFrame, list[str]], list[str]] | None
                   ) -> list[str]:
    """Explicit columns win (deduplicated, absent ones dropped); absent setting means detect."""
    asked = cfg.get("columns")
    if asked is not None:
        present = set(df.columns)
        return [c for c in dict.fromkeys(asked) if c in present]
    if auto is None:
        return []
    exclude = [cfg["target_column"]] if cfg.get("target_column") else []
    exclude += list(cfg.get("key_columns") or [])
    return auto(df, exclude)


# --- registry --------------------------------------------------------------------------------

class Operator:
    """A fit that aggregates and an apply that only extends the lazy plan.

    ``stateless`` operators work row by row and can run on a stream; ``train_only`` ones
    (splitters, resamplers) are skipped when a fitted sequence is replayed.
    """

    name = ""
    category = "preprocessing"
    description = ""
    defaults: dict[str, Any] = {}
    tags: tuple[str, ...] = ()
    stateless = True
    train_only = False

    def fit(self, df: DataFrame, cfg: dict) -> dict:
        return {}

    def apply(self, df: DataFrame, art: dict) -> DataFrame:
        raise NotImplementedError

    def fit_apply_train(self, df: DataFrame, cfg: dict) -> tuple[dict, DataFrame]:
        art = self.fit(df, cfg)
        return art, self.apply(df, art)


_REGISTRY: dict[str, Operator] = {}


def operator(*names: str):
    """Register an Operator class under one or more names."""
    def wrap(cls):
        inst = cls()
        inst.name = names[0]
        for n in names:
            _REGISTRY[n] = inst
        return cls
    return wrap


def get_operator(name: str) -> Operator:
    if name not in _REGISTRY:
        raise KeyError(f"unknown operator {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def operator_names() -> list[str]:
    return sorted(_REGISTRY)


def _config(op: Operator, cfg: dict) -> dict:
    return {**op.defaults, **cfg}


def fit(name: str, df: DataFrame, **cfg) -> dict:
    op = get_operator(name)
    art = op.fit(df, _config(op, cfg))
    return {"op": name, **art}


def apply(df: DataFrame, artifact: dict) -> DataFrame:
    return get_operator(artifact["op"]).apply(df, artifact)


def fit_apply(name: str, df: DataFrame, **cfg) -> DataFrame:
    return apply(df, fit(name, df, **cfg))


def fit_apply_train(name: str, df: DataFrame, **cfg) -> tuple[dict, DataFrame]:
    op = get_operator(name)
    art, out = op.fit_apply_train(df, _config(op, cfg))
    return {"op": name, **art}, out


def artifact_to_json(artifact: dict) -> str:
    return json.dumps(artifact, sort_keys=True)


def artifact_from_json(text: str) -> dict:
    return json.loads(text)


@dataclass
class Splits:
    train: DataFrame
    test: DataFrame | None = None
    validation: DataFrame | None = None

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> "Splits":
        return Splits(fn(self.train), None if self.test is None else fn(self.test),
                      None if self.validation is None else fn(self.validation))


@dataclass
class SchemaReport:
    missing: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)
    dtype: list[tuple[str, str, str]] = field(default_factory=list)
    order: bool = False

    @property
    def ok(self) -> bool:
        return not (self.missing or self.extra or self.dtype or self.order)


def compare_schemas(expected: T.StructType, actual: T.StructType, check_order: bool = False
                    ) -> SchemaReport:
    """Schema contract: what is missing, extra, of another type, or in another order."""
    e = {f.name: f.dataType.simpleString() for f in expected}
    a = {f.name: f.dataType.simpleString() for f in actual}
    common_e = [c for c in e if c in a]
    common_a = [c for c in a if c in e]
    return SchemaReport(
        missing=[c for c in e if c not in a],
        extra=[c for c in a if c not in e],
        dtype=[(c, e[c], a[c]) for c in common_e if e[c] != a[c]],
        order=check_order and common_e != common_a,
    )
