"""Text and value cleaning, all as column expressions."""

from __future__ import annotations

import re
import string
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..core import FLOAT_TYPES, Operator, choose_columns, dtype_of, is_numeric, nn, num, operator, q, with_columns
from ..plans.lookup import INLINE_KEYS, map_column


def trim(c: Column, mode: str = "both") -> Column:
    if mode in ("leading", "both"):
        c = F.regexp_replace(c, r"^\s+", "")
    if mode in ("trailing", "both"):
        c = F.regexp_replace(c, r"\s+$", "")
    return c


def change_case(c: Column, mode: str = "lower") -> Column:
    if mode == "upper":
        return F.upper(c)
    if mode == "title":
        return F.initcap(F.lower(c))
    if mode == "sentence":
        return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    return F.lower(c)


def remove_special(c: Column, mode: str = "keep_alphanumeric", replacement: str = "") -> Column:
    pattern = V.REMOVE_SPECIAL.get(mode)
    return F.regexp_replace(c, pattern, _literal(replacement)) if pattern else c


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def normalize_slash_dates(c: Column) -> Column:
    """Every m/d/yyyy inside a text, not part of a longer digit run, as yyyy-mm-dd."""
    edge, tail = r"(?<![0-9])", r"(?![0-9])"
    for m, mm in ((r"([0-9]{2})", "$1"), (r"([0-9])", "0$1")):
        for d, dd in ((r"([0-9]{2})", "$2"), (r"([0-9])", "0$2")):
            c = F.regexp_replace(c, f"{edge}{m}/{d}/([0-9]{{4}}){tail}", f"$3-{mm}-{dd}")
    return c


def regex_clean(c: Column, mode: str, pattern: str | None = None, repl: str = "") -> Column:
    if mode == "collapse_whitespace":
        return trim(F.regexp_replace(c, r"\s+", " "))
    if mode == "extract_digits":
        found = F.regexp_extract(c, r"(\d+)", 1)
        return F.when(found != "", found)
    if mode == "normalize_slash_dates":
        return normalize_slash_dates(c)
    if mode == "custom" and pattern:
        # back-references are written \1 in configs and $1 in Spark
        return F.regexp_replace(c, pattern, re.sub(r"\\(\d)", r"$\1", repl))
    return c


@operator("TextCleaning")
class TextCleaning(Operator):
    description = "Trim, case, character and pattern rules applied in order"

    def fit(self, df, cfg):
        cols = choose_columns(df, cfg, lambda d, ex: [c for c, t in d.dtypes if t == "string" and c not in ex])
        return {"columns": cols, "operations": list(cfg.get("operations") or [])}

    def apply(self, df, art):
        new = {}
        for name in art["columns"]:
            if name not in df.columns or not isinstance(dtype_of(df, name), T.StringType):
                continue
            c = q(name)
            for op in art["operations"]:
                kind = op.get("op") or op.get("type") or op.get("operation")
                if kind == "trim":
                    c = trim(c, op.get("mode", "both"))
                elif kind == "case":
                    c = change_case(c, op.get("mode", "lower"))
                elif kind == "remove_special":
                    c = remove_special(c, op.get("mode", "keep_alphanumeric"), op.get("replacement", ""))
                elif kind == "regex":
                    c = regex_clean(c, op.get("mode", "custom"), op.get("pattern"), op.get("repl", ""))
            new[name] = c
        return with_columns(df, new)


@operator("ValueReplacement")
class ValueReplacement(Operator):
    description = "Replace listed values"

    def fit(self, df, cfg):
        cols = choose_columns(df, cfg, lambda d, ex: [c for c in d.columns if c not in ex])
        mapping = cfg.get("mapping") or cfg.get("replacements")
        if isinstance(mapping, list):
            mapping = {r.get("old", r.get("from")): r.get("new", r.get("to")) for r in mapping}
        if not mapping and cfg.get("to_replace") is not None:
            old = cfg["to_replace"]
            mapping = old if isinstance(old, dict) else {old: cfg.get("value")}
        mapping = mapping or {}
        nested = any(isinstance(v, dict) for v in mapping.values())
        return {"maps": {c: [[k, v] for k, v in (mapping.get(c, {}) if nested else mapping).items()]
                         for c in cols}}

    def apply(self, df, art):
        new = {}
        for c, pairs in art["maps"].items():
            if c in df.columns and pairs:
                t = dtype_of(df, c)
                e = q(c)
                if not isinstance(t, T.StringType) and any(isinstance(v, str) for _, v in pairs):
                    e = e.cast("string")
                out = e
                for old, val in reversed(pairs):
                    hit = nn(df, c).isNull() if old is None else q(c) == F.lit(old)
                    if isinstance(old, str) and not isinstance(t, T.StringType):
                        hit = q(c).cast("string") == F.lit(old)
                    out = F.when(hit, F.lit(val)).otherwise(out)
                new[c] = out
        return with_columns(df, new)


def alias_pairs(kind: str, custom: dict | None = None) -> dict[str, str]:
    if kind == "boolean":
        return {**{w: "Yes" for w in V.YES_WORDS}, **{w: "No" for w in V.NO_WORDS}}
    if kind == "country":
        return {w: name for name, words in V.COUNTRY_WORDS.items() for w in words}
    return dict(custom or {})


@operator("AliasReplacement")
class AliasReplacement(Operator):
    description = "Spelling variants to one canonical value"
    defaults = {"custom_map": None}

    def fit(self, df, cfg):
        cols = choose_columns(df, cfg, lambda d, ex: [c for c, t in d.dtypes if t == "string" and c not in ex])
        kind = cfg.get("alias_type") or cfg.get("mode") or cfg.get("domain") or "boolean"
        kind = {"normalize_boolean": "boolean", "canonicalize_country_codes": "country"}.get(kind, kind)
        return {"columns": cols, "pairs": [[k, v] for k, v in alias_pairs(kind, cfg["custom_map"]).items()]}

    def apply(self, df, art):
        punct = "[" + re.escape(string.punctuation + " ") + "]"
        if len(art["pairs"]) <= INLINE_KEYS:
            if not art["pairs"]:
                return df
            table = F.create_map(*[F.lit(x) for kv in art["pairs"] for x in kv])
            new = {}
            for c in art["columns"]:
                if c in df.columns:
                    k = F.regexp_replace(F.lower(q(c).cast("string")), punct, "")
                    new[c] = F.coalesce(F.try_element_at(table, k), q(c).cast("string"))
            return with_columns(df, new)
        for c in art["columns"]:
            if c in df.columns:
                k = F.regexp_replace(F.lower(q(c).cast("string")), punct, "")
                j = map_column(df, c, {"pairs": art["pairs"]}, "__a", k, None, "string")
                df = j.select(*[F.coalesce(q("__a"), q(c)).alias(c) if x == c else q(x) for x in df.columns])
        return df


@operator("InvalidValueReplacement")
class InvalidValueReplacement(Operator):
    description = "Replace values that break a rule"
    defaults = {"replace_inf": False, "replace_neg_inf": False}

    def fit(self, df, cfg):
        cols = [c for c in choose_columns(df, cfg, None) if is_numeric(df, c)]
        rule = cfg.get("rule") or cfg.get("mode")
        lo, hi = cfg.get("min_value"), cfg.get("max_value")
        if rule in V.RULE_BOUNDS:
            a, b = V.RULE_BOUNDS[rule]
            rule, lo, hi = "custom_range", a if lo is None else lo, b if hi is None else hi
        value = cfg.get("value") if cfg.get("value") is not None else cfg.get("replacement")
        if isinstance(value, float) and value != value:
            value = None
        return {"columns": cols, "rule": {"zero_to_nan": "zero", "negative_to_nan": "negative"}.get(rule, rule),
                "min_value": lo, "max_value": hi, "value": value,
                "replace_inf": bool(cfg["replace_inf"]), "replace_neg_inf": bool(cfg["replace_neg_inf"])}

    def apply(self, df, art):
        new = {}
        for c in art["columns"]:
            if c not in df.columns:
                continue
            x, bad = nn(df, c), F.lit(False)
            if art["replace_inf"]:
                bad = bad | (num(df, c) == float("inf"))
            if art["replace_neg_inf"]:
                bad = bad | (num(df, c) == float("-inf"))
            if art["rule"] == "negative":
                bad = bad | (x < 0)
            elif art["rule"] == "zero":
                bad = bad | (x == 0)
            elif art["rule"] == "custom_range":
                if art["min_value"] is not None:
                    bad = bad | (x < F.lit(art["min_value"]))
                if art["max_value"] is not None:
                    bad = bad | (x > F.lit(art["max_value"]))
            v = F.lit(art["value"])
            new[c] = F.when(bad, v if isinstance(art["value"], float) else v.cast(dtype_of(df, c))).otherwise(x)
        return with_columns(df, new)
