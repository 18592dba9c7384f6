"""Scalers: one aggregation to fit, one projection to apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import Operator, agg_row, choose_columns, detect_numeric, is_numeric, num, operator, with_columns
from ..plans.quantiles import column_quantiles


def _numeric(df, cfg):
    return [c for c in choose_columns(df, cfg, detect_numeric) if is_numeric(df, c)]


class _Affine(Operator):
    """x -> (x - center) / scale * gain + shift with numbers kept in the artifact."""

    def apply(self, df, art):
        new = {}
        for c, s in art["params"].items():
            if c not in df.columns:
                continue
            x = num(df, c)
            if s.get("center"):
                x = x - F.lit(s["center"])
            if s.get("scale", 1.0) != 1.0:
                x = x / F.lit(s["scale"])
            if s.get("gain", 1.0) != 1.0:
                x = x * F.lit(s["gain"])
            if s.get("shift"):
                x = x + F.lit(s["shift"])
            new[c] = x
        return with_columns(df, new)


@operator("StandardScaler")
class StandardScaler(_Affine):
    description = "Zero mean, unit (population) standard deviation"
    defaults = {"with_mean": True, "with_std": True}

    def fit(self, df, cfg):
        cols = _numeric(df, cfg)
        row = agg_row(df, [e for c in cols for e in (F.avg(num(df, c)), F.stddev_pop(num(df, c)))])
        return {"params": {c: {"center": (row[2 * i] or 0.0) if cfg["with_mean"] else 0.0,
                               "scale": (row[2 * i + 1] or 1.0) if cfg["with_std"] else 1.0}
                           for i, c in enumerate(cols)}}


@operator("MinMaxScaler")
class MinMaxScaler(_Affine):
    description = "Map the observed range onto feature_range"
    defaults = {"feature_range": [0, 1]}

    def fit(self, df, cfg):
        cols = _numeric(df, cfg)
        lo, hi = map(float, cfg["feature_range"])
        row = agg_row(df, [e for c in cols for e in (F.min(num(df, c)), F.max(num(df, c)))])
        params = {}
        for i, c in enumerate(cols):
            a, b = row[2 * i], row[2 * i + 1]
            if a is not None:
                params[c] = {"center": a, "scale": (b - a) or 1.0, "gain": hi - lo, "shift": lo}
        return {"params": params, "feature_range": [lo, hi]}


@operator("RobustScaler")
class RobustScaler(_Affine):
    description = "Median and quantile range"
    defaults = {"quantile_range": [25.0, 75.0], "with_centering": True, "with_scaling": True}

    def fit(self, df, cfg):
        cols = _numeric(df, cfg)
        a, b = [float(v) / 100.0 for v in cfg["quantile_range"]]
        qs = column_quantiles(df, cols, [a, 0.5, b])
        return {"params": {c: {"center": v[1] if cfg["with_centering"] else 0.0,
                               "scale": ((v[2] - v[0]) or 1.0) if cfg["with_scaling"] else 1.0}
                           for c, v in qs.items() if v[1] is not None}}


@operator("MaxAbsScaler")
class MaxAbsScaler(_Affine):
    description = "Divide by the largest absolute value"

    def fit(self, df, cfg):
        cols = _numeric(df, cfg)
        row = agg_row(df, [F.max(F.abs(num(df, c))) for c in cols])
        return {"params": {c: {"scale": v or 1.0} for c, v in zip(cols, row)}}
