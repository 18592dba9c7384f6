"""Lags, rolling frames and calendar parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import Operator, nn, num, operator, q, with_columns
from ..functions.expressions import date_part, parse_timestamp
from ..plans.ordered import split_hot_groups

DATE_FEATURES = ["year", "month", "day", "dayofweek", "dayofyear", "quarter", "weekofyear", "hour",
                 "minute", "is_weekend", "is_month_start", "is_month_end"]
ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}


def _list(v):
    return [v] if isinstance(v, str) else list(v or [])


class _Ordered(Operator):
    stateless = False

    def _order(self, cfg):
        sort_by = _list(cfg.get("sort_by"))
        if not sort_by:
            raise ValueError(f"{self.name} needs sort_by: Spark rows have no order")
        return sort_by


def over_slices(df: DataFrame, art: dict, halo: int, build) -> DataFrame:
    """Window expressions with frames at most ``halo`` rows back, hot groups cut into slices.

    Without ``group_by`` the whole table is one group, so it is always cut by range once it is
    larger than ``hot_rows``.
    """
    cut, parts, order = split_hot_groups(df, art["group_by"], art["sort_by"], halo, art["hot_rows"])
    w = W.partitionBy(*[q(p) for p in parts]).orderBy(*order)
    out = cut.select("*", *[e.alias(n) for n, e in build(w).items()])
    return out.where(~F.col("__halo")).drop("__slice", "__halo", "__tie", "__all")


@operator("LagFeatures")
class LagFeatures(_Ordered):
    description = "Values of earlier rows"
    defaults = {"lags": [1], "group_by": None, "drop_na": False, "hot_rows": 5_000_000}

    def fit(self, df, cfg):
        lags = cfg["lags"] if isinstance(cfg["lags"], (list, tuple)) else [cfg["lags"]]
        return {"columns": [c for c in _list(cfg.get("columns")) if c in df.columns],
                "lags": sorted({int(v) for v in lags if int(v) > 0}),
                "group_by": _list(cfg["group_by"]), "sort_by": self._order(cfg),
                "drop_na": bool(cfg["drop_na"]), "hot_rows": int(cfg["hot_rows"])}

    def apply(self, df, art):
        if not art["lags"] or not art["columns"]:
            return df
        out = over_slices(df, art, max(art["lags"]), lambda w: {
            f"{c}_lag_{n}": F.lag(q(c), n).over(w) for c in art["columns"] for n in art["lags"]})
        return out.na.drop("any") if art["drop_na"] else out


@operator("RollingAggregate")
class RollingAggregate(_Ordered):
    description = "Mean, sum, min, max, std or median of a trailing row frame"
    defaults = {"window": 3, "aggregations": ["mean"], "min_periods": 1, "group_by": None,
                "hot_rows": 5_000_000}

    def fit(self, df, cfg):
        known = list(ROLLING) + ["median"]
        return {"columns": [c for c in _list(cfg.get("columns")) if c in df.columns],
                "window": int(cfg["window"]), "min_periods": int(cfg["min_periods"]),
                "aggregations": [a for a in _list(cfg["aggregations"]) if a in known],
                "group_by": _list(cfg["group_by"]), "sort_by": self._order(cfg),
                "hot_rows": int(cfg["hot_rows"])}

    def apply(self, df, art):
        size, need = art["window"], art["min_periods"]

        def build(w):
            frame = w.rowsBetween(-(size - 1), 0)
            out = {}
            for c in art["columns"]:
                x = num(df, c)
                enough = F.count(x).over(frame) >= need
                for a in art["aggregations"]:
                    e = F.percentile(x, 0.5) if a == "median" else ROLLING[a](x)
                    out[f"{c}_roll_{a}_{size}"] = F.when(enough, e.over(frame))
            return out
        return over_slices(df, art, size - 1, build)


@operator("DateFeatures")
class DateFeatures(Operator):
    description = "Calendar parts of date columns"
    defaults = {"features": DATE_FEATURES, "drop_original": False}

    def fit(self, df, cfg):
        return {"columns": _list(cfg.get("columns")), "drop_original": bool(cfg["drop_original"]),
                "features": [f for f in _list(cfg["features"]) if f in DATE_FEATURES]}

    def apply(self, df, art):
        cols = [c for c in art["columns"] if c in df.columns]
        new = {f"{c}_{f}": date_part(parse_timestamp(df, c), f) for c in cols for f in art["features"]}
        return with_columns(df, new, cols if art["drop_original"] else [])


def sort_by_time(df: DataFrame, column: str | None = None) -> DataFrame:
    """Sort by the named time column or by the first date or timestamp column."""
    if column is None:
        times = [c for c, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")]
        if not times:
            return df
        column = times[0]
    return df.orderBy(q(column).asc_nulls_last())
