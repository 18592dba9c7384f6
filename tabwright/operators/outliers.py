"""Row filters and clipping by fitted bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core import Operator, agg_row, choose_columns, detect_numeric, is_numeric, num, operator, q, with_columns
from ..functions.expressions import clamp
from ..plans.quantiles import column_quantiles, quantiles_of


def _numeric(df, cfg):
    return [c for c in choose_columns(df, cfg, detect_numeric) if is_numeric(df, c)]


class _Bounds(Operator):
    """Keep rows inside [lower, upper] of every column; missing values stay."""

    def apply(self, df, art):
        cond = F.lit(True)
        for c, (lo, hi) in art["bounds"].items():
            if c not in df.columns:
                continue
            x = num(df, c)
            inside = F.lit(True)
            if lo is not None:
                inside = inside & (x >= F.lit(lo))
            if hi is not None:
                inside = inside & (x <= F.lit(hi))
            cond = cond & F.coalesce(inside, F.lit(True))
        return df.where(cond)


@operator("IQR")
class IQR(_Bounds):
    description = "Drop rows outside the quartile whiskers"
    defaults = {"multiplier": 1.5}

    def fit(self, df, cfg):
        m = float(cfg["multiplier"])
        qs = column_quantiles(df, _numeric(df, cfg), [0.25, 0.75])
        return {"bounds": {c: [a - m * (b - a), b + m * (b - a)] for c, (a, b) in qs.items() if a is not None}}


@operator("ZScore")
class ZScore(_Bounds):
    description = "Drop rows far from the mean"
    defaults = {"threshold": 3.0}

    def fit(self, df, cfg):
        cols, t = _numeric(df, cfg), float(cfg["threshold"])
        row = agg_row(df, [e for c in cols for e in (F.avg(num(df, c)), F.stddev_pop(num(df, c)))])
        stats = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols)}
        return {"threshold": t, "stats": {c: list(v) for c, v in stats.items() if v[1]}}

    def apply(self, df, art):
        cond = F.lit(True)
        for c, (m, s) in art["stats"].items():
            if c in df.columns:
                ok = F.abs((num(df, c) - F.lit(m)) / F.lit(s)) <= F.lit(art["threshold"])
                cond = cond & F.coalesce(ok, F.lit(True))
        return df.where(cond)


@operator("Winsorize")
class Winsorize(Operator):
    description = "Clip to percentiles"
    defaults = {"lower_percentile": 5.0, "upper_percentile": 95.0}

    def fit(self, df, cfg):
        ps = [float(cfg["lower_percentile"]) / 100, float(cfg["upper_percentile"]) / 100]
        return {"bounds": {c: v for c, v in column_quantiles(df, _numeric(df, cfg), ps).items()
                           if v[0] is not None}}

    def apply(self, df, art):
        return with_columns(df, {c: clamp(num(df, c), F.lit(lo), F.lit(hi))
                                 for c, (lo, hi) in art["bounds"].items() if c in df.columns})


@operator("ManualBounds")
class ManualBounds(_Bounds):
    description = "Drop rows outside given bounds"

    def fit(self, df, cfg):
        out = {}
        for c, b in (cfg.get("bounds") or {}).items():
            lo, hi = (b.get("lower"), b.get("upper")) if isinstance(b, dict) else b
            out[c] = [None if lo is None else float(lo), None if hi is None else float(hi)]
        return {"bounds": out}


@operator("EllipticEnvelope")
class EllipticEnvelope(_Bounds):
    """One-dimensional robust envelope per column.

    Centre of the shortest half of the sorted values, then the mean of the rows near it, then a
    quantile of squared distances. The sorted values are handled as distinct values with running
    counts (plans.ordered): the sort is range-partitioned and a repeated value is one row.
    """

    description = "Drop rows far from the dense half of a column"
    defaults = {"contamination": 0.01}

    def fit(self, df, cfg):
        out, params = {}, {}
        for c in _numeric(df, cfg):
            x = df.select(num(df, c).alias("x")).where("x is not null")
            n = x.count()
            if n < 5:
                continue
            half = shortest_half_centre(x, n, (n + 3) // 2)
            sq = (F.col("x") - F.lit(half)) * (F.col("x") - F.lit(half))
            median_sq = quantiles_of(x, [sq], [0.5])[1][0][0]
            if not median_sq > 0:
                continue
            near = F.when(sq < F.lit(CHI2_TAIL_025 * median_sq / CHI2_MEDIAN), F.col("x"))
            centre = x.agg(F.avg(near)).first()[0]
            d = (F.col("x") - F.lit(centre)) * (F.col("x") - F.lit(centre))
            cut = quantiles_of(x, [d], [1.0 - float(cfg["contamination"])])[1][0][0]
            params[c] = {"location": centre, "cut": cut}
        return {"params": params}

    def apply(self, df, art):
        cond = F.lit(True)
        for c, p in art["params"].items():
            if c in df.columns:
                d = num(df, c) - F.lit(p["location"])
                cond = cond & F.coalesce(d * d <= F.lit(p["cut"]), F.lit(True))
        return df.where(cond)


# Chi-square with one degree of freedom, median and upper 2.5 % point.
CHI2_MEDIAN = 0.45493642311957283
CHI2_TAIL_025 = 5.023886187314888


def shortest_half_centre(x: DataFrame, n: int, h: int) -> float:
    """Mean midpoint of all windows (rank i, rank i + h) of least width.

    The width only changes where a window edge passes from one distinct value to the next, so
    windows between two such ranks count as one row with a weight.
    """
    from ..plans.ordered import running_totals
    d = x.groupBy(F.col("x").alias("v")).agg(F.count("*").alias("n"))
    r = running_totals(d, "v", ["n"]).select("v", "n", F.col("cum_n").alias("cn"))
    edges = (r.select(F.col("cn").alias("k")).unionByName(r.select((F.col("cn") - h).alias("k")))
             .unionByName(r.where(F.col("cn") == F.col("n")).select(F.lit(0).cast("bigint").alias("k")))
             .where((F.col("k") >= 0) & (F.col("k") < n - h)).distinct())
    edges = edges.withColumn("kd", F.col("k").cast("double"))
    nxt = running_totals(edges, "kd", ["k"]).select(
        "k", (F.coalesce(F.col("next_value"), F.lit(float(n - h))) - F.col("kd")).alias("weight"))
    low = value_at_rank(nxt.select("k"), r).toDF("k", "a")
    high = value_at_rank(nxt.select((F.col("k") + h).alias("k")), r).toDF("kh", "b")
    w = (nxt.join(low, "k").join(high, F.col("k") + h == F.col("kh"))
         .select((F.col("b") - F.col("a")).alias("width"), ((F.col("a") + F.col("b")) / 2).alias("mid"), "weight"))
    best = (w.groupBy("width").agg(F.sum(F.col("mid") * F.col("weight")).alias("m"), F.sum("weight").alias("w"))
            .orderBy("width").first())
    return best["m"] / best["w"]


def value_at_rank(ks: DataFrame, r: DataFrame, size: int = 4096) -> DataFrame:
    """(k, v): the value holding zero-based rank k, from cumulative counts per distinct value.

    A range lookup as an equi-join: a value covers ranks [cn - n, cn); it is copied to the rank
    blocks it covers, in all at most (blocks + values) rows, and blocks hold at most 4096 values.
    """
    cover = r.select("v", (F.col("cn") - F.col("n")).alias("lo"), F.col("cn").alias("hi"), F.explode(F.sequence(
        F.floor((F.col("cn") - F.col("n")) / size), F.floor((F.col("cn") - 1) / size))).alias("b"))
    k = ks.distinct().withColumn("b", F.floor(F.col("k") / size))
    return (k.join(cover, "b").where((F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
            .select("k", "v"))
