"""Trends, seasonality, autocorrelation and stationarity of a date column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import DATE_TYPES, dtype_of, num, numeric_candidates, q
from .aggregates import distinct_counts

STEPS = [(60, "second"), (3_600, "minute"), (86_400, "hour"), (604_800, "day")]


def pick_date_column(df: DataFrame, named: str | None = None) -> str | None:
    """The named column, or the date column with the most distinct values."""
    if named:
        return named if named in df.columns else None
    dates = [f.name for f in df.schema if isinstance(f.dataType, DATE_TYPES)]
    if not dates:
        return None
    uniq = distinct_counts(df, dates)
    return max(dates, key=lambda c: (uniq[c], -dates.index(c)))


def trend_unit(span_seconds: float) -> str:
    """Bucket unit that gives about a hundred points."""
    ideal = span_seconds / 100
    return next((u for limit, u in STEPS if ideal < limit), "week")


def resample_trend(df: DataFrame, date: str, cols: list[str] | None = None, target: str | None = None,
                   max_columns: int | None = None, raw_rows: int = 0) -> DataFrame:
    """(date, <means> or count) in about a hundred buckets; the rows themselves for a table under ``raw_rows`` rows."""
    cols = [c for c in (cols if cols is not None else numeric_candidates(df, [target] if target else []))][:max_columns]
    if target and target in numeric_candidates(df) and target not in cols:
        cols.append(target)
    d = df.where(q(date).isNotNull())
    ts = q(date).cast("timestamp")
    n, lo, hi = d.agg(F.count("*"), F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    if n < raw_rows:
        return d.select(q(date).cast("timestamp_ntz").alias("date"), *[num(d, c).alias(c) for c in cols]).na.drop().orderBy("date")
    unit = trend_unit((hi - lo) / 1e6)
    bucket = F.date_trunc(unit, ts).cast("timestamp_ntz").alias("date")
    aggs = [F.avg(num(d, c)).alias(c) for c in cols] or [F.count("*").alias("count")]
    return d.groupBy(bucket).agg(*aggs).orderBy("date")


def seasonality(df: DataFrame, date: str, metric: str | None = None) -> DataFrame:
    """(kind, position, name, value): by weekday (Mon=1) and by month; mean of the metric or count."""
    d = df.where(q(date).isNotNull())
    v = (F.avg(num(d, metric)) if metric else F.count("*")).cast("double").alias("value")
    ts = q(date).cast("timestamp")
    # one grouping for both: (kind, position, name) pairs
    keys = F.array(F.struct(F.lit("weekday").alias("kind"), (F.weekday(ts) + 1).alias("position"), F.date_format(ts, "EEE").alias("name")),
                   F.struct(F.lit("month").alias("kind"), F.month(ts).alias("position"), F.date_format(ts, "MMM").alias("name")))
    src = d.select(F.explode(keys).alias("k"), *([num(d, metric).alias(metric)] if metric else []))
    agg = (F.avg(q(metric)) if metric else F.count("*")).cast("double").alias("value")
    return src.groupBy("k").agg(agg).select("k.kind", "k.position", "k.name", "value").orderBy("kind", "position")


def autocorrelation(trend: DataFrame, metric: str, max_lag: int = 30) -> DataFrame:
    """(lag, corr) of a resampled series (a bounded number of points), missing points as the mean.

    All lags are one self-join on the position, each point meeting at most max_lag others.
    """
    spark = trend.sparkSession
    mean0 = trend.agg(F.avg(metric)).first()[0]
    n = trend.count()
    schema = "lag int, corr double"
    if n <= 10 or mean0 is None:
        return spark.createDataFrame([], schema)
    pos = F.row_number().over(W.orderBy("date"))  # one row per time bucket
    s = trend.select("date", F.coalesce(F.when(~F.isnan(q(metric).cast("double")), q(metric).cast("double")), F.lit(mean0)).alias("y"))
    m, var = s.agg(F.avg("y"), F.var_pop("y")).first()
    s = s.select(pos.alias("t"), (F.col("y") - F.lit(m)).alias("y"))
    lags = list(range(1, min(max_lag + 1, n // 2)))
    ahead = s.select((F.col("t")).alias("t2"), F.col("y").alias("y2"))
    shifted = s.select("y", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "t").withColumn("t2", F.col("t") + F.col("lag"))
    g = shifted.join(ahead, "t2").groupBy("lag").agg(F.sum(F.col("y") * F.col("y2")).alias("s"))
    corr = F.lit(0.0) if not var else F.col("s") / F.lit(float(n)) / F.lit(var)
    return g.select("lag", corr.alias("corr")).orderBy("lag")


# MacKinnon (2010) 1, 5 and 10 % critical value surfaces of the constant-only test.
ADF_SURFACE = {"1%": [-3.43035, -6.5393, -16.786, -79.433], "5%": [-2.86154, -2.8903, -4.234, -40.040],
               "10%": [-2.56677, -1.5384, -2.809, 0.0]}


def stationarity(trend: DataFrame, metric: str, lags: int | None = None) -> dict:
    """Augmented Dickey-Fuller test of a resampled series by a Spark ML regression."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    n = trend.count()
    if n <= 20:
        return {}
    p = lags if lags is not None else min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    mean0 = trend.agg(F.avg(metric)).first()[0]
    w = W.orderBy("date")  # one row per time bucket
    s = trend.select("date", F.coalesce(q(metric).cast("double"), F.lit(mean0)).alias("y"))
    s = s.withColumn("prev", F.lag("y").over(w)).withColumn("d", F.col("y") - F.col("prev"))
    for k in range(1, p + 1):
        s = s.withColumn(f"d{k}", F.lag("d", k).over(w))
    s = s.na.drop()
    vec = VectorAssembler(inputCols=["prev"] + [f"d{k}" for k in range(1, p + 1)], outputCol="x").transform(s)
    model = LinearRegression(featuresCol="x", labelCol="d", solver="normal").fit(vec)
    m = s.count()
    stat = float(model.summary.tValues[0])
    crit = {k: b[0] + b[1] / m + b[2] / m ** 2 + b[3] / m ** 3 for k, b in ADF_SURFACE.items()}
    return {"test_statistic": stat, "critical_values": crit, "is_stationary": stat < crit["5%"], "metric": metric, "lags": p}
