"""Full profile of a table: a few batched passes over one persisted frame."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..core import agg_row, dtype_of, nn, num, numeric_candidates, q
from ..operators.rows import exclude_columns, filter_rows
from ..plans.ordered import segmented_totals
from ..plans.quantiles import long_form
from ..stats import ks_tail
from . import advice, aggregates as A, correlations as C, temporal as TM


def geo_bounds(df: DataFrame, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """(min/max/centroid of latitude and longitude, points); empty when no valid pair is found."""
    names = {c.lower(): c for c in df.columns}
    lat = lat or next((names[k] for k in ("latitude", "lat") if k in names), None)
    lon = lon or next((names[k] for k in ("longitude", "lon", "lng", "long") if k in names), None)
    schema = ("min_lat double, max_lat double, min_lon double, max_lon double, centroid_lat double, "
              "centroid_lon double, points long")
    if not lat or not lon:
        return df.sparkSession.createDataFrame([], schema)
    d = df.where(nn(df, lat).isNotNull() & nn(df, lon).isNotNull())
    x, y = num(d, lat), num(d, lon)
    a = d.agg(F.min(x).alias("min_lat"), F.max(x).alias("max_lat"), F.min(y).alias("min_lon"), F.max(y).alias("max_lon"),
              F.avg(x).alias("centroid_lat"), F.avg(y).alias("centroid_lon"), F.count("*").alias("points"))
    return a.where("points > 0 and min_lat >= -90 and max_lat <= 90 and min_lon >= -180 and max_lon <= 180")


@F.pandas_udf(DoubleType())
def _below(z: pd.Series) -> pd.Series:
    """Share of the standard normal below z."""
    return pd.Series(0.5 * (1.0 + np.frompyfunc(math.erf, 1, 1)(z.to_numpy() / math.sqrt(2.0)).astype("float64")))


def normalities(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Kolmogorov-Smirnov test of each column against the normal with its own mean and deviation.

    One running total of the value counts within every column; three jobs whatever their number. p is asymptotic.
    Columns with at most 20 values or without spread have none.
    """
    row = agg_row(df, [e for c in columns for x in [num(df, c)] for e in (F.count(x), F.avg(x), F.stddev_pop(x))])
    moments = [(i, *row[3 * i:3 * i + 3]) for i in range(len(columns))]
    moments = [(i, n, m, s) for i, n, m, s in moments if n > 20 and s and s > 1e-10]
    if not moments:
        return {c: {} for c in columns}
    spark = df.sparkSession
    known = F.broadcast(spark.createDataFrame(moments, "i int, total long, mean double, std double"))  # a row for each column
    sizes = spark.createDataFrame([(i, n) for i, n, _, _ in moments], "i int, __n long")
    counts = long_form(df, [num(df, c) for c in columns]).where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
    run = segmented_totals(counts, ["i"], "v", ["n"], sizes=sizes).join(known, "i")
    p = run.withColumn("p", _below((F.col("v") - F.col("mean")) / F.col("std")))
    gap = F.greatest(F.col("cum_n") / F.col("total") - F.col("p"), F.col("p") - (F.col("cum_n") - F.col("n")) / F.col("total"))
    got = {r["i"]: (r["d"], r["total"]) for r in p.groupBy("i", "total").agg(F.max(gap).alias("d")).collect()}
    out = {}
    for i, c in enumerate(columns):
        out[c] = {}
        if i in got:
            tail = ks_tail(got[i][0], got[i][1])
            out[c] = {"test_name": "Kolmogorov-Smirnov", "statistic": got[i][0], "p_value": tail, "is_normal": tail > 0.05}
    return out


def normality(df: DataFrame, column: str) -> dict:
    return normalities(df, [column])[column]


def analyze(df: DataFrame, target: str | None = None, exclude: Sequence[str] = (), filters: Sequence[dict] = (),
            date: str | None = None, lat: str | None = None, lon: str | None = None, task: str | None = None,
            multivariate: bool = True) -> dict:
    """Profile report as a dict of plain values and small tables (lists of rows)."""
    df = exclude_columns(df, exclude)
    df, skipped = filter_rows(df, filters)
    df = advice.cast_date_strings(df, advice.detect_date_strings(df))
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = df.count()
        report: dict = {"row_count": n, "column_count": len(df.columns), "skipped_filters": skipped}
        if n == 0:
            report["alerts"] = [{"column": None, "type": "Empty", "severity": "error", "message": "No rows left."}]
            return report
        basic = A.basic_profile(df).collect()
        numeric = A.numeric_profile(df).collect() if numeric_candidates(df) else []
        types = advice.semantic_types(df, basic, n)
        nums = [c for c, t in types.items() if t == "Numeric"]
        feats = [c for c in nums if c != target]
        report.update(missing=A.missing_cells(df).first().asDict(), duplicates=A.duplicate_rows(df).first()[0], types=types,
                      basic=[r.asDict() for r in basic], numeric=[r.asDict() for r in numeric if r["column"] in nums])
        # every section below is one plan for all its columns
        report["histograms"] = {c: [] for c in nums}
        for r in A.histograms(df, nums).collect():
            report["histograms"][r["column"]].append({k: r[k] for k in ("bin", "start", "end", "count")})
        kinds = [c for c, t in types.items() if t in ("Categorical", "Boolean")]
        report["categories"] = {r["column"]: {k: r[k] for k in ("distinct", "rare_labels", "top")} for r in A.categorical_profiles(df, kinds).collect()} if kinds else {}
        report["dates"] = A.date_profiles(df, [c for c, t in types.items() if t == "DateTime"])
        report["texts"] = A.text_profiles(df, [c for c, t in types.items() if t == "Text" and dtype_of(df, c).typeName() == "string"])
        report["correlations"] = [r.asDict() for r in C.profile_correlations(df, nums).collect()] if len(nums) > 1 else []
        report["vif"] = C.vif(df, feats) if len(feats) > 1 else {}
        target_r = {}
        if target and target in df.columns:
            if target in nums:
                target_r = {r["column"]: r["r"] for r in C.target_correlations(df, target, feats).collect()}
                report["target_correlations"] = target_r
            else:
                report["associations"] = {r["column"]: r["eta"] for r in C.correlation_ratio(df, target, feats).collect()} if feats else {}
                report["box_plots"] = [r.asDict() for r in A.box_plots(df, target, feats).collect()] if feats else []
                report["anova"] = {c: {"f": f, "p_value": p} for c, (f, p) in C.anova(df, target, feats).items()} if feats else {}
        report["alerts"] = [r.asDict() for r in advice.alerts(df, target, basic, numeric, report["vif"], target_r).collect()]
        report["recommendations"] = [r.asDict() for r in advice.recommendations(df, target, basic, numeric).collect()]
        report["normality"] = normalities(df, nums)
        chosen = TM.pick_date_column(df, date)
        if chosen:
            trend = TM.resample_trend(df, chosen, feats, target)
            report["timeseries"] = {"date_column": chosen, "trend": [r.asDict() for r in trend.collect()],
                                    "seasonality": [r.asDict() for r in TM.seasonality(df, chosen, feats[0] if feats else None).collect()]}
            if feats:
                report["timeseries"]["acf"] = [r.asDict() for r in TM.autocorrelation(trend, feats[0]).collect()]
        geo = geo_bounds(df, lat, lon).first()
        if geo:
            report["geo"] = geo.asDict()
        if multivariate and len(feats) >= 2:
            from ..models.summaries import pca_summary, segmentation, surrogate_rules
            report["pca"] = pca_summary(df, feats)
            report["segments"] = segmentation(df, feats)
            report["edges"] = [r.asDict() for r in C.partial_correlation_edges(df, nums, target if target in nums else None).collect()]
            if target and target in df.columns:
                report["rules"] = surrogate_rules(df, feats, target, task)
        return report
    finally:
        df.unpersist()
