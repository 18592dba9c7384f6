"""Grouped and whole-table statistics. Every function returns a small DataFrame."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..core import DATE_TYPES, agg_row, dtype_of, is_numeric, nn, num, numeric_candidates, q
from ..operators.rows import filter_rows_coerced
from ..plans.quantiles import column_quantiles, grouped_quantiles, long_form, quantile_sets

MEASURES = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max}


def decompose(df: DataFrame, measure: str | None = None, agg: str = "count", split_col: str | None = None,
              filters: Sequence[dict] = ()) -> DataFrame:
    """(name, value, count, ratio): a measure in total or by one column, largest first."""
    d = filter_rows_coerced(df, filters)
    n = F.count("*").alias("count")
    if measure and measure in d.columns and agg in MEASURES:
        value = F.coalesce(MEASURES[agg](num(d, measure)), F.lit(0.0)).cast("double").alias("value")
    else:
        value = F.count("*").cast("double").alias("value")
    if not split_col or split_col not in d.columns:
        return d.agg(value, n).select(F.lit("Total").alias("name"), "value", "count", F.lit(1.0).alias("ratio"))
    key = F.coalesce(nn(d, split_col).cast("string"), F.lit("Unknown"))
    g = d.groupBy(key.alias("name")).agg(value, n)
    total = g.agg(F.sum("value").alias("total"))
    # one row, so the join below only carries a scalar
    return (g.join(F.broadcast(total)).select(
        "name", "value", "count",
        F.when(F.col("total") != 0, F.col("value") / F.col("total")).otherwise(F.lit(0.0)).alias("ratio"))
        .orderBy(F.desc("value"), "name"))


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """(duplicates): rows that belong to a group of equal rows, all members counted."""
    cols = list(subset or df.columns)
    g = df.groupBy(*[q(c) for c in cols]).agg(F.count("*").alias("__n"))
    return g.where("__n > 1").agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("duplicates"))


def value_counts(df: DataFrame, column: str, k: int | None = 10) -> DataFrame:
    out = (df.where(nn(df, column).isNotNull()).groupBy(nn(df, column).cast("string").alias("value"))
           .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value"))
    return out if k is None else out.limit(k)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> dict[str, int]:
    """Distinct values per column, null counted as a value.

    All columns go through one (column, value) grouping, so no per-column distinct set is built in
    one task and the data is not expanded once per distinct aggregate.
    """
    if approximate:
        row = agg_row(df, [F.approx_count_distinct(nn(df, c), 0.01) + F.max(nn(df, c).isNull().cast("int"))
                           for c in columns])
        return dict(zip(columns, row))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), nn(df, c).cast("string").alias("v"))
                      for i, c in enumerate(columns)])
    rows = (df.select(F.explode(pairs).alias("p")).select("p.i", "p.v").distinct()
            .groupBy("i").agg(F.count("*").alias("n")).collect())
    got = {r["i"]: r["n"] for r in rows}
    return {c: got.get(i, 0) for i, c in enumerate(columns)}


def basic_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, null_count, distinct_count)."""
    cols = list(columns or df.columns)
    row = agg_row(df, [F.count("*")] + [F.count(nn(df, c)) for c in cols])
    uniq = distinct_counts(df, cols, approximate)
    rows = [(c, int(row[0] - h), int(uniq[c])) for c, h in zip(cols, row[1:])]
    return df.sparkSession.createDataFrame(rows, "column string, null_count long, distinct_count long")


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, interpolation: str = "nearest"
                    ) -> DataFrame:
    """One row per numeric column: moments, quartiles, zeros and negatives."""
    cols = list(columns or numeric_candidates(df))
    fns = [F.avg, F.stddev_samp, F.var_samp, F.min, F.max, F.skewness, F.kurtosis]
    exprs = []
    for c in cols:
        x = num(df, c)
        exprs += [f(x) for f in fns] + [F.count_if(x == 0), F.count_if(x < 0)]
    row = agg_row(df, exprs)
    quart, med = quantile_sets(df, cols, [([0.25, 0.75], "nearest" if interpolation == "nearest" else "linear"), ([0.5], "linear")])
    rows, k = [], len(fns) + 2
    for i, c in enumerate(cols):
        mean, std, var, lo, hi, skew, kurt, zeros, negs = row[k * i:k * i + k]
        rows.append((c, mean, med[c][0], std, var, lo, hi, quart[c][0], quart[c][1], skew, kurt, int(zeros), int(negs)))
    return df.sparkSession.createDataFrame(rows, (
        "column string, mean double, median double, std double, variance double, min double, max double, "
        "q25 double, q75 double, skewness double, kurtosis double, zeros long, negatives long"))


def categorical_profiles(df: DataFrame, columns: Sequence[str], rare_below: int = 5) -> DataFrame:
    """(column, distinct, rare_labels, top): distinct labels, labels seen fewer than five times, most common; all columns at once."""
    cols = list(columns)
    counts = long_form(df, [nn(df, c).cast("string") for c in cols]).where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
    head = counts.groupBy("i").agg(F.count("*").alias("distinct"), F.count_if(F.col("n") < rare_below).alias("rare_labels"))
    place = F.row_number().over(W.partitionBy("i").orderBy(F.desc("n"), "v"))
    best = counts.withColumn("__r", place).where(F.col("__r") <= 10).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("__r", "v", "n"))).alias("t"))
    top = F.array_join(F.transform("t", lambda r: F.concat_ws(":", r["v"], r["n"].cast("string"))), ",")
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, column string")
    out = names.join(F.broadcast(head), "i", "left").join(F.broadcast(best), "i", "left")  # a row for each column
    return out.select("column", F.coalesce("distinct", F.lit(0)).cast("bigint").alias("distinct"), F.coalesce("rare_labels", F.lit(0)).cast("bigint").alias("rare_labels"), F.coalesce(top, F.lit("")).alias("top"))


def categorical_profile(df: DataFrame, column: str, rare_below: int = 5) -> DataFrame:
    """(distinct, rare_labels, top) of one column."""
    return categorical_profiles(df, [column], rare_below).drop("column")


def date_profiles(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """First and last date and the days between, of all columns in one aggregate."""
    row = agg_row(df, [e for c in columns for e in (F.min(q(c)), F.max(q(c)), F.datediff(F.max(q(c)), F.min(q(c))).cast("bigint"))])
    return {c: dict(zip(("min_date", "max_date", "duration_days"), row[3 * i:3 * i + 3])) for i, c in enumerate(columns)}


def date_profile(df: DataFrame, column: str) -> DataFrame:
    x = q(column)
    return df.agg(F.min(x).alias("min_date"), F.max(x).alias("max_date"),
                  F.datediff(F.max(x), F.min(x)).cast("bigint").alias("duration_days"))


def text_profiles(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Mean, least and largest length in bytes, of all columns in one aggregate."""
    row = agg_row(df, [f(F.octet_length(q(c))) for c in columns for f in (F.avg, F.min, F.max)])
    return {c: dict(zip(("avg_length", "min_length", "max_length"), row[3 * i:3 * i + 3])) for i, c in enumerate(columns)}


def text_profile(df: DataFrame, column: str) -> DataFrame:
    n = F.octet_length(q(column))
    return df.agg(F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """(column, bin, start, end, count): equal-width, right-closed, the first bin holds the minimum; two scans for all columns.
    A column without two values has no rows."""
    from .drift import bin_counts
    row = agg_row(df, [f(num(df, c)) for c in columns for f in (F.min, F.max)])
    edges = {}
    for i, c in enumerate(columns):
        lo, hi = row[2 * i:2 * i + 2]
        if lo is not None and lo != hi:
            edges[c] = [lo + k * ((hi - lo) / bins) for k in range(bins)] + [hi]
    rows = [(c, k, edges[c][k], edges[c][k + 1], n) for c, counts in bin_counts(df, edges, "right").items() for k, n in enumerate(counts)]
    return df.sparkSession.createDataFrame(rows, "column string, bin int, start double, end double, count long")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, start, end, count) of one column."""
    return histograms(df, [column], bins).drop("column")


def histogram10(df: DataFrame, x: Column, bins: int = 10) -> DataFrame:
    """(bin, start, end, count): equal-width, left-closed, the last bin closed."""
    x = x.cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    schema = "bin int, start double, end double, count long"
    if lo is None:
        return df.sparkSession.createDataFrame([], schema)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    edges = [lo + i * width for i in range(bins)] + [hi]
    return _filled(df, _edge_bin(x, edges, "left"), edges, schema)


def _edge_bin(x: Column, edges: list[float], closed: str) -> Column:
    n = len(edges) - 1
    if closed == "right":
        e = F.lit(None).cast("int")
        for i in range(n - 1, -1, -1):
            e = F.when(x <= F.lit(edges[i + 1]), F.lit(i)).otherwise(e)
        return F.when(x >= F.lit(edges[0]), e)
    e = F.lit(0)
    for i in range(1, n):
        e = F.when(x >= F.lit(edges[i]), F.lit(i)).otherwise(e)
    return F.when((x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])), e)


def _filled(df, bin_col, edges, schema):
    n = len(edges) - 1
    frame = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(n)],
                                            "bin int, start double, end double")
    counts = df.groupBy(bin_col.alias("bin")).agg(F.count("*").alias("c")).where("bin is not null")
    return (frame.join(F.broadcast(counts), "bin", "left")  # at most one row per bin
            .select("bin", "start", "end", F.coalesce("c", F.lit(0)).cast("bigint").alias("count")))


def box_plots(df: DataFrame, target: str, columns: Sequence[str], max_groups: int | None = None, max_features: int | None = None,
              method: str = "nearest") -> DataFrame:
    """(column, group, min, q1, median, q3, max) for every group of the target; limits only where a caller sets them."""
    if max_groups is not None and df.where(nn(df, target).isNotNull()).select(nn(df, target)).distinct().limit(max_groups + 1).count() > max_groups:
        raise ValueError(f"{target} has more than {max_groups} groups")
    cols = list(columns)[:max_features]
    g = grouped_quantiles(df.where(nn(df, target).isNotNull()), target, cols, [0.0, 0.25, 0.5, 0.75, 1.0], method=method)
    items = F.array(*[F.struct(F.lit(c).alias("c"), q(f"{c}_q").alias("v")) for c in cols])
    return g.select(q(target).cast("string").alias("group"), F.explode(items).alias("p")).select(
        F.col("p.c").alias("column"), "group",
        *[F.col("p.v")[i].alias(n) for i, n in enumerate(["min", "q1", "median", "q3", "max"])])


def class_balance(df: DataFrame, target: str, max_classes: int | None = None) -> DataFrame:
    """(classes, min_count, max_count, ratio, advice)."""
    g = df.where(nn(df, target).isNotNull()).groupBy(nn(df, target).alias("k")).agg(F.count("*").alias("n"))
    r = F.min("n") / F.max("n")
    return (g.agg(F.count("*").alias("classes"), F.min("n").alias("min_count"), F.max("n").alias("max_count"),
                  r.alias("ratio")).where(F.lit(True) if max_classes is None else F.col("classes") <= max_classes)
            .withColumn("advice", F.when(F.col("ratio") < 0.2, "resample").when(F.col("ratio") > 0.8, "balanced")
                        .otherwise("none")))


def cluster_profile(df: DataFrame, cluster: str, columns: Sequence[str], top: int = 2) -> DataFrame:
    """(cluster, size, <mean per column>, label): features farthest from the overall mean named."""
    row = agg_row(df, [e for c in columns for e in (F.avg(num(df, c)), F.stddev_samp(num(df, c)))])
    g = df.groupBy(q(cluster).alias("cluster")).agg(
        F.count("*").alias("size"), *[F.avg(num(df, c)).alias(c) for c in columns])
    zs = F.array(*[F.struct(
        (-F.abs((q(c) - F.lit(row[2 * i])) / F.lit(row[2 * i + 1] or 1.0))).alias("o"), F.lit(i).alias("i"),
        F.concat(F.when(q(c) >= F.lit(row[2 * i]), "High ").otherwise("Low "), F.lit(c)).alias("t"))
        for i, c in enumerate(columns)])
    return g.withColumn("label", F.array_join(F.transform(F.slice(F.array_sort(zs), 1, top), lambda s: s["t"]), ", "))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, count) of non-null pairs; combinations that do not occur are absent."""
    return (df.where(nn(df, a).isNotNull() & nn(df, b).isNotNull())
            .groupBy(nn(df, a).alias("a"), nn(df, b).alias("b")).agg(F.count("*").alias("count")))


def missing_cells(df: DataFrame) -> DataFrame:
    """(rows, columns, missing_cells, missing_percent)."""
    cols = df.columns
    miss = F.lit(0)
    for c in cols:
        miss = miss + nn(df, c).isNull().cast("int")
    return (df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(miss), F.lit(0)).cast("bigint").alias("missing_cells"))
            .select("rows", F.lit(len(cols)).alias("columns"), "missing_cells",
                    F.when(F.col("rows") > 0, 100.0 * F.col("missing_cells") / (F.col("rows") * len(cols)))
                    .otherwise(F.lit(0.0)).alias("missing_percent")))


def quality_report(df: DataFrame) -> DataFrame:
    """(column, null_count, null_percentage, unique_count, quality, min, max, mean, overall)."""
    cols = df.columns
    exprs = [F.count("*")]
    for c in cols:
        exprs.append(F.count(nn(df, c)))
        exprs += [f(num(df, c)) if is_numeric(df, c) else F.lit(None).cast("double") for f in (F.min, F.max, F.avg)] \
            if is_numeric(df, c) else [F.max(F.lit(None).cast("double"))] * 3
    row = agg_row(df, exprs)
    uniq = distinct_counts(df, cols)
    n, rows = row[0], []
    for i, c in enumerate(cols):
        have, lo, hi, mean = row[1 + 4 * i:5 + 4 * i]
        nulls = n - have
        rows.append((c, int(nulls), 100.0 * nulls / n if n else 0.0, int(uniq[c]) - (1 if nulls else 0),
                     1.0 - nulls / n if n else 0.0, lo, hi, mean))
    overall = sum(r[4] for r in rows) / len(rows) if rows else 0.0
    return df.sparkSession.createDataFrame([(*r, overall) for r in rows], (
        "column string, null_count long, null_percentage double, unique_count long, quality double, "
        "min double, max double, mean double, overall double"))


def ingest_profile(df: DataFrame, top: int = 5) -> DataFrame:
    """(column, type, null_count, null_percentage, unique_count, mean, std, min, max, median, top_values)."""
    cols, nums = df.columns, numeric_candidates(df)
    texts = [c for c in cols if isinstance(dtype_of(df, c), T.StringType)]
    row = agg_row(df, [F.count("*")] + [F.count(nn(df, c)) for c in cols]
                  + [f(num(df, c)) for c in nums for f in (F.avg, F.stddev_samp, F.min, F.max)])
    uniq = distinct_counts(df, cols)
    med = column_quantiles(df, nums, [0.5])
    tops: dict[str, list] = {}
    if texts:
        from ..operators.encoding import _top_categories, category_counts
        for r in _top_categories(category_counts(df, texts), top).collect():
            tops[r["c"]] = [f"{x['v']}:{-x['m']}" for x in r["t"]]
    n, rows = row[0], []
    stats = {c: row[1 + len(cols) + 4 * i:5 + len(cols) + 4 * i] for i, c in enumerate(nums)}
    for i, c in enumerate(cols):
        miss = n - row[1 + i]
        m = list(stats.get(c, (None,) * 4))
        rows.append((c, dtype_of(df, c).simpleString(), int(miss), 100.0 * miss / n if n else 0.0, int(uniq[c]), *m,
                     med[c][0] if c in med else None, ",".join(tops.get(c, [])) or None))
    return df.sparkSession.createDataFrame(rows, (
        "column string, type string, null_count long, null_percentage double, unique_count long, mean double, "
        "std double, min double, max double, median double, top_values string"))
