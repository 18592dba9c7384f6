"""Running totals and bounded-frame windows without one giant task."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import q
from ..session import cut_lineage

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 20_000


def range_bounds(df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_BUCKET,
                 n: int | None = None) -> list[float]:
    """Inner boundaries that cut a numeric column into ranges of about equal row counts."""
    n = df.count() if n is None else n
    parts = min(MAX_BUCKETS, max(1, math.ceil(n / rows_per_bucket)))
    if parts == 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(q(value), probs, max(10_000, 10 * parts))).first()[0]
    return sorted(set(got or []))


def add_bucket(df: DataFrame, value: str, bounds: Sequence[float], out: str = "__bucket") -> DataFrame:
    """Range bucket of a double column; fixed boundaries keep it the same on every retry."""
    if not bounds:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=value, outputCol=out).transform(df)


def running_totals(df: DataFrame, value: str, totals: Sequence[str],
                   rows_per_bucket: int = ROWS_PER_BUCKET, n: int | None = None) -> DataFrame:
    """Add ``cum_<t>`` (inclusive, ascending value) and ``next_value``.

    ``value`` must be a non-null double and distinct: callers group by it first, so a value that
    holds a third of all rows is one row here. Range buckets are windowed apart and shifted by
    the totals of the buckets below, a table with one row per bucket.
    """
    bounds = range_bounds(df, value, rows_per_bucket, n)
    b = add_bucket(df, value, bounds)
    w = W.partitionBy("__bucket").orderBy(q(value))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    cums = [F.sum(q(t)).over(run).alias(f"cum_{t}") for t in totals]
    out = b.select("*", *cums, F.lead(q(value)).over(w).alias("next_value"))
    if not bounds:
        return out.drop("__bucket")
    per = (b.groupBy("__bucket").agg(F.min(q(value)).alias("lo"), *[F.sum(q(t)).alias(t) for t in totals])
           .orderBy("__bucket").collect())
    rows, acc = [], [0] * len(totals)
    for i, r in enumerate(per):
        rows.append((r["__bucket"], *[float(a) for a in acc],
                     per[i + 1]["lo"] if i + 1 < len(per) else None))
        acc = [a + r[t] for a, t in zip(acc, totals)]
    schema = "__bucket double, " + ", ".join(f"`off_{t}` double" for t in totals) + ", next_lo double"
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # <= MAX_BUCKETS rows
    keep = [q(c) for c in df.columns]
    types = {f.name: f.dataType for f in out.schema}
    shifted = [(q(f"cum_{t}") + q(f"off_{t}")).cast(types[f"cum_{t}"]).alias(f"cum_{t}") for t in totals]
    return (out.join(offsets, "__bucket", "left")
            .select(*keep, *shifted, F.coalesce("next_value", "next_lo").alias("next_value")))


#: sampled rows for each boundary between stretches, boundaries in all (and of tables with more than `ROWS_PER_BUCKET` rows for each),
#: and rows of a small table that may be broadcast
PER_BOUND, MAX_BOUNDS, MOST_BOUNDS, SMALL_TABLE = 64, 64, 1_024, 100_000


def _null_safe(left: Sequence[str], right: Sequence[str]):
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & q(a).eqNullSafe(q(b))
    return out


def _beside(df: DataFrame, table: DataFrame, rows: int, keys: Sequence[str], how: str) -> DataFrame:
    """Join by keys that may be null; broadcast below a checked number of rows."""
    return df.join(F.broadcast(table) if rows <= SMALL_TABLE else table, _null_safe(keys, [f"__k{i}" for i in range(len(keys))]), how)


def _with_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join by equally named keys that may be null."""
    named = right.select(*[q(k).alias(f"__o{i}") for i, k in enumerate(keys)], *[q(c) for c in right.columns if c not in keys])
    return left.join(named, _null_safe(keys, [f"__o{i}" for i in range(len(keys))]), "left").drop(*[f"__o{i}" for i in range(len(keys))])


def split_hot_groups(df: DataFrame, group_by: Sequence[str], sort_by: Sequence[str], halo: int,
                     hot_rows: int = 5_000_000, sizes: DataFrame | None = None) -> tuple[DataFrame, list[str], list]:
    """Cut oversized groups into ranges of the whole sort tuple for frames of bounded width.

    Returns a frame with ``__slice`` and ``__halo``, the partition columns and the order to use. Each slice
    also receives the last ``halo`` rows before it, marked ``__halo``, so a frame reaching at most
    ``halo`` rows back sees what it would see in the whole group. Boundaries are quantiles of a
    hash sample of the tuples, any type that sorts; rows with equal tuples are told apart by a hash of
    the whole row, so a tuple that many rows share is cut like any other (rows equal in every
    column stay together at a boundary). Every row looks for its place among the boundaries, so there are about ``MAX_BOUNDS`` of
    them at most: longer stretches are numbered and cut by these numbers. Hot groups, boundaries and halos are tables. Groups below the limit
    (all of them, usually) are left alone and cost nothing but the counting pass, and not that if
    ``sizes`` (the keys and ``__n``, rows or more) is known.
    """
    keys = list(group_by)
    if not keys:
        df = df.withColumn("__all", F.lit(0))
        keys = ["__all"]
    order = [q(s).asc_nulls_first() for s in sort_by]
    named = [q(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    kn = [f"__k{i}" for i in range(len(keys))]
    if sizes is None:
        hot = cut_lineage(df.groupBy(*named).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows))
    else:  # a table already
        hot = sizes.select(*named, "__n").where(F.col("__n") > hot_rows)
    n_hot, n_rows = hot.agg(F.count("*"), F.sum("__n")).first()
    if not n_hot:
        return df.withColumn("__slice", F.lit(0)).withColumn("__halo", F.lit(False)), keys + ["__slice"], order
    plain = [F.to_json(F.struct(q(f.name))) if "map<" in f.dataType.simpleString() else q(f.name) for f in df.schema]
    df = df.withColumn("__tie", F.xxhash64(*plain))
    order = order + [F.col("__tie").asc()]
    at = F.struct(*[q(s).alias(f"s{i}") for i, s in enumerate(sort_by)], F.col("__tie").alias("tie"))
    # boundaries of every hot group: each PER_BOUND-th of its sampled tuples
    half = max(hot_rows, 2 * halo + 1) / 2  # rows of a slice
    stretch = max(half, min(n_rows / MAX_BOUNDS, ROWS_PER_BUCKET), n_rows / MOST_BOUNDS)
    rate = min(1.0, PER_BOUND / stretch)
    mine = _beside(df.select(*[q(k) for k in keys], at.alias("__at")), hot, n_hot, keys, "inner")
    sample = mine.where(F.pmod(F.xxhash64("__at", F.lit(7)), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).select(*kn, "__at")
    step = max(1, round(rate * stretch))
    place = F.row_number().over(W.partitionBy(*kn).orderBy("__at"))
    bounds = sample.withColumn("__r", place).where(F.col("__r") % step == 0).groupBy(*kn).agg(F.array_sort(F.collect_set("__at")).alias("__bounds"))
    wide = F.ceil(F.sqrt(F.size("__bounds"))).cast("int")
    bounds = cut_lineage(bounds.withColumn("__wide", wide).withColumn("__heads", F.filter("__bounds", lambda _, i: i % F.col("__wide") == 0)))
    n_bounds = bounds.agg(F.sum(F.size("__bounds"))).first()[0] or 0
    if stretch > half:  # groups without a boundary may still be cut
        bounds, n_bounds = _with_keys(hot.select(*kn, F.lit(True).alias("__cut")), bounds, kn), max(n_bounds, n_hot)
    # two short scans: which stretch of boundaries, then which of its boundaries
    cut = _beside(df.withColumn("__at", at), bounds, n_bounds, keys, "left")
    head = F.size(F.filter("__heads", lambda b: b <= F.col("__at")))
    inner = F.slice("__bounds", (F.greatest(F.col("__head"), F.lit(1)) - 1) * F.col("__wide") + 1, F.col("__wide"))
    cut = cut.withColumn("__head", head).withColumn("__slice", F.when(F.col("__head") > 0, (F.col("__head") - 1) * F.col("__wide") + F.size(F.filter(inner, lambda b: b <= F.col("__at")))).otherwise(0).cast("int"))
    parts = keys + ["__slice"]
    if stretch > half:
        number = F.row_number().over(W.partitionBy(*[q(k) for k in parts]).orderBy(*order)) - 1
        finer = F.col("__slice").cast("long") * (1 << 32) + F.floor(number / F.lit(max(1, int(half))))
        cut = cut.withColumn("__finer", finer).withColumn("__slice", F.when(F.col("__cut"), F.col("__finer")).otherwise(F.lit(0).cast("long")))
    cut = cut.select(*[q(c) for c in df.columns], "__slice").withColumn("__halo", F.lit(False))
    if halo < 1:
        return cut, parts, order
    back = W.partitionBy(*[q(k) for k in parts]).orderBy(*[q(s).desc_nulls_last() for s in sort_by], F.col("__tie").desc())
    tails = cut.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= halo)
    tails = cut_lineage(_beside(tails, hot.select(*kn), n_hot, keys, "left_semi"))  # halo rows for each slice
    # a slice may hold fewer rows than the halo: then it takes from those before it too
    each = tails.groupBy(*named, F.col("__slice").alias("__from")).agg(F.count("*").alias("m"))
    of = W.partitionBy(*kn).orderBy("__from")
    each = each.withColumn("c", F.sum("m").over(of)).withColumn("__before", F.col("c") - F.col("m"))
    nexts = F.collect_list(F.struct(F.col("__from").alias("to"), F.col("__before").alias("before"))).over(of.rowsBetween(1, halo))
    pairs = each.withColumn("__next", nexts).select(*kn, "__from", "c", F.explode("__next").alias("n"))
    pairs = pairs.select(*kn, "__from", F.col("n.to").alias("__to"), (F.col("n.before") - F.col("c")).alias("__gap")).where(F.col("__gap") < halo)
    near = _null_safe(keys, kn) & (F.col("__slice") == F.col("__from")) & (F.col("__back") + F.col("__gap") <= halo)
    halos = tails.join(pairs, near).withColumn("__slice", F.col("__to")).withColumn("__halo", F.lit(True))
    # a copy of a row may lie in the slice before: it comes first
    return cut.unionByName(halos.select(*[q(c) for c in cut.columns])), parts, order + [F.col("__halo").desc()]


def segmented_totals(df: DataFrame, keys: Sequence[str], value: str, totals: Sequence[str],
                     hot_rows: int = ROWS_PER_BUCKET, sizes: DataFrame | None = None) -> DataFrame:
    """Add ``cum_<t>`` (inclusive, ascending value) within each segment.

    A value must occur once in a segment: callers group first. All segments are windowed at once; those above
    ``hot_rows`` rows are cut into slices, which are shifted by the totals of the slices before them.
    """
    cut, parts, order = split_hot_groups(df, keys, [value], 0, hot_rows, sizes)
    w = W.partitionBy(*[q(p) for p in parts]).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = cut.select("*", *[F.sum(q(t)).over(w).alias(f"cum_{t}") for t in totals])
    if "__tie" not in cut.columns:  # nothing was cut
        return out.drop("__slice", "__halo", "__all")
    per = cut.groupBy(*[q(p) for p in parts]).agg(*[F.sum(q(t)).alias(f"sum_{t}") for t in totals])
    before = W.partitionBy(*[q(k) for k in parts[:-1]]).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut_lineage(per.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(parts)], *[F.coalesce(F.sum(f"sum_{t}").over(before), F.lit(0)).alias(f"off_{t}") for t in totals]))
    shifted = _beside(out, offsets, offsets.count(), parts, "left")
    return shifted.select(*[q(c) for c in df.columns], *[(q(f"cum_{t}") + q(f"off_{t}")).alias(f"cum_{t}") for t in totals])
