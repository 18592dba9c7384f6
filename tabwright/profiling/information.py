"""Mutual information from nearest neighbours.

For a number x and a class y: psi(N) + mean psi(k) - mean psi(n_y) - mean psi(m), where r is the distance from a row to the
k-th nearest row of its class and m counts the rows of all classes closer than r, itself included (Ross 2014). For two
numbers: psi(N) + mean psi(k) - mean psi(n_x) - mean psi(n_y), with r the k-th smallest larger of both distances, in units of
each column's deviation (Kraskov, Stoegbauer and Grassberger 2004). Where k rows or more are equal, r is 0, and k and the counts
are those of the equal rows, itself left out (Gao, Kannan, Oh and Viswanath 2017): repeated values need no random noise.

Equal rows are counted first, so a value that a third of the rows hold is one row. Neighbours in one dimension are those
next in order, found by frames over bounded slices; counts within a radius are differences of running totals.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import agg_row, nn, num, q
from ..plans.neighbors import knn_join
from ..plans.ordered import segmented_totals, split_hot_groups
from ..session import cut_lineage

NEIGHBOURS = 3
#: distances that differ by less than this share of the value are equal: 0.1 + 0.2 is no farther than 0.3
EVEN = 1e-12


def digamma(m: Column) -> Column:
    """psi of a whole number from 1 on: ten steps up, then the asymptotic series (error below 1e-13)."""
    x = m.cast("double")
    z = x + F.lit(10.0)
    steps = sum((F.lit(1.0) / (x + F.lit(float(i))) for i in range(10)), F.lit(0.0))
    s = F.lit(1.0) / (z * z)
    tail = s * (F.lit(1 / 12) - s * (F.lit(1 / 120) - s * (F.lit(1 / 252) - s * (F.lit(1 / 240) - s * F.lit(1 / 132)))))
    return F.log(z) - F.lit(0.5) / z - tail - steps


def _radius(own: Column, others: Column, k: Column) -> Column:
    """Distance to the k-th nearest of counted values; ``own`` rows equal this one, itself included."""
    near = F.array_sort(F.concat(F.array(F.struct(F.lit(0.0).alias("d"), (own - 1).alias("n"))), others))
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("r"))

    def step(a, v):
        c = a["c"] + v["n"]
        return F.struct(c.alias("c"), F.coalesce(a["r"], F.when(c >= k, v["d"])).alias("r"))
    return F.aggregate(near, start, step)["r"]


def _edges(x: Column, r: Column) -> tuple[Column, Column]:
    """Values strictly between them are closer than r."""
    inside = F.greatest(r - (F.abs(x) + r) * F.lit(EVEN), r / 2)
    return x - inside, x + inside


def _within(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``centres`` (segment, x, r, ...) with ``m``: rows of the segment closer than r, or equal rows but itself where r is 0.

    ``points`` holds segment, x, n. Edges of the ranges are put among the values with no rows of their own, so one running
    total over values gives both counts.
    """
    lo, hi = _edges(F.col("x"), F.col("r"))
    centres = centres.withColumn("lo", lo).withColumn("hi", hi)
    marks = [centres.select("segment", F.col(c).alias("x"), F.lit(0).cast("long").alias("n")) for c in ("lo", "hi")]
    values = points.select("segment", "x", F.col("n").cast("long").alias("n")).unionByName(marks[0]).unionByName(marks[1])
    values = cut_lineage(values.groupBy("segment", "x").agg(F.sum("n").alias("n")))
    totals = segmented_totals(values, ["segment"], "x", ["n"])
    upto = totals.select("segment", F.col("x").alias("lo"), F.col("cum_n").alias("upto"), F.col("n").alias("here"))
    below = totals.select("segment", F.col("x").alias("hi"), (F.col("cum_n") - F.col("n")).alias("below"))
    counted = centres.join(upto, ["segment", "lo"], "left").join(below, ["segment", "hi"], "left")
    return counted.withColumn("m", F.when(F.col("r") == 0, F.col("here") - 1).otherwise(F.col("below") - F.col("upto")))


def class_information(df: DataFrame, cols: Sequence[str], target: str, k: int = NEIGHBOURS) -> dict[str, float]:
    """Mutual information (nats, at least 0) of each numeric column with the classes of ``target``, all columns in one plan.

    Rows without the value or the target, and rows that are alone in their class, take no part; a column without other rows has 0.
    """
    y = nn(df, target).cast("string")
    each = F.array(*[F.struct(F.lit(i).alias("segment"), num(df, c).alias("x")) for i, c in enumerate(cols)])
    long = df.select(y.alias("y"), F.explode(each).alias("p")).select("p.segment", "y", F.col("p.x").alias("x"))
    long = long.where(F.col("x").isNotNull() & (F.abs("x") < float("inf")) & F.col("y").isNotNull()).withColumn("x", F.col("x") + F.lit(0.0))
    counts = cut_lineage(long.groupBy("segment", "y", "x").agg(F.count("*").alias("n")))
    sizes = cut_lineage(counts.groupBy("segment", "y").agg(F.sum("n").alias("ny"), F.count("*").alias("values")).where("ny > 1"))
    counts = counts.join(sizes.select("segment", "y", "ny"), ["segment", "y"])
    # k rows behind the last value of each class let one frame that only looks back see both sides
    ends = sizes.select("segment", "y", F.lit(None).cast("double").alias("x"), F.lit(0).cast("long").alias("n"), "ny",
                        F.explode(F.sequence(F.lit(1), F.lit(k))).alias("pad"))
    padded = counts.withColumn("pad", F.lit(0)).unionByName(ends)
    known = sizes.select("segment", "y", (F.col("values") + k).alias("__n"))
    cut, parts, order = split_hot_groups(padded, ["segment", "y"], ["pad", "x"], 2 * k, sizes=known)
    w = W.partitionBy(*[q(p) for p in parts]).orderBy(*order)
    frame = cut.select("segment", "y", "ny", "__halo", *[F.lag(F.struct("x", "n"), j).over(w).alias(f"v{j}") if j else F.struct("x", "n").alias("v0") for j in range(2 * k + 1)])
    centre = F.col(f"v{k}")
    frame = frame.where(~F.col("__halo") & centre["x"].isNotNull())
    sides = [F.when(F.col(f"v{j}.x").isNotNull(), F.struct(F.abs(F.col(f"v{j}.x") - centre["x"]).alias("d"), F.col(f"v{j}.n").alias("n"))) for j in range(2 * k + 1) if j != k]
    wanted = F.least(F.lit(k).cast("long"), F.col("ny") - 1)
    centres = frame.select("segment", "ny", centre["x"].alias("x"), centre["n"].alias("n"), _radius(centre["n"], F.filter(F.array(*sides), lambda v: v.isNotNull()), wanted).alias("r"), wanted.alias("wanted"))
    m = _within(counts.groupBy("segment", "x").agg(F.sum("n").alias("n")), cut_lineage(centres))
    kth = F.when(F.col("r") == 0, F.col("n") - 1).otherwise(F.col("wanted"))
    gain = F.col("n") * (digamma(kth) - digamma(F.col("ny")) - digamma(F.col("m")))
    rows = m.groupBy("segment").agg(F.sum(gain).alias("g"), F.sum("n").alias("n")).select("segment", (digamma(F.col("n")) + F.col("g") / F.col("n")).alias("mi")).collect()  # one row a column
    found = {r["segment"]: r["mi"] for r in rows}
    return {c: max(0.0, found.get(i, 0.0)) for i, c in enumerate(cols)}


def number_information(df: DataFrame, cols: Sequence[str], target: str, k: int = NEIGHBOURS) -> dict[str, float]:
    """Mutual information (nats, at least 0) of each numeric column with a numeric target.

    The larger of two distances is the sum of the distances along both diagonals, so the neighbour join runs on these. Rows
    without the value or the target take no part; with k rows or fewer, or a constant column, it is 0.
    """
    out = {}
    for c in cols:
        both = df.select(num(df, c).alias("x"), num(df, target).alias("y")).where("abs(x) < double('Infinity') AND abs(y) < double('Infinity')")
        n, sx, sy = agg_row(both, [F.count("*"), F.stddev_pop("x"), F.stddev_pop("y")])
        if n <= k or not sx or not sy or math.isinf(sx) or math.isinf(sy):
            out[c] = 0.0
            continue
        scaled = both.select((F.col("x") / F.lit(sx) + F.lit(0.0)).alias("x"), (F.col("y") / F.lit(sy) + F.lit(0.0)).alias("y"))
        points = cut_lineage(scaled.groupBy("x", "y").agg(F.count("*").alias("n"))
                             .withColumn("u", (F.col("x") + F.col("y")) / 2).withColumn("w", (F.col("x") - F.col("y")) / 2))
        pairs = knn_join(points, points, ["u", "w"], k, ["x", "y"], ["x", "y"], metric="manhattan", exclude_self=True, carry=["n"])
        gap = F.greatest(F.abs(F.col("l_x") - F.col("r_x")), F.abs(F.col("l_y") - F.col("r_y")))
        near = pairs.groupBy(F.col("l_x").alias("x"), F.col("l_y").alias("y")).agg(F.collect_list(F.struct(gap.alias("d"), F.col("r_n").alias("n"))).alias("near"))  # k a point
        none = F.array().cast("array<struct<d:double,n:bigint>>")
        radius = _radius(F.col("n"), F.coalesce("near", none), F.lit(k))
        centres = cut_lineage(points.join(near, ["x", "y"], "left").select("x", "y", "n", radius.alias("r")))
        marked = [centres.select(F.lit(i).alias("segment"), F.col(v).alias("x"), "n", "r") for i, v in enumerate("xy")]
        stacked = marked[0].unionByName(marked[1])
        m = _within(stacked.groupBy("segment", "x").agg(F.sum("n").alias("n")), stacked)
        kth = F.when(F.col("r") == 0, F.col("n") - 1).otherwise(F.lit(k))
        mean = F.sum(F.col("n") * (F.when(F.col("segment") == 0, digamma(kth)).otherwise(F.lit(0.0)) - digamma(F.col("m")))) / F.lit(float(n))
        out[c] = max(0.0, agg_row(m, [mean + digamma(F.lit(n))])[0])
    return out
