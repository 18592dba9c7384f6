"""Exact quantiles that never gather a column in one task.

Spark's ``percentile`` merges a value-to-count map of the whole column on one reducer. Here one
sketch brackets every wanted rank, one grouped count keeps apart only the values inside the
brackets, and the brackets are narrowed again while more than a bounded number of rows is left.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core import agg_row, num, q
from ..session import cut_lineage

ACCURACY = 10_000
CANDIDATE_LIMIT = 200_000
HOT_GROUP_ROWS = 2_000_000


def rank_weights(n: int, p: float, method: str = "linear") -> list[tuple[int, float]]:
    """Zero-based ranks and weights whose weighted sum is the quantile of n sorted values."""
    last = n - 1
    if method == "linear":
        h = p * last
        lo = int(math.floor(h))
        if h == lo:
            return [(lo, 1.0)]
        return [(lo, 1.0 - (h - lo)), (min(lo + 1, last), h - lo)]
    if method == "nearest":
        return [(min(last, int(math.floor(p * last + 0.5))), 1.0)]
    if method == "half_even":
        return [(max(0, min(last, int(round(p * last)))), 1.0)]
    h = n * p
    top = max(0, min(last, int(math.ceil(h - 1e-9)) - 1))
    if method == "inverted_cdf":
        return [(top, 1.0)]
    if method == "averaged_inverted_cdf":
        k = int(round(h))
        return [(k - 1, 0.5), (k, 0.5)] if abs(h - k) < 1e-9 and 0 < k < n else [(top, 1.0)]
    raise ValueError(f"unknown quantile method {method!r}")


def order_statistics(df: DataFrame, exprs: Sequence[Column], shares: Sequence[Sequence[float]],
                     ranks: Callable[[int, int], list[int]], limit: int = CANDIDATE_LIMIT
                     ) -> tuple[list[int], list[dict[int, float]]]:
    """Values at exact ranks of several expressions at once.

    ``ranks(i, n)`` are zero-based ranks of expression i, each within two of ``share * n`` for
    some given share. Returns the counts of non-null values and rank -> value per expression.
    """
    names = [f"x{i}" for i in range(len(exprs))]
    base = df.select(*[e.cast("double").alias(n) for e, n in zip(exprs, names)])
    pad = 4.0 / ACCURACY
    head = []
    for name, ps in zip(names, shares):
        probs = [v for p in ps for v in (max(0.0, p - pad), min(1.0, p + pad))]
        head += [F.count(q(name)), F.percentile_approx(q(name), probs, ACCURACY)]
    row = agg_row(base, head)
    counts = [int(v) for v in row[0::2]]
    wanted = [sorted(set(ranks(i, n))) if n else [] for i, n in enumerate(counts)]
    found: list[dict[int, float]] = [{} for _ in names]
    share_limit = max(1, limit // max(1, len(names)))
    brackets: list[list[list[float]]] = []
    for i, n in enumerate(counts):
        if not wanted[i]:
            brackets.append([])
        elif n <= share_limit:
            brackets.append([[-math.inf, math.inf]])
        else:
            ladder = row[2 * i + 1]
            brackets.append(_merge([
                [-math.inf if p - pad <= 0 else ladder[2 * j],
                 math.inf if p + pad >= 1 else ladder[2 * j + 1]]
                for j, p in enumerate(shares[i])]))
    while True:
        kept = _segment_counts(base, names, brackets).limit(limit + 1).collect()
        if len(kept) <= limit:
            _resolve(kept, wanted, found)
            return counts, found
        narrower = _narrow(base, names, brackets, wanted)
        if narrower == brackets:
            raise RuntimeError("quantile brackets did not narrow; raise the candidate limit")
        brackets = narrower


def _merge(intervals):
    merged: list[list[float]] = []
    for a, b in sorted(intervals):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _long(base, names, brackets) -> DataFrame:
    """(i, seg, v): seg 2k is the gap before bracket k, 2k+1 its inside."""
    items = []
    for i, iv in enumerate(brackets):
        if not iv:
            continue
        x = q(names[i])
        seg = F.lit(2 * len(iv))
        for k in range(len(iv) - 1, -1, -1):
            a, b = iv[k]
            seg = (F.when(x < F.lit(a), F.lit(2 * k))
                   .when(x <= F.lit(b), F.lit(2 * k + 1)).otherwise(seg))
        items.append(F.when(x.isNotNull(), F.struct(
            F.lit(i).alias("i"), seg.alias("seg"), x.alias("v"))))
    if not items:
        items = [F.lit(None).cast("struct<i:int,seg:int,v:double>")]
    return base.select(F.explode(F.array(*items)).alias("t")).where("t is not null").select("t.*")


def _segment_counts(base, names, brackets) -> DataFrame:
    inside = F.when(F.col("seg") % 2 == 1, F.col("v"))
    return (_long(base, names, brackets).groupBy("i", "seg", inside.alias("v"))
            .agg(F.count("*").alias("n")))


def _resolve(rows, wanted, found) -> None:
    per: dict[int, list] = {}
    for r in rows:
        per.setdefault(r["i"], []).append((r["seg"], 0.0 if r["v"] is None else r["v"], r["n"]))
    for i, segs in per.items():
        todo = iter(wanted[i])
        r = next(todo, None)
        seen = 0
        for seg, v, n in sorted(segs):
            while r is not None and r < seen + n:
                if seg % 2 == 0:
                    raise RuntimeError("a rank fell outside its bracket")
                found[i][r] = v
                r = next(todo, None)
            seen += n


def _narrow(base, names, brackets, wanted):
    """Sketch again inside every bracket that still holds a wanted rank."""
    sizes = {(r["i"], r["seg"]): r["n"] for r in
             _long(base, names, brackets).groupBy("i", "seg").agg(F.count("*").alias("n")).collect()}
    exprs, shape = [], []
    for i, iv in enumerate(brackets):
        below = 0
        for seg in range(2 * len(iv) + 1):
            n = sizes.get((i, seg), 0)
            inside = [r for r in wanted[i] if below <= r < below + n]
            if seg % 2 == 1 and inside:
                a, b = iv[seg // 2]
                pad = 4.0 / ACCURACY + 2.0 / n
                probs = []
                for r in inside:
                    p = (r - below) / n
                    probs += [max(0.0, p - pad), min(1.0, p + pad)]
                x = q(names[i])
                exprs.append(F.percentile_approx(
                    F.when((x >= F.lit(a)) & (x <= F.lit(b)), x), probs, ACCURACY))
                shape.append((i, a, b, probs))
            below += n
    row = agg_row(base, exprs)
    out = [[] for _ in names]
    for (i, a, b, probs), vals in zip(shape, row):
        for j in range(0, len(probs), 2):
            out[i].append([a if probs[j] <= 0 else vals[j], b if probs[j + 1] >= 1 else vals[j + 1]])
    return [_merge(iv) for iv in out]


def quantiles_of(df: DataFrame, exprs: Sequence[Column], probs: Sequence[float],
                 method: str = "linear", limit: int = CANDIDATE_LIMIT
                 ) -> tuple[list[int], list[list[float | None]]]:
    """Exact quantiles of several expressions: (counts, one list of values per expression)."""
    def ranks(_i, n):
        return [r for p in probs for r, _ in rank_weights(n, p, method)]
    counts, found = order_statistics(df, exprs, [list(probs)] * len(exprs), ranks, limit)
    out = []
    for n, f in zip(counts, found):
        out.append([sum(w * f[r] for r, w in rank_weights(n, p, method)) if n else None
                    for p in probs])
    return counts, out


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     method: str = "linear") -> dict[str, list[float | None]]:
    if not columns:
        return {}
    _, vals = quantiles_of(df, [num(df, c) for c in columns], probs, method)
    return dict(zip(columns, vals))


def quantile_sets(df: DataFrame, columns: Sequence[str], wanted: Sequence[tuple[Sequence[float], str]]
                  ) -> list[dict[str, list[float | None]]]:
    """Exact quantiles of several columns for several (shares, method) requests in one search."""
    every = [p for probs, _ in wanted for p in probs]

    def ranks(_i, n):
        return [r for probs, method in wanted for p in probs for r, _ in rank_weights(n, p, method)]
    if not columns:
        return [{} for _ in wanted]
    counts, found = order_statistics(df, [num(df, c) for c in columns], [every] * len(columns), ranks)
    return [{c: [sum(w * f[r] for r, w in rank_weights(n, p, method)) if n else None for p in probs]
             for c, n, f in zip(columns, counts, found)} for probs, method in wanted]


def long_form(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """(i, v): a row for each expression and row."""
    items = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)])
    return df.select(F.explode(items).alias("t")).select("t.i", "t.v")


def grouped_quantiles(df: DataFrame, by: str, columns: Sequence[str], probs: Sequence[float],
                      hot_rows: int = HOT_GROUP_ROWS, method: str = "linear") -> DataFrame:
    """(by, <column>_q: array<double>) with exact quantiles per group.

    Values are counted within (group, column), running totals of these counts place every value at
    its ranks, and a quantile is the weighted sum of the values that hold its ranks: one plan for all
    groups, columns and shares. Groups above ``hot_rows`` rows are cut into slices of values.
    """
    from .lookup import size_checked_join
    from .ordered import segmented_totals
    items = F.array(*[F.struct(F.lit(i).alias("i"), num(df, c).alias("v")) for i, c in enumerate(columns)])
    long = df.select(q(by).alias("g"), F.explode(items).alias("t")).select("g", "t.i", "t.v")
    sizes = cut_lineage(long.groupBy("g", "i").agg(F.count("v").alias("__n")))
    counts = long.where("v IS NOT NULL").groupBy("g", "i", "v").agg(F.count("*").alias("n"))
    run = segmented_totals(counts, ["g", "i"], "v", ["n"], hot_rows, sizes)
    known = sizes.select(F.col("g").alias("__g"), F.col("i").alias("__i"), "__n")
    run = size_checked_join(run, known, run["g"].eqNullSafe(known["__g"]) & (run["i"] == known["__i"]), "inner")
    place = lambda r: (F.col("cum_n") - F.col("n") <= r) & (r < F.col("cum_n"))
    shares = [weighted_ranks(F.col("__n"), p, method) for p in probs]
    used = [(r, w) for pair in shares for r, w in pair]
    hit = F.lit(False)
    for r, w in used:
        hit = hit | (place(r) & (w > 0))
    values = [sum((F.sum(F.when(place(r) & (w > 0), F.col("v") * w)) if k == 0 else F.coalesce(F.sum(F.when(place(r) & (w > 0), F.col("v") * w)), F.lit(0.0)) for k, (r, w) in enumerate(pair)), F.lit(0.0)) for pair in shares]
    found = run.where(hit).groupBy("g", "i").agg(F.array(*values).alias("qs"))
    every = sizes.select(F.col("g").alias("__g"), F.col("i").alias("__i"))
    every = every.join(found, every["__g"].eqNullSafe(found["g"]) & (every["__i"] == found["i"]), "left")
    wide = [F.first(F.when(F.col("__i") == i, F.col("qs")), ignorenulls=True).alias(f"{c}_q") for i, c in enumerate(columns)]
    return every.groupBy(F.col("__g").alias(by)).agg(*wide)


def weighted_ranks(n: Column, p: float, method: str) -> list[tuple[Column, Column]]:
    """Zero-based ranks and weights of a quantile of n sorted values, as expressions."""
    last, one = n - 1, F.lit(1.0)
    h = F.lit(float(p)) * last
    if method == "linear":
        low = F.floor(h)
        return [(low, one - (h - low)), (low + 1, h - low)]
    if method == "nearest":
        return [(F.least(last, F.floor(h + 0.5)), one)]
    if method == "half_even":
        return [(F.least(last, F.greatest(F.lit(0), F.bround(h).cast("long"))), one)]
    raise ValueError(f"grouped quantiles do not offer {method!r}")
