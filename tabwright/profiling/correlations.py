"""Correlation matrices, partial correlations and related one-pass statistics."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..core import agg_row, nn, num, numeric_candidates, q
from ..session import cut_lineage
from ..stats import f_tail, normal_two_sided

PAIRWISE_COLUMNS = 30


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def pearson_matrix(df: DataFrame, cols: Sequence[str], complete_rows: bool = False) -> np.ndarray:
    """Correlations in one pass. Pairwise-complete unless ``complete_rows``."""
    base = df.select(*[finite(num(df, c)).alias(f"x{i}") for i, c in enumerate(cols)])
    if complete_rows:
        base = base.na.drop()
    p = len(cols)
    m = np.eye(p)
    if p <= PAIRWISE_COLUMNS:
        pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
        vals = agg_row(base, [F.corr(f"x{i}", f"x{j}") for i, j in pairs]) if pairs else []
        for (i, j), v in zip(pairs, vals):
            m[i, j] = m[j, i] = math.nan if v is None else v
        return m
    return _gram_correlation(base, p)


def _gram_correlation(base: DataFrame, p: int) -> np.ndarray:
    """Many columns: masked cross products per partition, summed by row of the matrix."""
    shift = np.array([v or 0.0 for v in agg_row(base, [F.avg(c) for c in base.columns])])
    names = base.columns

    def partial(batches):
        n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
        for pdf in batches:
            x = pdf[names].to_numpy(dtype="float64") - shift
            ok = ~np.isnan(x)
            x = np.where(ok, x, 0.0)
            k = ok.astype("float64")
            n += k.T @ k
            sx += x.T @ k
            sxx += (x * x).T @ k
            sxy += x.T @ x
        for i in range(p):
            yield pd.DataFrame({"i": np.full(p, i), "j": np.arange(p), "n": n[i], "sx": sx[i],
                                "sxx": sxx[i], "sy": sx[:, i], "syy": sxx[:, i], "sxy": sxy[i]})
    sums = base.mapInPandas(partial, "i int, j int, n double, sx double, sxx double, sy double, syy double, sxy double")
    rows = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sy", "syy", "sxy")]).collect()
    m = np.full((p, p), np.nan)
    for r in rows:
        if r["n"] > 1:
            vx = r["sxx"] - r["sx"] ** 2 / r["n"]
            vy = r["syy"] - r["sy"] ** 2 / r["n"]
            if vx > 0 and vy > 0:
                m[r["i"], r["j"]] = (r["sxy"] - r["sx"] * r["sy"] / r["n"]) / math.sqrt(vx * vy)
    np.fill_diagonal(m, 1.0)
    return m


def average_ranks(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, rank) with ties averaged, from counts per distinct value."""
    from ..plans.ordered import running_totals
    n = F.count("*") if weight is None else F.sum(weight)
    d = df.where(q(value).isNotNull()).groupBy(q(value)).agg(n.cast("double").alias("n"))
    return running_totals(d, value, ["n"]).select(
        q(value), (F.col("cum_n") - (F.col("n") - 1.0) / 2.0).alias("rank"))


def spearman_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson of average ranks, pairwise-complete rows.

    Rank tables are joined back by value, broadcast while they are small. Columns without missing
    values share one rank table; a pair with gaps is ranked on its own complete rows.
    """
    from ..plans.lookup import size_checked_join
    p = len(cols)
    base = df.select(*[finite(num(df, c)).alias(f"x{i}") for i, c in enumerate(cols)])
    have = agg_row(base, [F.count("*")] + [F.count(c) for c in base.columns])
    full = [i for i in range(p) if have[i + 1] == have[0]]
    m = np.eye(p)
    ranked = base.select(*[q(f"x{i}") for i in full]) if full else None
    for i in full:
        t = average_ranks(base, f"x{i}").withColumnRenamed("rank", f"r{i}")
        ranked = size_checked_join(ranked, t, f"x{i}", "left")
    pairs = [(a, b) for k, a in enumerate(full) for b in full[k + 1:]]
    if pairs:
        vals = agg_row(ranked, [F.corr(f"r{i}", f"r{j}") for i, j in pairs])
        for (i, j), v in zip(pairs, vals):
            m[i, j] = m[j, i] = math.nan if v is None else v
    for i in range(p):
        for j in range(i + 1, p):
            if i in full and j in full:
                continue
            c = (base.where(q(f"x{i}").isNotNull() & q(f"x{j}").isNotNull())
                 .groupBy(q(f"x{i}").alias("x"), q(f"x{j}").alias("y")).agg(F.count("*").alias("w")))
            rx = average_ranks(c, "x", "w").withColumnRenamed("rank", "rx")
            ry = average_ranks(c, "y", "w").withColumnRenamed("rank", "ry")
            t = size_checked_join(size_checked_join(c, rx, "x"), ry, "y")
            m[i, j] = m[j, i] = weighted_corr(t, "rx", "ry", "w")
    return m


def weighted_corr(t: DataFrame, x: str, y: str, w: str) -> float:
    n, mx, my = t.agg(F.sum(w), F.sum(q(x) * q(w)) / F.sum(w), F.sum(q(y) * q(w)) / F.sum(w)).first()
    if not n:
        return math.nan
    dx, dy = q(x) - F.lit(mx), q(y) - F.lit(my)
    sxy, sxx, syy = t.agg(F.sum(dx * dy * q(w)), F.sum(dx * dx * q(w)), F.sum(dy * dy * q(w))).first()
    return sxy / math.sqrt(sxx * syy) if sxx > 0 and syy > 0 else math.nan


# --- Kendall ---------------------------------------------------------------------------------

def signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of sign(dx) * sign(dy) * w * w over all pairs, by merging sorted halves."""
    order = np.lexsort((y, x))
    x, y, w = x[order], np.unique(y[order], return_inverse=True)[1], w[order].astype("float64")
    n, total = len(x), 0.0
    pos = np.arange(n)
    size = 1
    while size < n:
        block = pos // (2 * size)
        left = (pos // size) % 2 == 0
        o = np.lexsort((y, block))
        b, yy, ll, ww = block[o], y[o], left[o], w[o]
        lw = np.where(ll, ww, 0.0)
        cum = np.cumsum(lw)
        start_b = np.r_[True, b[1:] != b[:-1]]
        base = np.maximum.accumulate(np.where(start_b, np.arange(n), 0))
        before_block = cum[base] - lw[base]
        start_y = start_b | np.r_[True, yy[1:] != yy[:-1]]
        first = np.maximum.accumulate(np.where(start_y, np.arange(n), 0))
        less = cum[first] - lw[first] - before_block
        last_idx = np.r_[np.nonzero(start_y)[0][1:] - 1, n - 1][np.cumsum(start_y) - 1]
        upto = cum[last_idx] - before_block
        end_b = np.r_[np.nonzero(start_b)[0][1:] - 1, n - 1][np.cumsum(start_b) - 1]
        all_left = cum[end_b] - before_block
        total += float(np.sum(np.where(ll, 0.0, ww * (less - (all_left - upto)))))
        size *= 2
    # pairs with equal x were counted as rising in y: take them out
    gx = np.r_[True, x[1:] != x[:-1]].cumsum() - 1
    wg = np.bincount(gx, w)
    key = gx.astype("int64") * (int(y.max()) + 1 if n else 1) + y
    _, inv = np.unique(key, return_inverse=True)
    wk = np.bincount(inv, w)
    gk = np.zeros(len(wk), dtype=int)
    gk[inv] = gx
    ties = (wg ** 2 - np.bincount(gk, wk ** 2)) / 2.0
    return total - float(ties.sum())


#: even ranges of a column at most, so that the grid of range counts is small; digits of a rank that are compared at once
KENDALL_RANGES, DIGITS = 990, 4


def signed_pairs_by_digits(cells: DataFrame, hot_rows: int) -> float:
    """Rising less falling weighted pairs of cells (x, y, w), for any number of cells.

    Two different ranks of y first differ in one of their digits. Cells whose ranks agree in all digits above form a
    segment; running totals by x within the segments, one for each value of the digit, count for every cell the
    cells of smaller x whose digit is smaller or larger. A level for each digit, every one a segmented running total, so no group has to fit a task.
    """
    from ..plans.ordered import running_totals, segmented_totals
    ranks = running_totals(cells.groupBy("y").agg(F.lit(1.0).alias("k")), "y", ["k"]).select("y", (F.col("cum_k") - 1).cast("long").alias("r"))
    rows = cut_lineage(cells.join(ranks, "y").select("x", "r", "w"))
    top = (rows.agg(F.max("r")).first()[0] or 0)
    total, base = 0.0, 1 << DIGITS
    for shift in range(0, max(1, top.bit_length()), DIGITS):
        digit = F.shiftright("r", shift).bitwiseAND(base - 1)
        names = [f"n{d}" for d in range(base)]
        table = rows.groupBy(F.shiftright("r", shift + DIGITS).alias("prefix"), "x").agg(*[F.sum(F.when(digit == d, F.col("w")).otherwise(0.0)).alias(a) for d, a in enumerate(names)])
        run = segmented_totals(table, ["prefix"], "x", names, hot_rows)
        before = {a: F.col(f"cum_{a}") - F.col(a) for a in names}
        every = sum(before.values(), F.lit(0.0))
        gain, smaller = F.lit(0.0), F.lit(0.0)
        for a in names:
            gain = gain + F.col(a) * (2 * smaller + before[a] - F.col("every"))
            smaller = smaller + before[a]
        total += run.withColumn("every", every).agg(F.sum(gain)).first()[0] or 0.0
    return total


def kendall_tau(df: DataFrame, x: Column, y: Column, rows_per_bucket: int = 1_000_000) -> float:
    """Kendall's tau-b on all rows, without a pair table.

    Beyond KENDALL_RANGES full ranges pairs are counted digit by digit. Up to there both columns are cut into ranges. Pairs whose ranges differ in both columns are settled by the
    small grid of range counts; the others meet inside one x range or one y range, each a bounded
    task. A value that fills a range alone needs no task: its pairs are ties.
    """
    from ..plans.ordered import add_bucket, range_bounds
    c = (df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).na.drop()
         .groupBy("x", "y").agg(F.count("*").cast("double").alias("w")))
    n_cells, n = c.agg(F.count("*"), F.sum("w")).first()
    if not n_cells or n < 2:
        return math.nan

    def ties(col):
        g = c.groupBy(col).agg(F.sum("w").alias("w"))
        return g.agg(F.sum(F.col("w") * (F.col("w") - 1.0)) / 2.0).first()[0]

    def bounds(col):
        b = range_bounds(c, col, rows_per_bucket, n_cells)
        return sorted({v for e in b for v in (e, math.nextafter(e, math.inf))})
    pairs = n * (n - 1) / 2.0
    den = math.sqrt((pairs - ties("x")) * (pairs - ties("y")))
    if n_cells > KENDALL_RANGES * rows_per_bucket:
        return signed_pairs_by_digits(c, rows_per_bucket) / den if den > 0 else math.nan
    t = c
    for col in ("x", "y"):
        t = add_bucket(t, col, bounds(col), f"b{col}")
    grid = t.groupBy("bx", "by").agg(F.sum("w").alias("w")).collect()
    gx = sorted({r["bx"] for r in grid})
    gy = sorted({r["by"] for r in grid})
    g = np.zeros((len(gx), len(gy)))
    for r in grid:
        g[gx.index(r["bx"]), gy.index(r["by"])] = r["w"]
    cum = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cum[1:, 1:] = g.cumsum(0).cumsum(1)
    up = cum[:-1, :-1]                                     # earlier x range, lower y range
    down = cum[:-1, -1][:, None] - cum[:-1, 1:]            # earlier x range, higher y range
    s = float(np.sum(g * (up - down)))

    def local(key, other):
        wide = t.groupBy(key).agg((F.min(key[1:]) < F.max(key[1:])).alias("wide")).where("wide").select(key)
        part = t.join(F.broadcast(wide), key)              # at most 1999 ranges

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            tot = signed_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
            if other:
                for _, cell in pdf.groupby(other):
                    tot -= signed_pairs(cell["x"].to_numpy(), cell["y"].to_numpy(), cell["w"].to_numpy())
            return pd.DataFrame({"s": [tot]})
        return part.groupBy(key).applyInPandas(count, "s double").agg(F.sum("s")).first()[0] or 0.0
    s += local("bx", None) + local("by", "bx")
    return s / den if den > 0 else math.nan


def kendall_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    p = len(cols)
    m = np.eye(p)
    for i in range(p):
        for j in range(i + 1, p):
            m[i, j] = m[j, i] = kendall_tau(df, finite(num(df, cols[i])), finite(num(df, cols[j])))
    return m


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> np.ndarray:
    fn = {"pearson": pearson_matrix, "spearman": spearman_matrix, "kendall": kendall_matrix}[method]
    return fn(df, cols)


def profile_correlations(df: DataFrame, cols: Sequence[str] | None = None, max_columns: int | None = None) -> DataFrame:
    """(column_a, column_b, r) over complete rows; near-constant columns left out, undefined as 0."""
    cols = list(cols or numeric_candidates(df))[:max_columns]
    std = agg_row(df, [F.stddev_samp(num(df, c)) for c in cols]) if cols else []
    cols = [c for c, s in zip(cols, std) if s is not None and s > 1e-9]
    m = pearson_matrix(df, cols, complete_rows=True)
    rows = [(a, b, float(m[i, j]) if math.isfinite(m[i, j]) else 0.0)
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, r double")


def vif(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Variance inflation: diagonal of the inverse correlation matrix, at least 1."""
    base = df.select(*[num(df, c).alias(c) for c in cols]).na.drop()
    n = base.count()
    if len(cols) < 2 or n < len(cols) + 5:
        return {}
    m = pearson_matrix(base, cols)
    m = np.where(np.isfinite(m), m, 0.0)
    try:
        d = np.diag(np.linalg.inv(m))
    except np.linalg.LinAlgError:
        return {c: 999.0 for c in cols}
    return {c: float(max(1.0, v)) if math.isfinite(v) else 999.0 for c, v in zip(cols, d)}


def target_correlations(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or numeric_candidates(df)) if c != target]
    vals = agg_row(df, [F.corr(num(df, c), num(df, target)) for c in cols]) if cols else []
    rows = [(c, float(v)) for c, v in zip(cols, vals) if v is not None and math.isfinite(v)]
    rows.sort(key=lambda r: (-abs(r[1]), r[0]))
    return df.sparkSession.createDataFrame(rows, "column string, r double")


def class_moments(df: DataFrame, target: str, cols: Sequence[str], limit: int = 1000) -> list:
    """Per class and column: count, sum and sum of squares around the column mean."""
    mean = agg_row(df, [F.avg(num(df, c)) for c in cols])
    aggs = []
    for i, c in enumerate(cols):
        d = num(df, c) - F.lit(mean[i] or 0.0)
        aggs += [F.count(d).alias(f"n{i}"), F.sum(d).alias(f"s{i}"), F.sum(d * d).alias(f"q{i}")]
    rows = (df.where(nn(df, target).isNotNull()).groupBy(nn(df, target).cast("string").alias("y"))
            .agg(*aggs).limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"more than {limit} classes in {target!r}")
    return rows


def anova(df: DataFrame, target: str, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """One-way F and p per column over the target's groups."""
    rows, out = class_moments(df, target, cols), {}
    for i, c in enumerate(cols):
        g = [(r[f"n{i}"], r[f"s{i}"], r[f"q{i}"]) for r in rows if r[f"n{i}"]]
        n, k = sum(v[0] for v in g), len(g)
        if k < 2 or n <= k:
            out[c] = (math.nan, math.nan)
            continue
        total = sum(v[1] for v in g)
        between = sum(s * s / m for m, s, _ in g) - total * total / n
        within = sum(sq for _, _, sq in g) - sum(s * s / m for m, s, _ in g)
        f = (between / (k - 1)) / (within / (n - k)) if within > 0 else math.inf
        out[c] = (f, 0.0 if f == math.inf else f_tail(f, k - 1, n - k))
    return out


def correlation_ratio(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """eta = sqrt(between / total sum of squares) of numeric columns over target classes."""
    rows, out = class_moments(df, target, cols), []
    for i, c in enumerate(cols):
        g = [(r[f"n{i}"], r[f"s{i}"], r[f"q{i}"]) for r in rows if r[f"n{i}"]]
        n = sum(v[0] for v in g)
        if not n:
            continue
        base = sum(v[1] for v in g) ** 2 / n
        total = sum(v[2] for v in g) - base
        between = sum(s * s / m for m, s, _ in g) - base
        out.append((c, math.sqrt(max(0.0, between / total)) if total > 0 else 0.0))
    return df.sparkSession.createDataFrame(out, "column string, eta double")


def partial_correlation_edges(df: DataFrame, cols: Sequence[str] | None = None, target: str | None = None,
                              alpha: float = 0.05, max_columns: int | None = None) -> DataFrame:
    """Undirected edges between columns whose partial correlation given all others is not zero."""
    cols = list(cols or numeric_candidates(df))
    if max_columns is not None and len(cols) > max_columns:
        score = agg_row(df, [F.abs(F.corr(num(df, c), num(df, target))) if target else F.var_pop(num(df, c))
                             for c in cols])
        cols = [c for _, c in sorted(zip([-(s or 0.0) for s in score], cols))[:max_columns]]
    base = df.select(*[num(df, c).alias(c) for c in cols]).na.drop()
    n = base.count()
    prec = np.linalg.pinv(pearson_matrix(base, cols))
    rows = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            r = -prec[i, j] / math.sqrt(prec[i, i] * prec[j, j])
            dof = n - (len(cols) - 2) - 3
            if dof <= 0:
                continue
            r = max(-0.999999999, min(0.999999999, r))
            pv = normal_two_sided(math.atanh(r) * math.sqrt(dof))
            if pv < alpha:
                rows.append((cols[i], cols[j], float(r), float(pv)))
    return df.sparkSession.createDataFrame(rows, "source string, target string, partial_r double, p_value double")
