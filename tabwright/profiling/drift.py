"""Drift between a reference and a current table."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..core import agg_row, dtype_of, is_numeric, nn, num
from ..plans.ordered import segmented_totals
from ..plans.quantiles import column_quantiles, long_form, weighted_ranks
from ..session import cut_lineage
from ..stats import ks_tail

METRICS_SCHEMA = "column string, metric string, value double, has_drift boolean, threshold double"


def _both(ref: DataFrame, cur: DataFrame, cols: list[str], text: bool = False) -> DataFrame:
    """(i, v, r, c): every value of every column of both tables, in long form."""
    def side(d, r, c):
        values = [nn(d, x).cast("string") if text else num(d, x) for x in cols]
        return long_form(d, values).where("v IS NOT NULL").select("i", "v", F.lit(r).alias("r"), F.lit(c).alias("c"))
    return side(ref, 1, 0).unionByName(side(cur, 0, 1))


def numeric_distances(ref: DataFrame, cur: DataFrame, cols: list[str], bins: int = 10) -> dict[str, dict]:
    """For each column: rows on both sides (nr, nc), KS statistic d, Wasserstein distance w, and the reference's
    percentile edges.

    Values of all columns and both tables are counted together; running totals of the counts within a
    column are both distribution functions, and the reference's ranks. The distance is summed by parts, so
    a row needs its own totals only. The number of jobs does not depend on the columns.
    """
    long = _both(ref, cur, cols)
    sizes = cut_lineage(long.groupBy("i").agg(F.count("*").alias("__n"), F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.avg("v").alias("centre")))
    counts = long.groupBy("i", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    run = segmented_totals(counts, ["i"], "v", ["r", "c"], sizes=sizes)
    run = run.join(F.broadcast(sizes.drop("__n")), "i").where("nr > 0")  # a row for each column
    gap = lambda r, c: F.abs(r / F.col("nr") - c / F.greatest(F.col("nc"), F.lit(1)))
    now, before = gap(F.col("cum_r"), F.col("cum_c")), gap(F.col("cum_r") - F.col("r"), F.col("cum_c") - F.col("c"))
    place = lambda r: (F.col("cum_r") - F.col("r") <= r) & (r < F.col("cum_r"))
    edges = []
    for k in range(bins + 1):
        (low, w0), (high, w1) = weighted_ranks(F.col("nr"), k / bins, "linear")
        edges.append(F.sum(F.when(place(low), F.col("v") * w0)) + F.coalesce(F.sum(F.when(place(high) & (w1 > 0), F.col("v") * w1)), F.lit(0.0)))
    got = run.groupBy("i").agg(F.first("nr").alias("nr"), F.first("nc").alias("nc"), F.max(now).alias("d"), F.sum((F.col("v") - F.col("centre")) * (before - now)).alias("w"), F.array(*edges).alias("edges")).collect()
    return {cols[r["i"]]: r.asDict() for r in got}


def bin_counts(df: DataFrame, edges: dict[str, list[float]], closed: str = "left") -> dict[str, list[int]]:
    """Clipped histograms of all columns in one aggregation; a value on an edge belongs to the bin that begins
    (closed left) or ends (closed right) with it."""
    names = list(edges)
    if not names:
        return {}
    table = df.sparkSession.createDataFrame([(i, [float(e) for e in edges[c][1:-1]]) for i, c in enumerate(names)], "i int, inner array<double>")
    long = long_form(df, [num(df, c) for c in names]).where("v IS NOT NULL").join(F.broadcast(table), "i")  # a row for each column
    at = F.size(F.filter("inner", (lambda e: e <= F.col("v")) if closed == "left" else (lambda e: e < F.col("v"))))
    out = {c: [0] * (len(e) - 1) for c, e in edges.items()}
    for r in long.groupBy("i", at.alias("b")).agg(F.count("*").alias("n")).collect():  # a row for each bin
        out[names[r["i"]]][r["b"]] = int(r["n"])
    return out


def binned_shares(ref: DataFrame, cur: DataFrame, cols: list[str], bins: int = 10, edges: dict[str, list[float]] | None = None
                  ) -> dict[str, tuple[list[float], list[float]] | None]:
    """Shares per reference-percentile bin on both sides; None for a constant reference."""
    if edges is None:
        edges = {c: v for c, v in column_quantiles(ref, cols, [i / bins for i in range(bins + 1)]).items() if v[0] is not None}
    edges = {c: sorted(set(v)) for c, v in edges.items()}
    live = {c: e for c, e in edges.items() if len(e) >= 2}
    a, b = bin_counts(ref, live), bin_counts(cur, live)

    def shares(counts):
        n = sum(counts)
        return [(v / n if v else V.DRIFT_ZERO_SHARE) for v in counts] if n else None
    out = {}
    for c in cols:
        r, k = (shares(a[c]), shares(b[c])) if c in live else (None, None)
        out[c] = (r, k) if r and k else None
    return out


def psi(expected: list[float], actual: list[float]) -> float:
    return sum((a - e) * math.log(a / e) for e, a in zip(expected, actual))


def kl(reference: list[float], current: list[float]) -> float:
    """KL(current || reference) after normalising both."""
    rs, cs = sum(reference), sum(current)
    return sum((c / cs) * math.log((c / cs) / (r / rs)) for r, c in zip(reference, current))


def distribution_distance(ref: DataFrame, cur: DataFrame, column: str) -> tuple[float, float, int, int]:
    """(KS statistic, Wasserstein distance, n_ref, n_cur)."""
    g = numeric_distances(ref, cur, [column]).get(column)
    if g is None or not g["nc"]:
        x, y = (int(d.agg(F.count(num(d, column))).first()[0]) for d in (ref, cur))
        return math.nan, math.nan, x, y
    return g["d"], max(0.0, g["w"]), int(g["nr"]), int(g["nc"])


def categorical_psis(ref: DataFrame, cur: DataFrame, columns: list[str], max_categories: int | None = None) -> dict[str, float | None]:
    """PSI of each column over all its categories; None for fewer than two, or for more in the reference than ``max_categories``
    if a caller sets it."""
    if not columns:
        return {}
    counts = cut_lineage(_both(ref, cur, columns, text=True).groupBy("i", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c")))
    sizes = counts.groupBy("i").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count_if(F.col("r") > 0).alias("kinds"), F.count("*").alias("cats"))
    share = lambda x, n: F.when(F.col(x) > 0, F.col(x) / F.col(n)).otherwise(F.lit(0.5) / F.col(n))
    e, a = share("r", "nr"), share("c", "nc")
    rows = counts.join(F.broadcast(sizes.where("nr > 0 AND nc > 0 AND cats >= 2")), "i").groupBy("i", "kinds").agg(F.sum((a - e) * F.log(a / e)).alias("psi")).collect()
    got = {columns[r["i"]]: r["psi"] for r in rows if max_categories is None or r["kinds"] <= max_categories}
    return {c: got.get(c) for c in columns}


def categorical_psi(ref: DataFrame, cur: DataFrame, column: str, max_categories: int | None = None) -> float | None:
    return categorical_psis(ref, cur, [column], max_categories)[column]


def paired_histogram(ref: DataFrame, cur: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, start, end, reference_count, current_count) over the joint range."""
    from .aggregates import _edge_bin
    lo1, hi1 = ref.agg(F.min(num(ref, column)), F.max(num(ref, column))).first()
    lo2, hi2 = cur.agg(F.min(num(cur, column)), F.max(num(cur, column))).first()
    spark = ref.sparkSession
    schema = "bin int, start double, end double, reference_count long, current_count long"
    if lo1 is None or lo2 is None:
        return spark.createDataFrame([], schema)
    lo, hi = min(lo1, lo2), max(hi1, hi2)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    edges = [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]
    frame = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, start double, end double")

    def counts(d, name):
        return d.groupBy(_edge_bin(num(d, column), edges, "left").alias("bin")).agg(F.count("*").alias(name)).where("bin is not null")
    return (frame.join(F.broadcast(counts(ref, "r")), "bin", "left").join(F.broadcast(counts(cur, "c")), "bin", "left")
            .select("bin", "start", "end", F.coalesce("r", F.lit(0)).cast("bigint").alias("reference_count"),
                    F.coalesce("c", F.lit(0)).cast("bigint").alias("current_count")))


@dataclass
class DriftReport:
    metrics: DataFrame
    reference_rows: int
    current_rows: int
    missing_columns: list[str]
    new_columns: list[str]
    suggestions: dict[str, list[str]] = field(default_factory=dict)

    @property
    def drifted_columns(self) -> list[str]:
        return sorted({r["column"] for r in self.metrics.where("has_drift").collect()})


def _advice(m: dict[str, tuple[float, bool]], categorical: bool) -> list[str]:
    out = []
    if categorical:
        v, hit = m["psi_categorical"]
        if hit:
            out.append("Categories shifted strongly; retraining is advised." if v > 0.25
                       else "Categories shifted moderately; watch model performance.")
        return out
    if not any(h for _, h in m.values()):
        return out
    p = m["psi"][0]
    if p > 0.25:
        out.append("Population shifted strongly (PSI above 0.25); retraining is advised.")
    elif p > 0.1:
        out.append("Population shifted moderately; watch model performance.")
    if m["ks_test_p_value"][1] and not m["psi"][1]:
        out.append("Distribution changed while the population is stable; look for outliers.")
    if m["wasserstein_distance"][1]:
        out.append("Scale or shape changed; check earlier processing steps.")
    return out


def drift_report(ref: DataFrame, cur: DataFrame, thresholds: dict | None = None,
                 columns: list[str] | None = None) -> DriftReport:
    """All drift metrics of the shared columns, one row per (column, metric). The number of jobs does not depend on the columns."""
    t = {**V.DRIFT_THRESHOLDS, **(thresholds or {})}
    shared = [c for c in (columns or ref.columns) if c in ref.columns and c in cur.columns]
    nums = [c for c in shared if is_numeric(ref, c)]
    cats = [c for c in shared if isinstance(dtype_of(ref, c), (T.StringType, T.BooleanType))]
    n_ref, *stds = agg_row(ref, [F.count("*")] + [F.stddev_pop(num(ref, c)) for c in nums])
    found = numeric_distances(ref, cur, nums) if nums else {}
    found = {c: g for c, g in found.items() if g["nr"] and g["nc"]}
    shares = binned_shares(ref, cur, list(found), edges={c: g["edges"] for c, g in found.items()})
    rows, advice = [], {}
    for c in (c for c in nums if c in found):
        d, w, nr, nc = found[c]["d"], max(0.0, found[c]["w"]), found[c]["nr"], found[c]["nc"]
        std = stds[nums.index(c)]
        p = ks_tail(d, nr * nc / (nr + nc))
        s = shares[c]
        got = {
            "wasserstein_distance": (w, (w / std if std and std > 0 else w) > t["wasserstein"], t["wasserstein"]),
            "ks_test_p_value": (p, p < t["ks"], t["ks"]),
            "psi": (psi(*s) if s else 0.0, (psi(*s) if s else 0.0) > t["psi"], t["psi"]),
            "kl_divergence": (kl(*s) if s else 0.0, (kl(*s) if s else 0.0) > t["kl_divergence"], t["kl_divergence"]),
        }
        rows += [(c, k, float(v), bool(h), float(x)) for k, (v, h, x) in got.items()]
        advice[c] = _advice({k: (v, h) for k, (v, h, _) in got.items()}, False)
    for c, v in categorical_psis(ref, cur, cats).items():
        if v is not None:
            rows.append((c, "psi_categorical", float(v), v > t["psi"], float(t["psi"])))
            advice[c] = _advice({"psi_categorical": (v, v > t["psi"])}, True)
    return DriftReport(ref.sparkSession.createDataFrame(rows, METRICS_SCHEMA), int(n_ref), cur.count(),
                       [c for c in ref.columns if c not in cur.columns],
                       [c for c in cur.columns if c not in ref.columns], advice)
