"""Bucketing numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core import Operator, agg_row, choose_columns, detect_numeric, is_numeric, num, operator, q, with_columns
from ..plans.quantiles import column_quantiles


def equal_width_edges(lo: float, hi: float, n: int) -> list[float]:
    if lo == hi:
        pad = abs(lo) * 0.001 or 0.001
        lo, hi = lo - pad, hi + pad
    step = (hi - lo) / n
    return [lo + i * step for i in range(n)] + [hi]


def kmeans_edges(df: DataFrame, column: str, n: int, seed: int = 42) -> list[float]:
    """Midpoints between the centres of a one-column k-means, plus min and max."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    x = df.select(num(df, column).alias("x")).where("x is not null")
    lo, hi = agg_row(x, [F.min("x"), F.max("x")])
    vec = VectorAssembler(inputCols=["x"], outputCol="v").transform(x)
    centres = sorted(float(c[0]) for c in KMeans(k=n, featuresCol="v", seed=seed).fit(vec).clusterCenters())
    return [lo] + [(a + b) / 2 for a, b in zip(centres, centres[1:])] + [hi]


@operator("GeneralBinning", "CustomBinning", "Binning")
class GeneralBinning(Operator):
    description = "Bins by equal width, equal frequency, k-means, averaged quantiles or given edges"
    defaults = {"strategy": "equal_width", "n_bins": 5, "column_strategies": {}, "label_format": "ordinal",
                "output_suffix": "_binned", "drop_original": False, "missing_strategy": "keep",
                "missing_label": "Missing", "include_lowest": True, "precision": 3}

    def _plan(self, df, cfg):
        cols = [c for c in choose_columns(df, cfg, detect_numeric) if is_numeric(df, c)]
        out = []
        for c in cols:
            o = (cfg.get("column_strategies") or {}).get(c, {})
            s = o.get("strategy", cfg["strategy"])
            n = int(o.get("n_bins", cfg["n_bins"]))
            if s == "equal_width":
                n = int(o.get("equal_width_bins", n))
            elif s == "equal_frequency":
                n = int(o.get("equal_frequency_bins", cfg.get("q_bins", n)))
            elif s == "kbins":
                n = int(o.get("kbins_n_bins", cfg.get("kbins_n_bins", n)))
                s = "kbins:" + {"equal_width": "uniform", "equal_frequency": "quantile"}.get(
                    o.get("kbins_strategy", cfg.get("kbins_strategy", "quantile")),
                    o.get("kbins_strategy", cfg.get("kbins_strategy", "quantile")))
            out.append((c, s, n, o))
        return out

    def fit(self, df, cfg):
        plan = self._plan(df, cfg)
        edges, labels = {}, {}
        width = [c for c, s, _, _ in plan if s in ("equal_width", "kbins:uniform")]
        row = agg_row(df, [e for c in width for e in (F.min(num(df, c)), F.max(num(df, c)))]) if width else []
        ranges = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(width)}
        groups: dict[tuple, list[str]] = {}
        for c, s, n, o in plan:
            if c in ranges:
                if ranges[c][0] is not None:
                    edges[c] = equal_width_edges(*ranges[c], n)
            elif s in ("equal_frequency", "kbins:quantile"):
                groups.setdefault((s, n), []).append(c)
            elif s in ("kmeans", "kbins:kmeans"):
                edges[c] = kmeans_edges(df, c, n)
            elif s == "custom":
                given = o.get("custom_bins") or (cfg.get("custom_bins") or {}).get(c)
                if given:
                    edges[c] = sorted(float(v) for v in given)
                lab = o.get("custom_labels") or (cfg.get("custom_labels") or {}).get(c)
                if lab:
                    labels[c] = list(lab)
        for (s, n), cols in groups.items():
            method = "linear" if s == "equal_frequency" else "averaged_inverted_cdf"
            for c, v in column_quantiles(df, cols, [i / n for i in range(n + 1)], method).items():
                if v[0] is not None:
                    edges[c] = v
        edges = {c: sorted(set(v)) for c, v in edges.items()}
        keep = ("label_format", "output_suffix", "drop_original", "missing_strategy", "missing_label",
                "include_lowest", "precision")
        return {"bin_edges": {c: v for c, v in edges.items() if len(v) >= 2},
                "custom_labels": labels, **{k: cfg[k] for k in keep}}

    def apply(self, df, art):
        new, drop = {}, []
        for c, edges in art["bin_edges"].items():
            if c not in df.columns:
                continue
            new[c + art["output_suffix"]] = bin_expression(num(df, c), edges, art, art["custom_labels"].get(c))
            if art["drop_original"]:
                drop.append(c)
        return with_columns(df, new, drop)


def bin_expression(x: Column, edges: list[float], opts: dict, labels: list | None) -> Column:
    """Right-closed bins, the lowest edge included; values outside all bins become null."""
    n = len(edges) - 1
    labels = labels if labels and len(labels) == n else None
    text = labels is not None or opts["label_format"] == "range"
    if labels is None and opts["label_format"] == "range":
        left = "[" if opts["include_lowest"] else "("
        labels = [f"{left}{round(edges[i], opts['precision'])}, {round(edges[i + 1], opts['precision'])}]"
                  for i in range(n)]
    low_ok = (x >= edges[0]) if opts["include_lowest"] else (x > edges[0])
    e = F.lit(None).cast("string" if text else "int")
    for i in range(n - 1, -1, -1):
        e = F.when(x <= F.lit(edges[i + 1]), F.lit(labels[i] if text else i)).otherwise(e)
    e = F.when(low_ok & (x <= F.lit(edges[-1])), e)
    if opts["missing_strategy"] == "label":
        e = F.coalesce(e.cast("string"), F.lit(opts["missing_label"]))
    return e


@operator("KBinsDiscretizer")
class KBinsDiscretizer(GeneralBinning):
    description = "Uniform, quantile or k-means bins"
    defaults = {**GeneralBinning.defaults, "strategy": "quantile"}

    def fit(self, df, cfg):
        s = cfg.get("strategy", "quantile")
        return super().fit(df, {**cfg, "strategy": "kbins", "kbins_strategy": s,
                                "kbins_n_bins": cfg.get("n_bins", 5)})
