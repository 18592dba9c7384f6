"""Numeric transforms and generated features."""

from __future__ import annotations

import math
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..core import (Operator, agg_row, choose_columns, detect_numeric, is_numeric, nn, num, operator, q,
                    with_columns)
from ..functions.expressions import (cell_geohash, date_part, equirectangular, haversine, parse_timestamp,
                                     similarity)


def transform_expression(x: Column, method: str) -> Column:
    if method == "log":
        return F.when(x >= 0, F.log1p(x))
    if method in ("sqrt", "square_root"):
        return F.when(x >= 0, F.sqrt(x))
    if method in ("cbrt", "cube_root"):
        return F.cbrt(x)
    if method == "reciprocal":
        return F.when(x != 0, F.lit(1.0) / x)
    if method == "square":
        return x * x
    if method in ("exp", "exponential"):
        return F.exp(F.when(x > 700, F.lit(700.0)).otherwise(x))
    raise ValueError(f"unknown transform {method!r}")


@operator("SimpleTransformation")
class SimpleTransformation(Operator):
    description = "log, sqrt, cube root, reciprocal, square or exp of columns"

    def fit(self, df, cfg):
        items = [t for t in cfg.get("transformations") or [] if t["column"] in df.columns]
        return {"transformations": items}

    def apply(self, df, art):
        new = {}
        for t in art["transformations"]:
            c = t["column"]
            if c in df.columns:
                new[c] = transform_expression(new.get(c, num(df, c)), t["method"])
        return with_columns(df, new)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    two = 2.0 - lam
    down = -F.log1p(-x) if abs(two) < 1e-12 else -(F.pow(F.lit(1.0) - x, F.lit(two)) - 1.0) / two
    return F.when(x >= 0, up).when(x < 0, down)


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1.0) / lam


POWER_BASES = {"yeo-johnson": yeo_johnson, "box-cox": box_cox}


def _growth(u: Column, lam: float) -> Column:
    """Derivative of (exp(lam * u) - 1) / lam by lam; a series where the difference would lose its digits."""
    if abs(lam) < 1e-4:
        return u * u * (F.lit(0.5) + F.lit(lam / 3.0) * u + F.lit(lam * lam / 8.0) * u * u)
    e = F.exp(F.lit(lam) * u)
    return (u * e - (e - 1.0) / lam) / lam


def _powered(x: Column, lam: float, method: str, shift: float = 0.0) -> tuple[Column, Column]:
    """The transformed value (box-cox: of x over exp(shift)) and its derivative by lambda."""
    if method == "box-cox":
        u = F.log(x) - F.lit(shift)
        return (u if abs(lam) < 1e-12 else F.expm1(F.lit(lam) * u) / lam), _growth(u, lam)
    return yeo_johnson(x, lam), F.when(x >= 0, _growth(F.log1p(x), lam)).when(x < 0, _growth(F.log1p(-x), 2.0 - lam))


def power_gradients(df: DataFrame, tries: dict[str, list[float]], method: str) -> dict[str, list[float]]:
    """Derivative by lambda of the log-likelihood of a row, for all columns and lambdas in one aggregation; not a
    number where values overflow or do not vary."""
    def jacobians():
        return agg_row(df, [F.avg(F.signum(num(df, c)) * F.log1p(F.abs(num(df, c))) if method == "yeo-johnson" else F.log(num(df, c))) for c in tries])
    # box-cox is taken over the geometric mean, where the derivative is the same and values keep their digits
    jacobian = dict(zip(tries, jacobians()))
    exprs = []
    for c, lams in tries.items():
        for lam in lams:
            y, slope = _powered(num(df, c), lam, method, jacobian[c] or 0.0)
            exprs += [F.covar_pop(y, slope), F.var_pop(y)]
    row, at, out = agg_row(df, exprs), 0, {}
    for c, lams in tries.items():
        out[c] = []
        for _ in lams:
            cov, var = row[at:at + 2]
            at += 2
            ok = jacobian[c] is not None and var and var > 0 and math.isfinite(var) and math.isfinite(cov)
            out[c].append((0.0 if method == "box-cox" else jacobian[c]) - cov / var if ok else math.nan)
    return out


def fit_power(df: DataFrame, cols: list[str], method: str, tolerance: float = 1e-10, rounds: int = 40) -> dict[str, float]:
    """Maximum-likelihood lambdas, without bounds: the zero of the likelihood's derivative.

    The derivative falls, so a change of sign brackets it; brackets grow outwards until they hold one (or values
    overflow: then the last lambda that did not), and shrink by secant and bisection. Each round
    evaluates a few lambdas of every open column in one aggregation.
    """
    seen = {c: {} for c in cols}
    tries = {c: [-1.0, 0.0, 1.0, 2.0, 3.0] for c in cols}
    best = {c: 1.0 for c in cols}
    for _ in range(rounds):
        if not tries:
            break
        for c, g in power_gradients(df, tries, method).items():
            seen[c].update((lam, v) for lam, v in zip(tries[c], g) if math.isfinite(v))
        following = {}
        for c, asked in tries.items():
            known = sorted(seen[c].items())
            if not known:
                continue
            best[c] = min(known, key=lambda kv: abs(kv[1]))[0]
            # far out values differ by rounding only, and so may their signs: the change of sign with the smallest slopes counts
            turns = [(kv, after) for kv, after in zip(known, known[1:]) if kv[1] > 0 >= after[1]]
            if abs(seen[c][best[c]]) < tolerance:
                continue
            if turns:
                (a, ga), (b, gb) = min(turns, key=lambda t: t[0][1] - t[1][1])
                if b - a < 1e-13 * max(1.0, abs(a)):
                    continue
                secant = a + (b - a) * ga / (ga - gb)
                near = (b - a) * 1e-3
                new = {secant, secant - near, secant + near, (a + b) / 2}
            else:
                end, step = (known[-1][0], 1) if known[-1][1] > 0 else (known[0][0], -1)
                new = {end + step * 2.0 ** k for k in range(1, 6)}
            new = sorted(v for v in new if v not in seen[c] and v not in asked and (not turns or a < v < b))
            if new:
                following[c] = new
        tries = following
    return best


@operator("PowerTransformer")
class PowerTransformer(Operator):
    description = "Yeo-Johnson or Box-Cox, then standardise"
    defaults = {"method": "yeo-johnson", "standardize": True}

    def fit(self, df, cfg):
        cols, method = [c for c in choose_columns(df, cfg, detect_numeric) if is_numeric(df, c)], cfg["method"]
        if method == "box-cox" and cols:
            low = agg_row(df, [F.min(num(df, c)) for c in cols])
            cols = [c for c, v in zip(cols, low) if v is not None and v > 0]
        lams = cfg.get("lambdas") or fit_power(df, cols, method)
        base = POWER_BASES[method]
        params = {}
        if cols:
            row = agg_row(df, [e for c in cols for e in (F.avg(base(num(df, c), lams[c])),
                                                         F.stddev_pop(base(num(df, c), lams[c])))])
            params = {c: {"lambda": lams[c], "mean": row[2 * i], "std": row[2 * i + 1] or 1.0}
                      for i, c in enumerate(cols)}
        return {"method": method, "standardize": cfg["standardize"], "params": params}

    def apply(self, df, art):
        base, new = POWER_BASES[art["method"]], {}
        for c, p in art["params"].items():
            if c in df.columns:
                e = base(num(df, c), p["lambda"])
                new[c] = (e - F.lit(p["mean"])) / F.lit(p["std"]) if art["standardize"] else e
        return with_columns(df, new)


@operator("GeneralTransformation")
class GeneralTransformation(Operator):
    description = "Per-column transforms, including power transforms"

    def fit(self, df, cfg):
        items = []
        for t in cfg.get("transformations") or []:
            if t["column"] not in df.columns:
                continue
            if t["method"] in POWER_BASES:
                sub = PowerTransformer().fit(df, {**PowerTransformer.defaults, "columns": [t["column"]],
                                                  "method": t["method"], **(t.get("params") or {})})
                items.append({"column": t["column"], "power": sub})
            else:
                items.append({"column": t["column"], "method": t["method"]})
        return {"transformations": items}

    def apply(self, df, art):
        for t in art["transformations"]:
            if "power" in t:
                df = PowerTransformer().apply(df, t["power"])
            elif t["column"] in df.columns:
                df = with_columns(df, {t["column"]: transform_expression(num(df, t["column"]), t["method"])})
        return df


# --- generated features ----------------------------------------------------------------------

def _safe(den: Column, eps: float, keep_sign: bool = True) -> Column:
    small = F.lit(eps) if not keep_sign else F.when(den < 0, F.lit(-eps)).otherwise(F.lit(eps))
    return F.when(F.abs(den) < eps, small).otherwise(den)


def arithmetic(df: DataFrame, op: dict, eps: float) -> Column | None:
    fill = 0 if op.get("fillna") is None else op["fillna"]
    terms = [F.coalesce(num(df, c), F.lit(float(fill)))
             for c in list(op.get("input_columns", [])) + list(op.get("secondary_columns", []))
             if c in df.columns]
    consts = [F.lit(float(v)) for v in op.get("constants", [])]
    method = op.get("method")
    if not terms and not consts:
        return None
    if method == "add":
        out = F.lit(0.0)
        for t in terms + consts:
            out = out + t
    elif method == "subtract":
        out = terms[0] if terms else F.lit(0.0)
        for t in terms[1:] + consts:
            out = out - t
    elif method == "multiply":
        out = F.lit(1.0)
        for t in terms + consts:
            out = out * t
    elif method == "divide":
        first, *rest = terms + consts
        out = first
        for t in rest:
            out = out / _safe(t, eps)
    else:
        return None
    return out


def ratio(df: DataFrame, op: dict, eps: float) -> Column | None:
    top = [c for c in op.get("input_columns", []) if c in df.columns]
    low = [c for c in op.get("secondary_columns", []) if c in df.columns]
    if not top or not low:
        return None

    def total(cols):
        out = F.lit(0.0)
        for c in cols:
            out = out + F.coalesce(num(df, c), F.lit(0.0))
        return out
    return total(top) / _safe(total(low), eps, keep_sign=False)


def _output_name(op: dict, i: int, existing: list[str], overwrite: bool) -> str:
    name = op.get("output_column")
    if not name:
        name = f"{op.get('operation_type', 'arithmetic')}_{i}"
        if op.get("output_prefix"):
            name = f"{op['output_prefix']}_{name}"
    if name not in existing or overwrite:
        return name
    j = 1
    while f"{name}_{j}" in existing:
        j += 1
    return f"{name}_{j}"


GROUP_AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
                    "std": F.stddev_samp}


def group_aggregates(df: DataFrame, group: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Group statistics on every row; ``wanted`` is output -> (column, method).

    One grouped aggregation (combined before the shuffle) joined back once, instead of a window
    that would hold a hot group in one task.
    """
    from ..plans.lookup import size_checked_join
    from ..plans.quantiles import grouped_quantiles
    plain = {o: (c, m) for o, (c, m) in wanted.items() if m != "median"}
    aggs = [GROUP_AGGREGATES[m](nn(df, c) if m == "count" else num(df, c)).alias(o) for o, (c, m) in plain.items()]
    t = df.groupBy(q(group).alias("__g")).agg(*aggs) if aggs else None
    medians = {o: c for o, (c, m) in wanted.items() if m == "median"}
    if medians:
        cols = list(dict.fromkeys(medians.values()))
        g = grouped_quantiles(df, group, cols, [0.5])
        g = g.select(q(group).alias("__m" if aggs else "__g"), *[q(f"{c}_q")[0].alias(o) for o, c in medians.items()])
        t = t.join(g, t["__g"].eqNullSafe(g["__m"])).drop("__m") if aggs else g
    base = df.drop(*[o for o in wanted if o in df.columns])
    joined = size_checked_join(base, t, base[f"`{group}`"].eqNullSafe(t["__g"]), "left")
    return joined.select(*[q(c) for c in base.columns], *[q(o) for o in wanted])


@operator("FeatureGeneration", "FeatureGenerationNode", "FeatureMath")
class FeatureGeneration(Operator):
    description = "Arithmetic, ratio, similarity, date parts and group statistics"
    defaults = {"epsilon": V.EPSILON, "allow_overwrite": False}
    stateless = True

    def fit(self, df, cfg):
        return {"operations": list(cfg.get("operations") or []), "epsilon": float(cfg["epsilon"]),
                "allow_overwrite": bool(cfg["allow_overwrite"])}

    def apply(self, df, art):
        eps, pending, by = art["epsilon"], {}, None
        for i, op in enumerate([*art["operations"], {"operation_type": "end"}]):
            kind = op.get("operation_type", "arithmetic")
            if pending and (kind != "group_agg" or (op.get("input_columns") or [None])[0] != by
                            or set(op.get("secondary_columns", [])) & set(pending)):
                df, pending = group_aggregates(df, by, pending), {}
            if kind == "end":
                break
            ins = [c for c in op.get("input_columns", []) if c in df.columns]
            if kind == "datetime_extract":
                new = {}
                for c in ins:
                    ts = parse_timestamp(df, c)
                    for part in op.get("datetime_features", []):
                        new[f"{c}_{part}"] = date_part(ts, part)
                df = with_columns(df, new)
                continue
            out = _output_name(op, i, [*df.columns, *pending], art["allow_overwrite"])
            if kind == "group_agg":
                sec = [c for c in op.get("secondary_columns", []) if c in df.columns]
                if ins and sec:
                    by = ins[0]
                    pending[out] = (sec[0], op.get("method") or "mean")
                continue
            if kind == "polynomial":
                df = PolynomialFeatures().apply(df, {**PolynomialFeatures.defaults, "columns": ins, **{
                    k: op[k] for k in ("degree", "interaction_only", "include_bias") if k in op}})
                continue
            if kind == "similarity":
                pair = (ins + [c for c in op.get("secondary_columns", []) if c in df.columns])[:2]
                if op.get("secondary_columns") and ins:
                    pair = [ins[0], op["secondary_columns"][0]]
                e = similarity(q(pair[0]), q(pair[1]), op.get("method") or "ratio") if len(pair) == 2 else None
            else:
                e = {"arithmetic": arithmetic, "ratio": ratio}[kind](df, op, eps)
            if e is None:
                continue
            if op.get("round_digits") is not None:
                e = F.bround(e, int(op["round_digits"]))
            df = with_columns(df, {out: e})
        return df


def _product(df, combo):
    e = num(df, combo[0])
    for c in combo[1:]:
        e = e * num(df, c)
    return e


@operator("PolynomialFeatures", "PolynomialFeaturesNode")
class PolynomialFeatures(Operator):
    description = "All monomials up to a degree"
    defaults = {"degree": 2, "interaction_only": False, "include_bias": False,
                "include_input_features": False, "output_prefix": "poly"}

    def fit(self, df, cfg):
        cols = list(cfg.get("columns") or [])
        if not cols and cfg.get("auto_detect"):
            cols = detect_numeric(df, [cfg["target_column"]] if cfg.get("target_column") else [])
        return {"columns": [c for c in cols if c in df.columns and is_numeric(df, c)],
                **{k: cfg[k] for k in self.defaults}}

    def apply(self, df, art):
        cols = [c for c in art["columns"] if c in df.columns]
        pick = combinations if art["interaction_only"] else combinations_with_replacement
        new = {}
        if art["include_bias"] and cols:
            new[f"{art['output_prefix']}_1"] = F.lit(1.0)
        for d in range(1, int(art["degree"]) + 1):
            if d == 1 and not art["include_input_features"]:
                continue
            for combo in pick(cols, d):
                parts = [c if combo.count(c) == 1 else f"{c}_pow_{combo.count(c)}" for c in dict.fromkeys(combo)]
                new[f"{art['output_prefix']}_" + "_".join(parts).replace(" ", "_")] = _product(df, combo)
        return with_columns(df, new)


@operator("FeatureInteraction")
class FeatureInteraction(Operator):
    description = "Products of two to four columns"
    defaults = {"degree": 2, "interaction_only": True, "include_bias": False}

    def fit(self, df, cfg):
        cols = list(cfg.get("columns") or [])
        bad = [c for c in cols if c not in df.columns or not is_numeric(df, c)]
        if bad:
            raise ValueError(f"not numeric columns of the table: {bad}")
        if int(cfg["degree"]) not in (2, 3, 4):
            raise ValueError("degree must be 2, 3 or 4")
        pick = combinations if cfg["interaction_only"] else combinations_with_replacement
        return {"combinations": [list(c) for c in pick(sorted(cols), int(cfg["degree"]))],
                "include_bias": bool(cfg["include_bias"])}

    def apply(self, df, art):
        new = {"_x_".join(c): _product(df, c) for c in art["combinations"]
               if all(x in df.columns for x in c)}
        if art["include_bias"] and "interaction_bias" not in df.columns:
            new["interaction_bias"] = F.lit(1.0)
        return with_columns(df, new)


@operator("GeoDistance")
class GeoDistance(Operator):
    description = "Distance between two coordinate pairs"
    defaults = {"method": "haversine", "unit": "km", "output_column": "geo_distance_km"}

    def fit(self, df, cfg):
        if cfg["method"] not in ("haversine", "euclidean") or cfg["unit"] not in ("km", "mi"):
            raise ValueError("method is haversine or euclidean; unit is km or mi")
        return {k: cfg[k] for k in ("lat1_col", "lon1_col", "lat2_col", "lon2_col", *self.defaults)}

    def apply(self, df, art):
        names = [art[k] for k in ("lat1_col", "lon1_col", "lat2_col", "lon2_col")]
        if any(c not in df.columns for c in names):
            return df
        r = V.EARTH_RADIUS_KM * (V.MILES_PER_KM if art["unit"] == "mi" else 1.0)
        fn = haversine if art["method"] == "haversine" else equirectangular
        return with_columns(df, {art["output_column"]: fn(*[num(df, c) for c in names], r)})


@operator("GridCell")
class GridCell(Operator):
    description = "Geohash cell of a coordinate pair (a square grid, not hexagons)"
    defaults = {"resolution": 6, "output_column": "geo_cell"}

    def fit(self, df, cfg):
        return {"lat_col": cfg["lat_col"], "lon_col": cfg["lon_col"], "resolution": int(cfg["resolution"]),
                "output_column": cfg["output_column"]}

    def apply(self, df, art):
        return with_columns(df, {art["output_column"]: cell_geohash(
            num(df, art["lat_col"]), num(df, art["lon_col"]), art["resolution"])})
