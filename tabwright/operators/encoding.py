"""Categorical encoders. Category tables are counted with map-side combining and stay small or
become a shared table; apply never shuffles unless the table is beyond the broadcast bound."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import fixed_values as V
from ..core import (Operator, agg_row, choose_columns, detect_categorical, is_numeric, nn, num,
                    operator, q, with_columns)
from ..functions.expressions import hash_bucket, hash_rank
from ..plans.lookup import BROADCAST_KEYS, build_map, map_column

# One output column per category: more than this is refused instead of building a giant row.
MAX_WIDE_COLUMNS = 10_000


def _text(df, c):
    return nn(df, c).cast("string")


def _cat_columns(df, cfg):
    cols = choose_columns(df, cfg, detect_categorical)
    return [c for c in cols if c != cfg.get("target_column")]


def category_counts(df: DataFrame, columns: list[str], missing: str | None = None) -> DataFrame:
    """(c, v, n) for all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"),
                               (F.coalesce(_text(df, c), F.lit(missing)) if missing is not None
                                else _text(df, c)).alias("v")) for c in columns])
    return (df.select(F.explode(pairs).alias("p")).select("p.c", "p.v").where("v is not null")
            .groupBy("c", "v").agg(F.count("*").alias("n")))


def _collect_categories(counts: DataFrame, limit: int) -> dict[str, list]:
    rows = counts.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories; use TargetEncoder or HashEncoder")
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["c"], []).append((r["v"], r["n"]))
    return out


@operator("OneHotEncoder")
class OneHotEncoder(Operator):
    description = "One 0/1 column per category, rare ones folded together"
    defaults = {"drop_first": False, "max_categories": 20, "handle_unknown": "ignore",
                "include_missing": False, "drop_original": True, "prefix_separator": "_"}

    def fit(self, df, cfg):
        cols = _cat_columns(df, cfg)
        miss = V.ONE_HOT_MISSING if cfg["include_missing"] else None
        counts = category_counts(df, cols, miss) if cols else None
        cap = cfg["max_categories"]
        cats: dict[str, dict] = {}
        if cols:
            if cap is not None:
                top = _top_categories(counts, int(cap))
                got = {r["c"]: (r["total"], [x["v"] for x in r["t"]]) for r in top.collect()}
            else:
                got = {c: (len(v), [x for x, _ in v])
                       for c, v in _collect_categories(counts, MAX_WIDE_COLUMNS).items()}
            for c in cols:
                total, ranked = got.get(c, (0, []))
                folded = cap is not None and total > int(cap)
                shown = sorted(ranked[:int(cap) - 1] if folded else ranked)
                if cfg["drop_first"]:
                    shown = shown[1:]
                cats[c] = {"shown": shown, "infrequent": folded}
                if folded or cfg["handle_unknown"] != "ignore":
                    cats[c]["known"] = build_map(
                        counts.where(F.col("c") == c).select(F.col("v").alias("key"), F.lit(1).alias("value")),
                        "onehot-known")
                    cats[c]["top"] = ranked[:int(cap) - 1] if folded else ranked
        return {"columns": cols, "categories": cats, "handle_unknown": cfg["handle_unknown"],
                "include_missing": cfg["include_missing"], "drop_original": cfg["drop_original"]}

    def apply(self, df, art):
        new, out = {}, df
        helper = []
        for c in art["columns"]:
            if c not in df.columns:
                continue
            spec = art["categories"][c]
            x = _text(df, c)
            if art["include_missing"]:
                x = F.coalesce(x, F.lit(V.ONE_HOT_MISSING))
            for cat in spec["shown"]:
                new[f"{c}_{cat}"] = x.eqNullSafe(F.lit(cat)).cast("tinyint")
            if "known" in spec:
                flag = f"__known_{c}"
                out = map_column(out, c, spec["known"], flag, key=x, default=0, value_type="int")
                helper.append(flag)
                if spec["infrequent"]:
                    new[f"{c}_infrequent_sklearn"] = (
                        (q(flag) == 1) & ~x.isin(spec["top"])).cast("tinyint")
                if art["handle_unknown"] == "error":
                    probe = F.when((q(flag) == 0) & x.isNotNull(), F.raise_error(
                        F.concat(F.lit(f"unknown category in {c}: "), x)).cast("tinyint")).otherwise(F.lit(0))
                    first = next((k for k in new if k.startswith(f"{c}_")), None)
                    if first:
                        new[first] = new[first] + probe.cast("tinyint")
        drop = [c for c in art["columns"] if c in df.columns] if art["drop_original"] else []
        return with_columns(out, new, drop + helper)


def _top_categories(counts: DataFrame, k: int) -> DataFrame:
    """(c, total, t): the k most counted values per column, reduced in two steps so that a column
    with very many values is never gathered."""
    entry = F.struct((-F.col("n")).alias("m"), F.col("v").alias("v"))
    part = counts.withColumn("__s", F.pmod(F.xxhash64("v"), F.lit(256)))
    w = W.partitionBy("c", "__s").orderBy("n_desc", "v")
    local = (part.withColumn("n_desc", -F.col("n")).withColumn("__r", F.row_number().over(w))
             .where(F.col("__r") <= k))
    best = (local.withColumn("e", entry).groupBy("c")
            .agg(F.slice(F.array_sort(F.collect_list("e")), 1, k).alias("t")))
    totals = counts.groupBy("c").agg(F.count("*").alias("total"))
    return best.join(totals, "c")


@operator("DummyEncoder")
class DummyEncoder(Operator):
    description = "Fixed 0/1 columns per category"
    defaults = {"drop_first": False}

    def fit(self, df, cfg):
        cols = _cat_columns(df, cfg)
        got = _collect_categories(category_counts(df, cols), MAX_WIDE_COLUMNS) if cols else {}
        return {"columns": cols, "drop_first": cfg["drop_first"],
                "categories": {c: sorted(v for v, _ in got.get(c, [])) for c in cols}}

    def apply(self, df, art):
        new, drop = {}, []
        for c in art["columns"]:
            if c not in df.columns:
                continue
            cats = art["categories"][c]
            drop.append(c)
            for cat in cats[1:] if art["drop_first"] and len(cats) > 1 else cats:
                new[f"{c}_{cat}"] = F.coalesce((_text(df, c) == F.lit(cat)).cast("int"), F.lit(0))
        return with_columns(df, new, drop)


def _codes(counts: DataFrame, c: str) -> dict:
    """Sorted categories numbered from 0. Small lists are numbered on the driver; large ones by
    prefix ranges, so numbering is not one sort in one task."""
    one = counts.where(F.col("c") == c).select("v")
    rows = one.limit(BROADCAST_KEYS + 1).collect()
    if len(rows) <= BROADCAST_KEYS:
        return {"pairs": [[v, i] for i, v in enumerate(sorted(r["v"] for r in rows))]}
    from ..plans.textorder import number_sorted
    return build_map(number_sorted(one, "v").select(F.col("v").alias("key"), F.col("code").alias("value")),
                     "codes")


@operator("LabelEncoder")
class LabelEncoder(Operator):
    description = "Sorted classes to 0..n-1; unseen values get missing_code"
    defaults = {"missing_code": -1}

    def fit(self, df, cfg):
        cols = choose_columns(df, cfg, None) or ([cfg["target_column"]] if cfg.get("target_column") else [])
        counts = category_counts(df, cols, V.ENCODER_MISSING)
        return {"columns": cols, "missing_code": int(cfg["missing_code"]),
                "maps": {c: _codes(counts, c) for c in cols}}

    def apply(self, df, art):
        for c in art["columns"]:
            if c in df.columns:
                key = F.coalesce(_text(df, c), F.lit(V.ENCODER_MISSING))
                df = _in_place(df, map_column(df, c, art["maps"][c], c, key, art["missing_code"], "bigint"))
        return df


def _in_place(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.select(*[q(c) for c in before.columns])


def decode_labels(df: DataFrame, column: str, art: dict, source: str, out: str) -> DataFrame:
    """Integer predictions back to class names, from a LabelEncoder artifact."""
    m = art["maps"][source]
    if "pairs" in m:
        inverse = {"pairs": [[str(v), k] for k, v in m["pairs"]]}
        return map_column(df, column, inverse, out, q(column).cast("bigint").cast("string"), None, "string")
    right = df.sparkSession.read.parquet(m["table"]).select(
        F.col("value").cast("bigint").alias("__k"), F.col("key").alias(out))
    return df.join(right, q(column).cast("bigint") == F.col("__k"), "left").drop("__k")


@operator("OrdinalEncoder")
class OrdinalEncoder(Operator):
    description = "Categories to numbers in a given or sorted order"
    defaults = {"categories_order": None, "handle_unknown": "use_encoded_value", "unknown_value": -1}

    def fit(self, df, cfg):
        cols = _cat_columns(df, cfg)
        order = cfg.get("categories_order") or {}
        if isinstance(order, list):
            order = dict(zip(cols, order if order and isinstance(order[0], list) else [order]))
        order = {c: ([s.strip() for s in v.split(",")] if isinstance(v, str) else list(v))
                 for c, v in order.items()}
        auto = [c for c in cols if c not in order]
        counts = category_counts(df, auto, V.ENCODER_MISSING) if auto else None
        maps = {c: ({"pairs": [[str(v), i] for i, v in enumerate(order[c])]} if c in order
                    else _codes(counts, c)) for c in cols}
        return {"columns": cols, "maps": maps, "handle_unknown": cfg["handle_unknown"],
                "unknown_value": cfg["unknown_value"]}

    def apply(self, df, art):
        for c in art["columns"]:
            if c not in df.columns:
                continue
            key = F.coalesce(_text(df, c), F.lit(V.ENCODER_MISSING))
            error = art["handle_unknown"] == "error"
            new = map_column(df, c, art["maps"][c], "__code", key,
                             None if error else art["unknown_value"], "double")
            code = q("__code")
            if error:
                code = F.coalesce(code, F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), key)).cast("double"))
            df = new.select(*[code.alias(c) if x == c else q(x) for x in df.columns])
        return df


@operator("HashEncoder")
class HashEncoder(Operator):
    description = "Stable hash of a category modulo n_features"
    defaults = {"n_features": 10, "hash": "xxhash64"}

    def fit(self, df, cfg):
        return {"columns": _cat_columns(df, cfg), "n_features": int(cfg["n_features"]), "hash": cfg["hash"]}

    def apply(self, df, art):
        return with_columns(df, {c: hash_bucket(F.coalesce(_text(df, c), F.lit(V.ENCODER_MISSING)),
                                                art["n_features"], art["hash"])
                                 for c in art["columns"] if c in df.columns})


@operator("TargetEncoder")
class TargetEncoder(Operator):
    """Smoothed mean of the target per category.

    Training rows are encoded without their own fold. Per-fold sums are the category totals minus
    the fold's own sums: one grouped aggregation of (category, fold), no loop over folds.
    """

    description = "Category to smoothed target mean"
    defaults = {"smooth": "auto", "target_type": "auto", "cv": 5, "random_state": 42}

    def _classes(self, df, cfg):
        t, kind = cfg["target_column"], cfg["target_type"]
        if kind in ("continuous", "regression"):
            return None
        if kind == "auto" and is_numeric(df, t):
            lo, hi, other = agg_row(df, [F.min(num(df, t)), F.max(num(df, t)),
                                         F.count_if(~num(df, t).isin(0.0, 1.0))])
            if other:
                return None
        rows = df.select(_text(df, t).alias("v")).where("v is not null").distinct().limit(1001).collect()
        if len(rows) > 1000:
            raise ValueError("more than 1000 target classes")
        vals = [r["v"] for r in rows]
        return sorted(vals, key=lambda v: (float(v), v) if _isnum(v) else (math.inf, v))

    def _targets(self, df, cfg, classes):
        t = cfg["target_column"]
        if classes is None:
            return [num(df, t)]
        if len(classes) <= 2:
            return [(_text(df, t) == F.lit(classes[-1])).cast("double")]
        return [(_text(df, t) == F.lit(k)).cast("double") for k in classes]

    def _sums(self, df, c, ys, extra=()):
        key = F.coalesce(_text(df, c), F.lit(V.ENCODER_MISSING)).alias("key")
        aggs = []
        for j, y in enumerate(ys):
            aggs += [F.count(y).alias(f"n{j}"), F.sum(y).alias(f"s{j}"), F.sum(y * y).alias(f"q{j}")]
        return df.groupBy(key, *extra).agg(*aggs)

    def fit(self, df, cfg):
        cols = _cat_columns(df, cfg)
        classes = self._classes(df, cfg)
        ys = self._targets(df, cfg, classes)
        row = agg_row(df, [e for y in ys for e in (F.avg(y), F.var_pop(y))])
        mu, var = row[0::2], row[1::2]
        maps = {}
        for c in cols:
            t = self._sums(df, c, ys)
            for j in range(len(ys)):
                v = _smooth(F.col(f"n{j}"), F.col(f"s{j}"), F.col(f"q{j}"), F.lit(mu[j]), F.lit(var[j]),
                            cfg["smooth"])
                maps.setdefault(c, []).append(build_map(t.select("key", v.alias("value")), "target-enc"))
        return {"columns": cols, "classes": classes, "means": mu, "vars": var, "maps": maps,
                "smooth": cfg["smooth"], "target_column": cfg["target_column"]}

    def apply(self, df, art):
        for c in art["columns"]:
            if c not in df.columns:
                continue
            key = F.coalesce(_text(df, c), F.lit(V.ENCODER_MISSING))
            if len(art["means"]) == 1:
                new = map_column(df, c, art["maps"][c][0], "__v", key, art["means"][0], "double")
                df = new.select(*[q("__v").alias(c) if x == c else q(x) for x in df.columns])
            else:
                for j, m in enumerate(art["maps"][c]):
                    df = map_column(df, c, m, f"{c}_cls{j}", key, art["means"][j], "double")
                df = df.drop(c)
        return df

    def fit_apply_train(self, df, cfg):
        art = self.fit(df, cfg)
        key = list(cfg.get("key_columns") or [])
        if not key:
            raise ValueError("TargetEncoder training needs key_columns to assign folds")
        classes, ys = art["classes"], self._targets(df, cfg, art["classes"])
        n_row = agg_row(df, [F.count("*")] + ([F.sum(y) for y in ys] if classes is not None else []))
        k = min(int(cfg["cv"]), n_row[0])
        if classes is not None:
            sizes = [int(v) for v in n_row[1:]]
            smallest = min(sizes + ([n_row[0] - sizes[0]] if len(classes) == 2 else []))
            if smallest < 2:
                raise ValueError("every target class needs at least two rows")
            k = min(k, smallest)
        kh = hash_rank(F.concat_ws("|", *[q(x).cast("string") for x in key]), int(cfg["random_state"]))
        work = df.withColumn("__fold", F.pmod(kh, F.lit(k)).cast("int"))
        folds = work.groupBy("__fold").agg(*[e for j, y in enumerate(ys) for e in (
            F.count(y).alias(f"n{j}"), F.sum(y).alias(f"s{j}"), F.sum(y * y).alias(f"q{j}"))]).collect()
        out = work
        for c in art["columns"]:
            parts = self._sums(work, c, ys, ["__fold"])
            w = W.partitionBy("key")  # at most k rows per category
            exprs = []
            for j in range(len(ys)):
                tn, ts, tq = (sum(r[f"{m}{j}"] for r in folds) for m in "nsq")
                mu = F.lit(None).cast("double")
                var = F.lit(None).cast("double")
                for r in folds:
                    n, s, sq = tn - r[f"n{j}"], ts - r[f"s{j}"], tq - r[f"q{j}"]
                    m = s / n if n else None
                    mu = F.when(F.col("__fold") == r["__fold"], F.lit(m)).otherwise(mu)
                    var = F.when(F.col("__fold") == r["__fold"],
                                 F.lit(sq / n - m * m if n else None)).otherwise(var)
                rest = [F.sum(f"{m}{j}").over(w) - F.col(f"{m}{j}") for m in "nsq"]
                exprs.append(F.coalesce(_smooth(*rest, mu, var, cfg["smooth"]), mu).alias(f"__v{j}"))
            table = parts.select(F.col("key").alias("__key"), F.col("__fold").alias("__kf"), *exprs)
            from ..plans.lookup import size_checked_join
            left = out.withColumn("__ck", F.coalesce(_text(df, c), F.lit(V.ENCODER_MISSING)))
            joined = size_checked_join(left, table, (F.col("__ck") == F.col("__key"))
                                       & (F.col("__fold") == F.col("__kf")), "left")
            names = [f"{c}_cls{j}" for j in range(len(ys))] if len(ys) > 1 else [c]
            out = joined.select(*[q(x) for x in out.columns if x != c],
                                *[q(f"__v{j}").alias(n) for j, n in enumerate(names)])
        order = [x for x in df.columns if x in out.columns]
        return art, out.select(*[q(x) for x in order],
                               *[q(x) for x in out.columns if x not in order and x != "__fold"])


def _isnum(v):
    try:
        float(v)
        return True
    except ValueError:
        return False


def _smooth(n, s, sq, mu, var, smooth):
    """Shrink a category mean to the overall mean."""
    mean = s / n
    if smooth == "auto":
        inner = F.greatest(sq / n - mean * mean, F.lit(0.0))
        lam = F.when(var + inner / n > 0, var / (var + inner / n)).otherwise(F.lit(1.0))
        return F.when(n > 0, lam * mean + (F.lit(1.0) - lam) * mu)
    m = float(smooth)
    return F.when(n > 0, (s + F.lit(m) * mu) / (n + F.lit(m)))


@operator("WOEEncoder")
class WOEEncoder(Operator):
    description = "Weight of evidence of a binary target, with information value"
    defaults = {"regularization": 0.5}

    def fit(self, df, cfg):
        cols, t, r = _cat_columns(df, cfg), cfg["target_column"], float(cfg["regularization"])
        y = _text(df, t)
        rows = df.select(y.alias("v")).where("v is not null").distinct().limit(3).collect()
        classes = sorted((x["v"] for x in rows), key=lambda v: (float(v), v) if _isnum(v) else (0.0, v))
        if len(classes) != 2:
            raise ValueError("WOEEncoder needs a target with exactly two classes")
        pos = (y == F.lit(classes[1])).cast("double")
        neg = (y == F.lit(classes[0])).cast("double")
        P, N = agg_row(df, [F.sum(pos), F.sum(neg)])
        maps, iv = {}, {}
        for c in cols:
            key = F.coalesce(_text(df, c), F.lit(V.ENCODER_MISSING))
            t2 = woe_table(df.groupBy(key.alias("key")).agg(F.sum(pos).alias("p"), F.sum(neg).alias("g")), P, N, r)
            maps[c] = build_map(t2.select("key", F.col("woe").alias("value")), "woe")
            iv[c] = t2.agg(F.sum("iv")).first()[0]
        return {"columns": cols, "maps": maps, "iv": iv, "positive": classes[1], "regularization": r}

    def apply(self, df, art):
        for c in art["columns"]:
            if c in df.columns:
                key = F.coalesce(_text(df, c), F.lit(V.ENCODER_MISSING))
                df = _in_place(df, map_column(df, c, art["maps"][c], c, key, 0.0, "double"))
        return df


def woe_table(counts: DataFrame, positives: float, negatives: float, r: float) -> DataFrame:
    dist_neg = (F.col("g") + r) / F.lit(negatives + r)
    dist_pos = (F.col("p") + r) / F.lit(positives + r)
    return counts.select("key", F.log(dist_neg / dist_pos).alias("woe"),
                         ((dist_neg - dist_pos) * F.log(dist_neg / dist_pos)).alias("iv"))
