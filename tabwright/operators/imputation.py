"""Filling missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..core import (FLOAT_TYPES, Operator, agg_row, choose_columns, detect_numeric, dtype_of, is_numeric,
                    nn, num, numeric_candidates, operator, q, with_columns)
from ..plans.quantiles import column_quantiles


def modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent value per column, ties to the smallest.

    All columns share one pass: (column, value) pairs are counted with map-side combining and the
    best pair per column is a grouped maximum, so no value list is ever gathered.
    """
    out = {}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(dtype_of(df, c).simpleString(), []).append(c)
    for cols in by_type.values():
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), nn(df, c).alias("v")) for c in cols])
        counted = (df.select(F.explode(pairs).alias("p")).select("p.c", "p.v").where("v is not null")
                   .groupBy("c", "v").agg(F.count("*").alias("n")))
        best = counted.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
        out.update({r["c"]: r["v"] for r in best.collect()})
    return out


@operator("SimpleImputer")
class SimpleImputer(Operator):
    description = "Fill missing values by mean, median, most frequent value or a constant"
    defaults = {"strategy": "mean", "fill_value": None}

    def fit(self, df, cfg):
        strategy = {"mode": "most_frequent"}.get(cfg["strategy"], cfg["strategy"])
        auto = (lambda d, ex: numeric_candidates(d, ex)) if strategy in ("mean", "median") else \
            (lambda d, ex: [c for c in d.columns if c not in ex])
        cols = choose_columns(df, cfg, auto)
        if strategy in ("mean", "median"):
            cols = [c for c in cols if is_numeric(df, c)]
        counts = agg_row(df, [F.count("*")] + [F.count(nn(df, c)) for c in cols]
                         + ([F.avg(num(df, c)) for c in cols] if strategy == "mean" else []))
        n, have = counts[0], counts[1:1 + len(cols)]
        if strategy == "mean":
            fill = dict(zip(cols, counts[1 + len(cols):]))
        elif strategy == "median":
            fill = {c: v[0] for c, v in column_quantiles(df, cols, [0.5]).items()}
        elif strategy == "most_frequent":
            fill = modes(df, cols)
        elif strategy == "constant":
            v = cfg.get("fill_value")
            fill = {c: 0 if v is None else v for c in cols}
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
        missing = {c: n - h for c, h in zip(cols, have)}
        fill = {c: (v if isinstance(v, (int, float, str, bool, type(None))) else str(v))
                for c, v in fill.items()}
        return {"strategy": strategy, "columns": cols, "fill_values": fill,
                "types": {c: dtype_of(df, c).simpleString() for c in cols},
                "missing_counts": missing, "total_missing": sum(missing.values())}

    def apply(self, df, art):
        new = {}
        for c in art["columns"]:
            v, t = art["fill_values"].get(c), art["types"][c]
            if art["strategy"] in ("mean", "median") and t != "double":
                t = "double"
            lit = F.lit(v).cast(t)
            if c not in df.columns:
                new[c] = lit
            elif v is not None:
                x = nn(df, c)
                same = dtype_of(df, c).simpleString() == t
                new[c] = F.coalesce(x if same else x.cast(t), lit)
        return with_columns(df, new)


@operator("KNNImputer")
class KNNImputer(Operator):
    """Mean of the k nearest rows that have the value; distances ignore missing coordinates.

    The donors are the rows of the fit table (kept by reference to a written table, not in the
    artifact); apply needs ``key_columns`` that identify a row.
    """

    description = "Fill missing values from the nearest rows"
    defaults = {"n_neighbors": 5, "weights": "uniform"}
    stateless = False

    def fit(self, df, cfg):
        from ..session import shared_table_path
        cols = [c for c in choose_columns(df, cfg, numeric_candidates) if is_numeric(df, c)]
        key = list(cfg.get("key_columns") or [])
        if not key:
            raise ValueError("KNNImputer needs key_columns to tell rows apart")
        path = shared_table_path(df.sparkSession, "knn-donors")
        df.select(*[q(k) for k in key], *[num(df, c).alias(c) for c in cols]).write.parquet(path)
        means = agg_row(df, [F.avg(num(df, c)) for c in cols])
        return {"columns": cols, "key_columns": key, "donors": path,
                "means": dict(zip(cols, means)), "n_neighbors": int(cfg["n_neighbors"]),
                "weights": cfg["weights"]}

    def apply(self, df, art):
        donors = df.sparkSession.read.parquet(art["donors"])
        return knn_fill(df, donors, art)


def knn_fill(df: DataFrame, donors: DataFrame, art: dict) -> DataFrame:
    from ..plans.neighbors import knn_join
    cols, key, k = art["columns"], art["key_columns"], art["n_neighbors"]
    need = df.where(F.exists(F.array(*[nn(df, c).isNull() for c in cols]), lambda x: x))
    fills = None
    for c in cols:
        left = need.where(nn(df, c).isNull())
        right = donors.where(q(c).isNotNull())
        pairs = knn_join(left, right, cols, k, key, key, missing=True, carry=[c])
        value = q(f"r_{c}")
        if art["weights"] == "distance":
            zero = F.max((F.col("distance") == 0).cast("int"))
            exact = F.avg(F.when(F.col("distance") == 0, value))
            weighted = (F.sum(F.when(F.col("distance") > 0, value / F.col("distance")))
                        / F.sum(F.when(F.col("distance") > 0, 1.0 / F.col("distance"))))
            est = F.when(zero == 1, exact).otherwise(weighted)
        else:
            est = F.avg(value)
        one = (pairs.groupBy(*[q(f"l_{x}").alias(x) for x in key]).agg(est.alias("__v"))
               .select(*[q(x) for x in key], F.lit(c).alias("__c"), F.col("__v")))
        fills = one if fills is None else fills.unionByName(one)
    wide = fills.groupBy(*[q(x) for x in key]).agg(
        *[F.max(F.when(F.col("__c") == c, F.col("__v"))).alias(f"__f_{c}") for c in cols])
    out = df.join(wide, key, "left")
    keep = []
    for c in df.columns:
        if c in cols:
            keep.append(F.coalesce(num(df, c), q(f"__f_{c}"), F.lit(art["means"][c])).alias(c))
        else:
            keep.append(q(c))
    return out.select(*keep)


@operator("IterativeImputer")
class IterativeImputer(Operator):
    """Round-robin regression of each column on the others, as Spark ML fits.

    Each fitted model is a short list of coefficients (or a saved tree model), so apply is a
    chain of projections over the mean-filled row. ``KNeighbors`` fills by the mean of the
    ``n_neighbors`` nearest rows instead (``plans/neighbour_rounds.py``) and needs ``key_columns``.
    """

    description = "Fill missing values by chained regressions"
    defaults = {"max_iter": 10, "estimator": "BayesianRidge", "tol": 1e-3, "cache": True, "n_neighbors": 5}

    def fit(self, df, cfg):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import (DecisionTreeRegressor, LinearRegression, RandomForestRegressor)
        from ..session import cut_lineage, shared_table_path
        neighbours, key = "Neighbors" in cfg["estimator"], list(cfg.get("key_columns") or [])
        if neighbours and not key:
            raise ValueError("the neighbour estimator needs key_columns to tell rows apart")
        cols = [c for c in choose_columns(df, cfg, numeric_candidates) if is_numeric(df, c)]
        row = agg_row(df, [F.avg(num(df, c)) for c in cols] + [F.count(num(df, c)) for c in cols]
                      + [F.count("*")] + [F.stddev_pop(num(df, c)) for c in cols])
        p = len(cols)
        means, have, n, stds = dict(zip(cols, row[:p])), dict(zip(cols, row[p:2 * p])), row[2 * p], row[2 * p + 1:]
        stds = {c: s or 1.0 for c, s in zip(cols, stds)}
        order = sorted([c for c in cols if 0 < have[c] < n], key=lambda c: n - have[c])
        linear = cfg["estimator"] in ("BayesianRidge", "bayesian_ridge")
        if neighbours:
            from ..plans.neighbour_rounds import fit_rounds
            cols = [c for c in cols if have[c]]
            art = {"columns": cols, "means": means, "key_columns": key, "order": order, "n_neighbors": int(cfg["n_neighbors"]), "steps": []}
            if order and len(cols) > 1:
                art.update(fit_rounds(df, key, cols, order, means, stds, art["n_neighbors"], int(cfg["max_iter"]), float(cfg["tol"])))
            return art
        steps = []
        if order and p > 1:
            work = cut_lineage(df.select(
                *[F.coalesce(num(df, c), F.lit(means[c])).alias(c) for c in cols],
                *[num(df, c).isNull().alias(f"__m_{c}") for c in order]))
            for it in range(int(cfg["max_iter"])):
                biggest = 0.0
                for c in order:
                    others = [o for o in cols if o != c]
                    vec = VectorAssembler(inputCols=others, outputCol="__x")
                    train = vec.transform(work.where(~q(f"__m_{c}")))
                    if linear:
                        m = LinearRegression(featuresCol="__x", labelCol=c, regParam=1e-6,
                                             elasticNetParam=0.0).fit(train)
                        step = {"column": c, "others": others, "coef": [float(v) for v in m.coefficients],
                                "intercept": float(m.intercept)}
                    else:
                        cls = DecisionTreeRegressor if "Decision" in cfg["estimator"] else RandomForestRegressor
                        m = cls(featuresCol="__x", labelCol=c, seed=42, maxDepth=8).fit(train)
                        path = shared_table_path(df.sparkSession, "iter-impute")
                        m.write().save(path)
                        step = {"column": c, "others": others, "model": path, "kind": cls.__name__}
                    steps.append(step)
                    new = self._predict(work, step)
                    delta = new.where(q(f"__m_{c}")).agg(F.max(F.abs(q("__p") - q(c)))).first()[0] or 0.0
                    biggest = max(biggest, delta / stds[c])
                    work = new.withColumn(c, F.when(q(f"__m_{c}"), q("__p")).otherwise(q(c))).drop("__p")
                work = cut_lineage(work)
                if biggest < float(cfg["tol"]):
                    break
        return {"columns": cols, "means": means, "steps": steps}

    @staticmethod
    def _predict(df, step):
        if "coef" in step:
            e = F.lit(step["intercept"])
            for o, w in zip(step["others"], step["coef"]):
                e = e + F.lit(w) * q(o)
            return df.withColumn("__p", e)
        from pyspark.ml import regression
        from pyspark.ml.feature import VectorAssembler
        cls = getattr(regression, step["kind"].replace("Regressor", "RegressionModel"))
        m = cls.load(step["model"]).setPredictionCol("__p")
        return m.transform(VectorAssembler(inputCols=step["others"], outputCol="__x").transform(df)).drop("__x")

    def apply(self, df, art):
        if "key_columns" in art:
            from ..plans.neighbour_rounds import apply_rounds
            return apply_rounds(df, art)
        cols = art["columns"]
        flags = {f"__m_{c}": num(df, c).isNull() for c in cols}
        out = df.select("*", *[e.alias(k) for k, e in flags.items()])
        out = with_columns(out, {c: F.coalesce(num(df, c), F.lit(art["means"][c])) for c in cols})
        for s in art["steps"]:
            c = s["column"]
            out = self._predict(out, s)
            out = out.withColumn(c, F.when(q(f"__m_{c}"), q("__p")).otherwise(q(c))).drop("__p")
        return out.select(*[q(c) for c in df.columns])
