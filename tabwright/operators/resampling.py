"""Class balancing. Random methods are driven by key hashes, neighbour methods by knn_join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import Operator, is_numeric, nn, num, operator, q
from ..functions.expressions import hash_rank
from ..plans.neighbors import knn_join
from ..session import cut_lineage
from .splitting import class_totals, hash_order, key_text, smallest_per_class


def _check(df: DataFrame, target: str, keys: list[str]) -> list[str]:
    feats = [c for c in df.columns if c != target and c not in keys]
    bad = [c for c in feats if not is_numeric(df, c)]
    if bad:
        raise ValueError(f"resampling needs numeric features; not numeric: {bad}")
    return feats


class _Resampler(Operator):
    stateless = False
    train_only = True
    methods: dict = {}

    def fit(self, df, cfg):
        if cfg["method"] not in self.methods:
            raise ValueError(f"unknown method {cfg['method']!r}; known: {sorted(self.methods)}")
        target, keys = cfg["target_column"], list(cfg.get("key_columns") or [])
        if not keys:
            raise ValueError("resampling needs key_columns")
        return {**{k: v for k, v in cfg.items() if k not in ("key_columns",)}, "key_columns": keys,
                "features": _check(df, target, keys)}

    def apply(self, df, art):
        return getattr(self, self.methods[art["method"]])(df, art)


def _totals(df, art):
    cls = nn(df, art["target_column"]).cast("string")
    return cls, class_totals(df, cls)


def class_targets(totals: dict, strategy, over: bool) -> dict:
    """Rows wanted of each class.

    ``strategy``: auto (over: all but the largest class; under: all but the smallest), all, minority, majority, not minority, not majority; a
    ratio of smaller to larger class (two classes); or a dict of class -> rows.
    """
    small, large = min(totals, key=lambda k: (totals[k], str(k))), max(totals, key=lambda k: (totals[k], str(k)))
    if isinstance(strategy, dict):
        asked = {str(k): int(v) for k, v in strategy.items()}
        if lost := sorted(set(asked) - {str(k) for k in totals}):
            raise ValueError(f"sampling_strategy names unknown classes: {lost}")
        want = {k: asked.get(str(k), n) for k, n in totals.items()}
    elif isinstance(strategy, (int, float)) and not isinstance(strategy, bool):
        if len(totals) != 2:
            raise ValueError("a ratio needs two classes")
        want = dict(totals)
        if over:
            want[small] = int(strategy * totals[large])
        else:
            want[large] = int(totals[small] / strategy)
    else:
        chosen = {"all": list(totals), "minority": [small], "majority": [large], "not minority": [k for k in totals if k != small],
                  "not majority": [k for k in totals if k != large]}
        chosen["auto"] = chosen["not majority"] if over else chosen["not minority"]
        if (strategy or "auto") not in chosen:
            raise ValueError(f"unknown sampling_strategy {strategy!r}")
        end = totals[large] if over else totals[small]
        want = {k: end if k in chosen[strategy or "auto"] else n for k, n in totals.items()}
    if any((want[k] < n) if over else (want[k] > n) for k, n in totals.items()):
        raise ValueError(f"sampling_strategy asks for {'fewer' if over else 'more'} rows than a class has")
    return want


def random_unit(keys: list, seed: int):
    """Uniform number in [0, 1) from row keys."""
    return hash_rank(F.concat_ws("|", *keys), seed) / F.lit(float(1 << 52))


@operator("Oversampling", "OverSampling")
class Oversampling(_Resampler):
    description = "Raise smaller classes to the largest"
    defaults = {"method": "smote", "k_neighbors": 5, "random_state": 42, "sampling_strategy": "auto"}
    methods = {"random_over": "random_over", "random_over_sampler": "random_over", "smote": "smote",
               "adasyn": "adasyn", "borderline_smote": "borderline", "svm_smote": "svm_smote",
               "kmeans_smote": "kmeans_smote", "smote_tomek": "smote_tomek"}

    def random_over(self, df, art):
        cls, totals = _totals(df, art)
        want = class_targets(totals, art.get("sampling_strategy"), over=True)
        extra = {k: want[k] % n for k, n in totals.items()}
        marked, cond = smallest_per_class(df, cls, hash_order(art["key_columns"], int(art["random_state"])),
                                          extra, totals)
        times = F.lit(0)
        for k, n in totals.items():
            times = F.when(cls.eqNullSafe(F.lit(k)), F.lit(want[k] // n)).otherwise(times)
        copies = times + F.when(cond, F.lit(1)).otherwise(F.lit(0))
        return (marked.select(*[q(c) for c in df.columns], copies.alias("__m"))
                .withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__m")))).drop("__m", "__c"))

    # every synthetic method: seeds with a share of the needed rows, then steps towards neighbours

    def _synthesise(self, df, art, cls_name, seeds, weights_total, need, pool, tag=0, even=False, named=False):
        """``seeds`` (keys, features, w): split ``need`` points over seeds in proportion to w. ``named`` adds an id, also of equal points."""
        keys, feats, k = art["key_columns"], art["features"], int(art["k_neighbors"])
        seed = int(art["random_state"]) + tag
        pairs = knn_join(seeds, pool, feats, k, keys, keys, exclude_self=True, carry=feats)
        near = pairs.select(*[q(f"l_{c}").alias(c) for c in keys], "rank",
                            F.struct(*[q(f"r_{c}").alias(c) for c in feats]).alias("nb"))
        got = near.groupBy(*[q(c) for c in keys]).agg(F.array_sort(F.collect_list(F.struct("rank", "nb"))).alias("nbs"))
        base = cut_lineage(seeds.join(got, keys))  # the neighbour join runs once
        # integer shares: floor, then one more with probability of the remainder, by key hash
        share = F.lit(float(need)) * F.col("w") / F.lit(float(weights_total))
        floor = F.floor(share)
        if even:  # equal shares: the remainder goes to the first seeds in hash order, so the count is exact
            from .splitting import smallest
            n = base.count()
            n_new = F.lit(need // n) + smallest(base, hash_order(keys, seed + 7), need % n, n).cast("int")
        else:
            n_new = floor + (random_unit([q(c).cast("string") for c in keys], seed + 7) < share - floor).cast("bigint")
        rows = (base.withColumn("__n", n_new).where("__n > 0")
                .withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))))
        key_parts = [q(c).cast("string") for c in keys] + [F.col("__i").cast("string")]
        pick = F.floor(random_unit(key_parts, seed + 11) * F.size("nbs")).cast("int")
        rows = rows.withColumn("__nb", F.get("nbs", pick)["nb"]).withColumn("__u", random_unit(key_parts, seed + 13))
        new = {c: num(df, c) + F.col("__u") * (F.col("__nb")[c].cast("double") - num(df, c)) for c in feats}
        out = []
        for c in df.columns:
            if c in feats:
                out.append(new[c].cast("double").alias(c))
            elif c == art["target_column"]:
                out.append(F.lit(cls_name).cast(df.schema[c].dataType).alias(c))
            else:
                out.append(F.lit(None).cast(df.schema[c].dataType).alias(c))
        if named:
            out.append(F.xxhash64(F.lit(str(cls_name)), *[q(c) for c in keys], "__i", F.lit(tag)).alias("__id"))
        return rows.select(*out)

    def _run(self, df, art, make_seeds, even=True, named=False):
        cls, totals = _totals(df, art)
        want = class_targets(totals, art.get("sampling_strategy"), over=True)
        feats = art["features"]
        parts = [df.select(*[(num(df, c).alias(c) if c in feats else q(c)) for c in df.columns])]
        if named:
            text = F.concat_ws("|", *[F.coalesce(q(c).cast("string"), F.lit("")) for c in df.columns])
            parts = [parts[0].withColumn("__id", F.xxhash64(text))]
        for i, (k, n) in enumerate(totals.items()):
            need = want[k] - n
            if need <= 0 or n < 2:
                continue
            mine = df.where(cls.eqNullSafe(F.lit(k)))
            seeds, total = make_seeds(df, art, k, mine, cls)
            if not total:
                continue
            parts.append(self._synthesise(df, art, k, seeds, total, need, mine, tag=101 * i, even=even, named=named))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _every_row(df, art, k, mine, cls):
        return mine.withColumn("w", F.lit(1.0)), mine.count()

    def smote(self, df, art):
        return self._run(df, art, self._every_row)

    def _danger(self, df, art, k, mine, cls, m):
        """Share of other classes among the m nearest rows of each row of class k."""
        keys = art["key_columns"]
        pool = df.withColumn("__y", cls)
        pairs = knn_join(mine, pool, art["features"], m, keys, keys, exclude_self=True, carry=["__y"])
        other = F.avg((~F.col("r___y").eqNullSafe(F.lit(k))).cast("double"))
        t = pairs.groupBy(*[q(f"l_{c}").alias(c) for c in keys]).agg(other.alias("__d"))
        return cut_lineage(mine.join(t, keys))

    def adasyn(self, df, art):
        def seeds(d, a, k, mine, cls):
            t = self._danger(d, a, k, mine, cls, int(a["k_neighbors"])).withColumn("w", F.col("__d"))
            total = t.agg(F.sum("w")).first()[0]
            return t, total
        return self._run(df, art, seeds, even=False)

    def borderline(self, df, art):
        def seeds(d, a, k, mine, cls):
            t = self._danger(d, a, k, mine, cls, int(a.get("m_neighbors", 10)))
            t = t.where((F.col("__d") >= 0.5) & (F.col("__d") < 1.0)).withColumn("w", F.lit(1.0))
            return t, t.count()
        return self._run(df, art, seeds)

    def svm_smote(self, df, art):
        """Seeds near a linear boundary: rows whose LinearSVC margin is below one."""
        def seeds(d, a, k, mine, cls):
            from pyspark.ml.classification import LinearSVC
            from pyspark.ml.feature import VectorAssembler
            vec = VectorAssembler(inputCols=a["features"], outputCol="__x", handleInvalid="skip")
            data = vec.transform(d.withColumn("__y", cls.eqNullSafe(F.lit(k)).cast("double")))
            model = LinearSVC(featuresCol="__x", labelCol="__y", regParam=0.01, maxIter=50).fit(data)
            w, b = [float(v) for v in model.coefficients], float(model.intercept)
            margin = F.lit(b)
            for c, v in zip(a["features"], w):
                margin = margin + F.lit(v) * num(d, c)
            t = mine.where(margin <= 1.0).withColumn("w", F.lit(1.0))
            n = t.count()
            return (t, n) if n else (mine.withColumn("w", F.lit(1.0)), mine.count())
        return self._run(df, art, seeds)

    def kmeans_smote(self, df, art):
        """Seeds in clusters where the class is common, sparser clusters weighted more."""
        def seeds(d, a, k, mine, cls):
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.feature import VectorAssembler
            vec = VectorAssembler(inputCols=a["features"], outputCol="__x", handleInvalid="skip")
            data = vec.transform(d.withColumn("__y", cls.eqNullSafe(F.lit(k)).cast("double")))
            model = KMeans(k=int(a.get("n_clusters", 8)), seed=int(a["random_state"]), featuresCol="__x",
                           predictionCol="__g").fit(data)
            g = model.transform(data)
            per = g.groupBy("__g").agg(F.avg("__y").alias("share"), F.sum("__y").alias("n")).collect()
            ok = {r["__g"]: r["n"] for r in per if r["share"] > 0 and r["n"] > 1}
            best = max((r["share"] for r in per if r["n"] > 1), default=0)
            chosen = [r["__g"] for r in per if r["__g"] in ok and r["share"] >= min(0.5, best)]
            t = g.where((F.col("__y") == 1.0) & F.col("__g").isin(chosen))
            weight = F.lit(0.0)
            for c in chosen:
                weight = F.when(F.col("__g") == c, F.lit(1.0 / ok[c])).otherwise(weight)
            t = t.withColumn("w", weight)
            return t.drop("__x", "__y", "__g"), float(len(chosen))
        return self._run(df, art, seeds, even=False)

    def smote_tomek(self, df, art):
        # synthetic rows get ids of their own, also where points are equal, so that links can be found
        named = self._run(df, art, self._every_row, named=True)
        cleaned = tomek_filter(named, art["target_column"], art["features"], ["__id"], both=True)
        return cleaned.drop("__id")


def nearest_one(df: DataFrame, target: str, feats: list[str], keys: list[str]) -> DataFrame:
    """(l_key, r_key, l_y, r_y): every row's nearest other row."""
    d = df.withColumn("__y", nn(df, target).cast("string"))
    return knn_join(d, d, feats, 1, keys, keys, exclude_self=True, carry=["__y"])


def tomek_filter(df: DataFrame, target: str, feats: list[str], keys: list[str], both: bool = False,
                 keep: str | None = None) -> DataFrame:
    """Drop members of mutual nearest pairs of different classes, sparing class ``keep``."""
    pairs = cut_lineage(nearest_one(df, target, feats, keys))
    fwd = pairs.select(*[q(f"l_{c}").alias(f"a_{c}") for c in keys], *[q(f"r_{c}").alias(f"b_{c}") for c in keys],
                       F.col("r___y").alias("by"))
    back = pairs.select(*[q(f"l_{c}").alias(f"b_{c}") for c in keys], *[q(f"r_{c}").alias(f"a_{c}") for c in keys],
                        F.col("r___y").alias("ay"))
    links = fwd.join(back, [f"a_{c}" for c in keys] + [f"b_{c}" for c in keys]).where("ay <> by")
    if not both:
        links = links.where(F.col("ay") != F.lit(keep))
    drop = links.select(*[q(f"a_{c}").alias(c) for c in keys]).distinct()
    return df.join(drop, keys, "left_anti")


@operator("Undersampling", "UnderSampling")
class Undersampling(_Resampler):
    description = "Lower larger classes towards the smallest"
    defaults = {"method": "random_under", "n_neighbors": 3, "version": 1, "kind_sel": "all", "replacement": False,
                "random_state": 42, "sampling_strategy": "auto"}
    methods = {"random_under": "random_under", "random_under_sampling": "random_under", "nearmiss": "near_miss",
               "tomek_links": "tomek", "edited_nearest_neighbours": "edited"}

    def random_under(self, df, art):
        cls, totals = _totals(df, art)
        want = class_targets(totals, art.get("sampling_strategy"), over=False)
        order = hash_order(art["key_columns"], int(art["random_state"]))
        if art["replacement"]:
            return self._with_replacement(df, art, cls, totals, want)
        marked, cond = smallest_per_class(df, cls, order, want, totals)
        return marked.where(cond).select(*[q(c) for c in df.columns])

    def _with_replacement(self, df, art, cls, totals, want):
        """Draw slots per class: each slot names a random position in the class's hash order."""
        from ..plans.ordered import running_totals
        out = df.where(F.lit(False))
        for i, (k, n) in enumerate(totals.items()):
            mine = df.where(cls.eqNullSafe(F.lit(k)))
            low = want[k]
            if n == low:
                out = out.unionByName(mine)
                continue
            h = hash_rank(key_text(art["key_columns"]), int(art["random_state"])).cast("double")
            # rows with one hash take turns by key
            t = mine.withColumn("__h", h).withColumn("__r", F.row_number().over(W.partitionBy("__h").orderBy(*[q(c) for c in art["key_columns"]])))
            pos = running_totals(t.groupBy("__h").agg(F.count("*").alias("n")), "__h", ["n"])
            slots = df.sparkSession.range(low).select(F.floor(
                random_unit([F.col("id").cast("string")], int(art["random_state"]) + 31 * i) * n).alias("p"))
            slots = slots.groupBy("p").agg(F.count("*").alias("m"))
            placed = t.join(pos.select("__h", (F.col("cum_n") - F.col("n")).alias("__b")), "__h").withColumn("p", F.col("__b") + F.col("__r") - 1)
            rows = placed.join(slots, "p").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("m"))))
            out = out.unionByName(rows.select(*[q(c) for c in df.columns]))
        return out

    def tomek(self, df, art):
        _, totals = _totals(df, art)
        small = min(totals, key=lambda k: (totals[k], str(k)))
        return tomek_filter(df, art["target_column"], art["features"], art["key_columns"], keep=small)

    def edited(self, df, art):
        """Drop rows whose neighbours disagree: any of them (all) or their majority (mode)."""
        cls, totals = _totals(df, art)
        small = min(totals, key=lambda k: (totals[k], str(k)))
        keys, k = art["key_columns"], int(art["n_neighbors"])
        d = df.withColumn("__y", cls)
        pairs = knn_join(d.where(F.col("__y") != F.lit(small)), d, art["features"], k, keys, keys,
                         exclude_self=True, carry=["__y"])
        mine = d.select(*[q(c).alias(f"l_{c}") for c in keys], F.col("__y").alias("ly"))
        votes = pairs.join(mine, [f"l_{c}" for c in keys])
        agree = (F.col("r___y") == F.col("ly")).cast("int")
        bad = F.min(agree) == 0 if art["kind_sel"] == "all" else F.avg(agree.cast("double")) < 0.5
        drop = (votes.groupBy(*[q(f"l_{c}").alias(c) for c in keys]).agg(bad.alias("__bad")).where("__bad")
                .select(*[q(c) for c in keys]))
        return df.join(drop, keys, "left_anti")

    def near_miss(self, df, art):
        """Keep the larger-class rows by mean distance to the smallest class.

        1: nearest k of it; 2: farthest k of it; 3: rows among the neighbours of the smallest
        class, those with the largest mean distance.
        """
        cls, totals = _totals(df, art)
        small = min(totals, key=lambda k: (totals[k], str(k)))
        want = class_targets(totals, art.get("sampling_strategy"), over=False)
        keys, k = art["key_columns"], int(art["n_neighbors"])
        feats, version = art["features"], int(art["version"])
        rare = df.where(cls.eqNullSafe(F.lit(small)))
        out = rare
        for c in totals:
            if c == small:
                continue
            low = want[c]
            mine = df.where(cls.eqNullSafe(F.lit(c)))
            if low == totals[c]:
                out = out.unionByName(mine)
                continue
            if version == 2:
                scored = mean_farthest(mine, rare, feats, k, keys)
            else:
                pool = mine
                if version == 3:
                    near = knn_join(rare, mine, feats, int(art.get("n_neighbors_ver3", 3)), keys, keys)
                    pool = mine.join(near.select(*[q(f"r_{x}").alias(x) for x in keys]).distinct(), keys, "left_semi")
                p = knn_join(pool, rare, feats, k, keys, keys)
                scored = p.groupBy(*[q(f"l_{x}").alias(x) for x in keys]).agg(F.avg("distance").alias("__s"))
            score = F.col("__s") if version != 3 else -F.col("__s")
            ranked = cut_lineage(scored.withColumn("__v", score))
            from .splitting import smallest
            n = ranked.count()
            take = smallest(ranked, [F.col("__v")] + hash_order(keys, 0), min(low, n), n)
            out = out.unionByName(mine.join(ranked.where(take).select(*[q(x) for x in keys]), keys, "left_semi")
                                  .select(*[q(x) for x in df.columns]))
        return out


def mean_farthest(left: DataFrame, right: DataFrame, feats: list[str], k: int, keys: list[str]) -> DataFrame:
    """Mean distance to the k farthest right rows."""
    p = knn_join(left, right, feats, k, keys, keys, metric="-euclidean")
    return p.groupBy(*[q(f"l_{x}").alias(x) for x in keys]).agg(F.avg("distance").alias("__s"))
