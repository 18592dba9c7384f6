"""Repeatable splits of exact size."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import Operator, Splits, nn, operator, q
from ..functions.expressions import hash_rank
from ..plans.ordered import segmented_totals
from ..plans.quantiles import order_statistics
from ..session import cut_lineage

#: hashes of hash_order are below this
HASH_RANGE = float(1 << 52)


def key_text(keys: list[str]) -> Column:
    return F.concat_ws("|", *[q(k).cast("string") for k in keys])


def hash_order(keys: list[str], seed: int) -> list[Column]:
    """Hash of the key, with a second and third hash for ties."""
    return [hash_rank(key_text(keys), seed + i * 1_000_003) for i in range(3)]


def smallest(df: DataFrame, order: list[Column], take: int, total: int | None = None) -> Column:
    """Condition that holds for exactly ``take`` rows, the first by ``order``.

    The boundary is an exact order statistic, so there is no global sort; rows equal to it are
    settled by the following expressions.
    """
    total = df.count() if total is None else total
    if take <= 0:
        return F.lit(False)
    if take >= total:
        return F.lit(True)
    if not order:
        raise ValueError("the order columns do not tell rows apart")
    e = order[0].cast("double")
    _, found = order_statistics(df, [e], [[take / total]], lambda i, n: [take - 1])
    cut = found[0][take - 1]
    below, ties = df.agg(F.count_if(e < F.lit(cut)), F.count_if(e == F.lit(cut))).first()
    if below + ties == take:
        return e <= F.lit(cut)
    rest = smallest(df.where(e == F.lit(cut)), order[1:], take - below, ties)
    return (e < F.lit(cut)) | ((e == F.lit(cut)) & rest)


def smallest_per_class(df: DataFrame, cls: Column, order: list[Column], take: dict, totals: dict
                       ) -> tuple[DataFrame, Column]:
    """As ``smallest`` inside every class. Returns the frame to filter and the condition on it."""
    marked, conds = smallest_in_classes(df, cls, order, [take], totals)
    return marked, conds[0]


def smallest_in_classes(df: DataFrame, cls: Column, order: list[Column], takes: list[dict], totals: dict
                        ) -> tuple[DataFrame, list[Column]]:
    """Conditions that hold for exactly ``takes[i][class]`` rows of every class, the first by ``order``.

    Hashes are spread evenly, so the last row to take lies within a few standard deviations of its
    share of the hash range: one pass counts the rows below that stretch, for all classes and cuts at
    once, and keeps only those inside it to rank. Classes whose hashes are not spread so (keys that repeat) are ranked
    whole, in slices. The cuts are a table with a row for each class, not expressions in the plan.
    """
    spark = df.sparkSession
    wanted, all_of = [], []
    for i, take in enumerate(takes):
        for k, n in totals.items():
            t = min(int(take[k]), n)
            if t == n:
                all_of.append((k, i))
            elif t > 0:
                p = t / n
                wide = 8 * math.sqrt(max(p * (1 - p), 1 / n) / n) + 16 / n
                wanted.append((k, i, t, max(0.0, p - wide) * HASH_RANGE, min(1.0, p + wide) * HASH_RANGE))
    cuts = None
    todo, whole = spark.createDataFrame(wanted, "__ck string, __which int, __take long, __lo double, __hi double"), False
    while wanted:
        found = cut_lineage(_class_cuts(df, cls, order, todo, len(wanted), whole))
        odd = found.where(F.col("cum") != F.col("__take")).limit(1).count()
        if odd:
            raise ValueError("the order columns do not tell rows apart")
        cuts = found if cuts is None else cuts.unionByName(found)
        have = {(r["__ck"], r["__which"]) for r in found.select("__ck", "__which").collect()}
        wanted = [w for w in wanted if w[:2] not in have]
        if wanted and whole:
            raise ValueError("classes changed while they were counted")
        todo, whole = spark.createDataFrame([(*w[:3], -math.inf, math.inf) for w in wanted], "__ck string, __which int, __take long, __lo double, __hi double"), True
    at = F.struct(*[o.alias(f"o{j}") for j, o in enumerate(order)])
    kind = df.select(at.alias("a")).schema["a"].dataType
    none = spark.createDataFrame(all_of, "__ck string, __which int").withColumn("__cut", F.lit(None).cast(kind))
    table = none if cuts is None else none.unionByName(cuts.select("__ck", "__which", F.col("__at").cast(kind).alias("__cut")))
    conds = []
    for i in range(len(takes)):
        mine = table.where(F.col("__which") == i).select(F.col("__ck").alias(f"__ck{i}"), F.col("__cut").alias(f"__cut{i}"), F.lit(True).alias(f"__in{i}"))
        df = df.join(F.broadcast(mine), cls.eqNullSafe(F.col(f"__ck{i}")), "left")  # a row for each class, checked by class_totals
        conds.append(F.coalesce(F.col(f"__in{i}") & (F.col(f"__cut{i}").isNull() | (at <= F.col(f"__cut{i}"))), F.lit(False)))
    return df, conds


def _class_cuts(df: DataFrame, cls: Column, order: list[Column], wanted: DataFrame, n: int, whole: bool) -> DataFrame:
    """(class, which, take, the last row's order, rows up to it) where the last row lies inside its bracket."""
    rows = df.select(cls.alias("__c"), F.struct(*[o.alias(f"o{j}") for j, o in enumerate(order)]).alias("__o"), order[0].cast("double").alias("__h"))
    hit = rows.join(F.broadcast(wanted), F.col("__c").eqNullSafe(F.col("__ck"))).where(F.col("__h") <= F.col("__hi"))
    keys = ["__ck", "__which", "__take"]
    # rows below the bracket become one row of each task
    counts = hit.groupBy(*keys, F.when(F.col("__h") >= F.col("__lo"), F.col("__o")).alias("__at")).agg(F.count("*").alias("n"))
    if whole:
        run = segmented_totals(counts, keys, "__at", ["n"]).withColumnRenamed("cum_n", "cum")
    else:
        w = W.partitionBy(*keys).orderBy(F.col("__at").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
        run = counts.withColumn("cum", F.sum("n").over(w))
    return run.where(F.col("__at").isNotNull() & (F.col("cum") - F.col("n") < F.col("__take")) & (F.col("__take") <= F.col("cum"))).select(*keys, "__at", "cum")


def class_totals(df: DataFrame, cls: Column, limit: int = 100_000) -> dict:
    rows = df.groupBy(cls.alias("k")).agg(F.count("*").alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} classes")
    return {r["k"]: r["n"] for r in sorted(rows, key=lambda r: (r["k"] is None, str(r["k"])))}


def allocate(totals: dict, draws: int) -> dict:
    """Draws per class in proportion, leftovers to the largest remainders."""
    n = sum(totals.values())
    exact = {k: draws * v / n for k, v in totals.items()}
    out = {k: int(math.floor(v)) for k, v in exact.items()}
    short = draws - sum(out.values())
    for k in sorted(totals, key=lambda k: (-(exact[k] - out[k]), str(k)))[:short]:
        out[k] += 1
    return out


def split_sizes(n: int, test: float, validation: float) -> tuple[int, int]:
    if not (0 < test < 1) or not (0 <= validation < 1) or test + validation >= 1:
        raise ValueError("test_size and validation_size must be shares that leave rows for training")
    n_test = math.ceil(n * test - 1e-9)
    n_val = math.ceil((n - n_test) * (validation / (1 - test)) - 1e-9) if validation else 0
    return n_test, n_val


@operator("TrainTestSplitter", "Split")
class TrainTestSplitter(Operator):
    """Split by a hash of the row key: the same rows on every run and any partitioning."""

    description = "Train, test and optional validation parts of exact size"
    defaults = {"test_size": 0.2, "validation_size": 0.0, "random_state": 42, "shuffle": True, "stratify": False}
    stateless = False
    train_only = True

    def fit(self, df, cfg):
        keys = list(cfg.get("key_columns") or [])
        order = list(cfg.get("order_by") or [])
        if cfg["shuffle"] and not keys:
            raise ValueError("TrainTestSplitter needs key_columns")
        if not cfg["shuffle"] and not order:
            raise ValueError("an unshuffled split needs order_by")
        return {"key_columns": keys, "order_by": order, "target_column": cfg.get("target_column"),
                **{k: cfg[k] for k in self.defaults}}

    def apply(self, df, art):
        return df

    def split(self, df: DataFrame, art: dict) -> Splits:
        n = df.count()
        n_test, n_val = split_sizes(n, float(art["test_size"]), float(art["validation_size"]))
        if not art["shuffle"]:
            order = [_numeric_order(df, c) for c in art["order_by"]]
            train_cond = smallest(df, order, n - n_test - n_val, n)
            val_cond = smallest(df, order, n - n_test, n)
            return Splits(df.where(train_cond), df.where(~val_cond),
                          df.where(~train_cond & val_cond) if n_val else None)
        if art["stratify"] and art.get("target_column"):
            cls = nn(df, art["target_column"]).cast("string")
            totals = class_totals(df, cls)
            if min(totals.values()) >= 2:
                return self._stratified(df, art, cls, totals, n_test, n_val)
            warnings.warn("a class has fewer than two rows: split is not stratified")
        order = hash_order(art["key_columns"], int(art["random_state"]))
        test = smallest(df, order, n_test, n)
        if not n_val:
            return Splits(df.where(~test), df.where(test))
        upto = smallest(df, order, n_test + n_val, n)
        return Splits(df.where(~upto), df.where(test), df.where(upto & ~test))

    def _stratified(self, df, art, cls, totals, n_test, n_val):
        order = hash_order(art["key_columns"], int(art["random_state"]))
        t1 = allocate(totals, n_test)
        left = {k: totals[k] - t1[k] for k in totals}
        t2 = {k: t1[k] + v for k, v in allocate(left, n_val).items()} if n_val else t1
        cols = [q(c) for c in df.columns]
        marked, (test, *more) = smallest_in_classes(df, cls, order, [t1, t2] if n_val else [t1], totals)
        part = lambda c: marked.where(c).select(*cols)
        if not n_val:
            return Splits(part(~test), part(test))
        return Splits(part(~more[0]), part(test), part(more[0] & ~test))


def _numeric_order(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType.typeName()
    if t in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(q(c).cast("timestamp")).cast("double")
    return q(c).cast("double")


# --- folds -----------------------------------------------------------------------------------

def hash_folds(df: DataFrame, keys: list[str], k: int, seed: int = 42, stratify: str | None = None,
               out: str = "fold") -> DataFrame:
    """Fold number per row from the key hash; sizes are even in expectation, with no shuffle.

    Stratified folds use the same hash salted by the class, so every class is spread evenly.
    """
    text = key_text(keys)
    if stratify:
        text = F.concat_ws("#", text, nn(df, stratify).cast("string"))
    return df.withColumn(out, F.pmod(hash_rank(text, seed), F.lit(k)).cast("int"))


def exact_folds(df: DataFrame, keys: list[str], k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds whose sizes differ by one row at most: cuts of the hash order at exact ranks."""
    n = df.count()
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    order = hash_order(keys, seed)
    e, acc = F.lit(k - 1), n
    for i in range(k - 2, -1, -1):
        acc = sum(sizes[:i + 1])
        e = F.when(smallest(df, order, acc, n), F.lit(i)).otherwise(e)
    return df.withColumn(out, e)


def time_blocks(df: DataFrame, time_column: str, k: int, out: str = "block") -> DataFrame:
    """Blocks 0..k in time order for an expanding-window split: fold i trains on blocks below i
    and tests on block i. Cut at exact ranks of the time column, so equal times stay together."""
    n = df.count()
    e = _numeric_order(df, time_column)
    size = n // (k + 1)
    ranks = [n - size * (k - i) for i in range(k)]
    _, found = order_statistics(df, [e], [[r / n for r in ranks]], lambda i, m: [min(r, m - 1) for r in ranks])
    pos = F.lit(0)
    for i, r in enumerate(ranks):
        pos = F.when(e >= F.lit(found[0][min(r, n - 1)]), F.lit(i + 1)).otherwise(pos)
    return df.withColumn(out, pos)
