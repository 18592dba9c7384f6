"""Chained filling of columns by the mean of the k nearest rows, round after round.

Step s fills one column from the rows that have it, near in all other columns as filled so far. The neighbours of a
column's last step are kept as a table and only what moved since is looked at again: a row that moved, or one of whose
neighbours moved, meets all donors; any other row keeps its neighbours unless a donor that moved is now nearer, so it
meets only these. Both give exactly the k nearest, ties to the smaller key. Values move less and less, so later rounds
cost little.

Every state of a row is one version, valid from a step (``start``) to the step of its next one (``stop``); a complete
row has a single version. New rows are led through the same steps against the donors as they were then.
``key_columns`` must identify a row and hold no null.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import num, q
from ..session import cut_lineage, shared_table_path
from .neighbors import knn_join


def _state(df: DataFrame, key: Sequence[str], cols: Sequence[str], order: Sequence[str], means: dict) -> DataFrame:
    """Rows filled by means, with what was missing and the step of each column's last move."""
    return df.select(*[q(k) for k in key], *[F.coalesce(num(df, c), F.lit(means[c])).alias(c) for c in cols],
                     *[num(df, c).isNull().alias(f"__m_{c}") for c in order], *[F.lit(0).alias(f"__at_{c}") for c in order])


def _moved(order: Sequence[str], column: str, seen: int):
    """Whether a coordinate other than ``column`` moved after step ``seen``."""
    at = [q(f"__at_{o}") > seen for o in order if o != column]
    return reduce(lambda a, b: a | b, at, F.lit(False))


def _neighbours(left: DataFrame, donors: DataFrame, cols, order, key, k, step, before: DataFrame | None) -> DataFrame:
    """(l_<key>, r_<key>, r_<column>, distance) of the k nearest donors of every left row."""
    c, others = step["column"], [o for o in cols if o != step["column"]]
    lk, rk = [f"l_{x}" for x in key], [f"r_{x}" for x in key]
    keep = lk + rk + [f"r_{c}", "distance"]

    def nearest(a, b):
        return knn_join(a, b, others, k, key, key, carry=[c]).select(*[q(x) for x in keep])
    if before is None:
        return cut_lineage(nearest(left, donors))
    moved = _moved(order, c, step["seen"])
    gone = donors.where(moved)
    touched = before.join(gone.select(*[q(x).alias(f"r_{x}") for x in key]), rk, "left_semi").select(*[q(f"l_{x}").alias(x) for x in key])
    again = cut_lineage(touched.unionByName(left.where(moved).select(*[q(x) for x in key])).distinct())
    kept = before.join(again.select(*[q(x).alias(f"l_{x}") for x in key]), lk, "left_anti").select(*[q(x) for x in keep])
    parts = kept
    if not again.isEmpty():
        parts = parts.unionByName(nearest(left.join(again, list(key), "left_semi"), donors))
    if not gone.isEmpty():
        parts = parts.unionByName(nearest(left.join(again, list(key), "left_anti"), gone))
    w = W.partitionBy(*[q(x) for x in lk]).orderBy("distance", *[q(x) for x in rk])
    return cut_lineage(parts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r"))


def _filled(state: DataFrame, pairs: DataFrame, key, step) -> DataFrame:
    """The state after the step. Means add up in the order of the values, so equal neighbours give equal means."""
    c = step["column"]
    values = F.sort_array(F.collect_list(q(f"r_{c}")))  # k values
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    new = pairs.groupBy(*[q(f"l_{x}").alias(x) for x in key]).agg(mean.alias("__new"))
    out = state.join(new, list(key), "left")
    move = q(f"__m_{c}") & F.col("__new").isNotNull() & (F.col("__new") != q(c))
    changed = {c: F.when(move, F.col("__new")).otherwise(q(c)), f"__at_{c}": F.when(move, F.lit(step["at"])).otherwise(q(f"__at_{c}"))}
    by = F.when(move, F.abs(F.col("__new") - q(c))).otherwise(0.0)
    return cut_lineage(out.select(*[(changed[x].alias(x) if x in changed else q(x)) for x in state.columns], by.alias("__by")))


def fit_rounds(df: DataFrame, key, cols, order, means, spreads, k: int, rounds: int, tol: float) -> dict:
    """Steps and the table of row versions. Ends early once no value moves by more than ``tol`` deviations."""
    state = cut_lineage(_state(df, key, cols, order, means))
    versions = [state.withColumn("start", F.lit(0))]
    steps: list[dict] = []
    before: dict[str, DataFrame] = {}
    seen: dict[str, int] = {}
    for _ in range(rounds):
        biggest = 0.0
        for c in order:
            step = {"column": c, "at": len(steps) + 1, "seen": seen.get(c, 0)}
            lacks = q(f"__m_{c}")
            before[c] = _neighbours(state.where(lacks), state.where(~lacks), cols, order, key, k, step, before.get(c))
            full = _filled(state, before[c], key, step)
            state = full.drop("__by")
            versions.append(state.where(q(f"__at_{c}") == step["at"]).withColumn("start", F.lit(step["at"])))
            biggest = max(biggest, (full.agg(F.max("__by")).first()[0] or 0.0) / spreads[c])
            seen[c] = step["at"]
            steps.append(step)
        if biggest <= tol:
            break
    path = shared_table_path(df.sparkSession, "neighbour-rounds")
    last = F.lead("start").over(W.partitionBy(*[q(x) for x in key]).orderBy("start"))  # one row for each step at most
    reduce(DataFrame.unionByName, versions).withColumn("stop", last).write.parquet(path)
    return {"steps": steps, "versions": path}


def apply_rounds(df: DataFrame, art: dict) -> DataFrame:
    """Rows that lack a value go through the steps; every other row and column stays as it is."""
    key, cols, order = art["key_columns"], art["columns"], art["order"]
    lacks = reduce(lambda a, b: a | b, [num(df, c).isNull() for c in cols], F.lit(False))
    state = _state(df.where(lacks), key, cols, cols, art["means"])
    if art["steps"]:
        state = cut_lineage(state)
        versions = df.sparkSession.read.parquet(art["versions"])
        before: dict[str, DataFrame] = {}
        for step in art["steps"]:
            c, s = step["column"], step["at"]
            donors = versions.where((F.col("start") < s) & (F.col("stop").isNull() | (F.col("stop") >= s)) & ~q(f"__m_{c}"))
            before[c] = _neighbours(state.where(q(f"__m_{c}")), donors, cols, order, key, art["n_neighbors"], step, before.get(c))
            state = _filled(state, before[c], key, step).drop("__by")
    wide = state.select(*[q(x) for x in key], *[q(c).alias(f"__f_{c}") for c in cols])
    out = df.join(wide, list(key), "left")
    return out.select(*[(F.coalesce(num(df, c), q(f"__f_{c}")).alias(c) if c in cols else q(c)) for c in df.columns])
