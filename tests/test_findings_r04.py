"""Findings of round 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.core import fit
from tabwright.models import counted_forest as CF, evaluation as EV, learners as L
from tabwright.plans import neighbors as N


def gappy(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [None if rng.random() < 0.3 else float(rng.integers(0, 6)) if j < 2 else float(np.round(rng.normal(), 1)) for j in range(3)]
        v[0] = float("inf") if i % 50 == 0 else v[0]
        v[1] = float("nan") if i % 60 == 0 else v[1]
        rows.append((i if i % 90 else None, i // 2, *v))
    return spark.createDataFrame(rows, "id long, pair long, a double, b double, c double")


@pytest.mark.parametrize("metric,key,cols,broadcast_bytes", [("manhattan", "id", "ab", 16 << 20), ("euclidean", "pair", "ac", 0)])
def test_missing_coordinates_by_pattern(spark, monkeypatch, metric, key, cols, broadcast_bytes):
    """Rows that meet by the coordinates both have find the same neighbours at the same distances."""
    left, right, got = gappy(spark, 120, 3), gappy(spark, 500, 4).withColumn("w", F.col("id") * 2), []
    for rows in (10**9, 0):
        monkeypatch.setattr(N, "PATTERN_ROWS", rows)
        out = N.knn_join(left, right, list(cols), 4, [key], [key], metric=metric, missing=True, exclude_self=key == "id", carry=["w"], broadcast_bytes=broadcast_bytes, leaf_rows=64)
        out = out if key == "id" else out.drop("r_w")  # the rows of one key are equally near
        got.append(sorted(map(str, out.collect())))
    assert got[0] == got[1] and len(got[0]) > 200


def test_large_tables_meet_by_pattern(spark, monkeypatch):
    """Every left row misses x, so many right rows are equally near: they are thinned, and no join looks at missing coordinates."""
    right = spark.range(N.PATTERN_ROWS + 2_000).select("id", F.col("id").cast("double").alias("x"), F.when(F.col("id") % 13 != 0, (F.col("id") % 25).cast("double")).alias("y"), (F.col("id") % 31).cast("double").alias("z"))
    left = right.where("id % 9 = 0").select("id", F.lit(None).cast("double").alias("x"), "y", "z")
    seen, plain = [], N._broadcast_join
    monkeypatch.setattr(N, "_broadcast_join", lambda lt, rt, *more: seen.append((more[5], rt.count())) or plain(lt, rt, *more))
    got = N.knn_join(left, right, ["x", "y", "z"], 2, ["id"], ["id"], missing=True, carry=["x"])
    assert seen and not any(missing for missing, _ in seen) and max(n for _, n in seen) <= 2 * 26 * 31
    first = {(r.y, r.z): r.id for r in right.where("id % 13 <> 0").groupBy("y", "z").agg(F.min("id").alias("id")).collect()}
    at = {r.l_id: r.r_id for r in got.where("rank = 1 and distance = 0").collect()}
    whole = left.where("y is not null").collect()
    # a donor without y is as near if its z is the same: the smaller key comes first
    lone = {r.z: r.id for r in right.where("id % 13 = 0").groupBy("z").agg(F.min("id").alias("id")).collect()}
    assert all(at[r.id] == min(first[r.y, r.z], lone[r.z]) for r in whole) and len(whole) > 1000


def noisy(spark, n):
    r = spark.range(n).select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1_000)).cast("double").alias(c) for i, c in enumerate("uvw")])
    r = r.select(F.when(F.col("u") > 0, F.floor(F.col("u") / 20)).alias("a"), F.col("v").alias("b"), F.lit(7.0).alias("c"), (F.col("w") > 300).alias("n"), "id")
    return r.select("a", "b", "c", F.when(F.col("id") % 50 != 0, F.when(F.col("n"), (F.col("a") > 25).cast("int")).otherwise((F.col("b") > 600).cast("int"))).alias("y"))


def test_forest_over_counted_rows(spark, monkeypatch):
    """Importances are those of Spark's forest but for the draw, and no learner reads the rows."""
    df = noisy(spark, 12_000).persist()
    cfg = dict(columns=["a", "b", "c"], target_column="y", method="rfe", estimator="random_forest", problem_type="classification", n_features_to_select=3)
    want = fit("ModelBasedSelection", df, **cfg)["importances"]
    monkeypatch.setattr(CF, "COUNTED_ROWS", 1_000)
    monkeypatch.setattr(L, "fit_model", None)
    got = fit("ModelBasedSelection", df, **cfg)
    assert all(abs(got["importances"][c] - want[c]) < 0.03 for c in "abc") and got["importances"]["c"] == 0.0
    kept = fit("ModelBasedSelection", df, **{**cfg, "n_features_to_select": 1})
    assert kept["selected_columns"] == ["a"] and kept["importances"] == {"a": 1.0}
    cells = CF.counted(df, ["a", "b", "c"], "y")
    assert cells.counts.sum() == df.where("y is not null").count() and len(cells.only(["c"]).bins) == 1
    monkeypatch.setattr(CF, "CELLS", 100)  # too many cells: Spark's forest, as before
    assert CF.counted(df, ["a", "b", "c"], "y") is None


def test_grid_comes_by_range(spark, monkeypatch):
    """Empty cells of a partition come range by range, so files hold few class names at a time."""
    monkeypatch.setattr(EV, "GRID_RANGE", 4)
    d = spark.range(400).select((F.col("id") % 40).alias("y"), (F.col("id") % 7).alias("p"))
    grid = EV.confusion_matrix(d, "y", "p").withColumn("at", F.monotonically_increasing_id()).persist()
    rows = [(r.actual, r.predicted, r["count"], r.at) for r in grid.collect()]
    code = {c: i for i, c in enumerate(sorted({a for a, *_ in rows}))}
    parts = {}
    for _, p, n, at in sorted((r for r in rows if not r[2]), key=lambda r: r[3]):
        parts.setdefault(at >> 33, []).append(code[p] // 4)
    assert len(rows) == 1600 and sum(r[2] for r in rows) == 400 and max(map(len, parts.values())) > 20
    assert all(x == sorted(x) for x in parts.values())
