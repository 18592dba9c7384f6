"""The physical shapes against brute force, with limits small enough to take the large-table path."""

import math

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from tabwright.operators.outliers import shortest_half_centre
from tabwright.operators.splitting import hash_order, smallest, smallest_in_classes, smallest_per_class
from tabwright.plans.neighbors import Pivots, block_top_k, knn_join, leaf_count
from tabwright.core import fit_apply
from tabwright.plans.ordered import running_totals, segmented_totals, split_hot_groups
from tabwright.plans.quantiles import grouped_quantiles, quantiles_of
from tabwright.plans.textorder import number_sorted
from tabwright.profiling import correlations
from tabwright.profiling.correlations import kendall_tau, signed_pairs, signed_pairs_by_digits


def frame(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(None if v is None else v for v in r) for r in zip(*cols.values())], names)


@pytest.mark.parametrize("limit", [100_000, 60])
def test_quantiles_match_numpy(spark, limit):
    rng = np.random.RandomState(0)
    a = rng.normal(size=3000)
    b = np.where(rng.rand(3000) < 0.4, 7.0, rng.randint(0, 50, 3000)).astype(float)  # a third in one value
    d = frame(spark, a=a.tolist(), b=b.tolist())
    probs = [0.0, 0.05, 0.33, 0.5, 0.99, 1.0]
    counts, got = quantiles_of(d, [F.col("a"), F.col("b")], probs, limit=limit)
    assert counts == [3000, 3000]
    assert np.allclose(got[0], np.quantile(a, probs)) and np.allclose(got[1], np.quantile(b, probs))
    _, inv = quantiles_of(d, [F.col("a")], [0.25, 0.5], "averaged_inverted_cdf", limit)
    assert np.allclose(inv[0], np.quantile(a, [0.25, 0.5], method="averaged_inverted_cdf"))


def test_grouped_quantiles_hot_group(spark):
    g = ["hot"] * 400 + ["x"] * 40 + [None] * 10
    v = [float((i * 37) % 101) for i in range(450)]
    d = spark.createDataFrame(list(zip(g, v)), "g string, v double")
    got = {r["g"]: r["v_q"] for r in grouped_quantiles(d, "g", ["v"], [0.5, 0.9], hot_rows=100).collect()}
    for key in ("hot", "x", None):
        want = np.quantile([b for a, b in zip(g, v) if a == key], [0.5, 0.9])
        assert np.allclose(got[key], want)


def test_running_totals_over_many_ranges(spark):
    v = sorted(set((i * 7919) % 10007 for i in range(2500)))
    d = spark.createDataFrame([(float(x), 1 + x % 3) for x in v], "v double, n long")
    rows = sorted(running_totals(d, "v", ["n"], rows_per_bucket=100).collect(), key=lambda r: r["v"])
    assert [r["cum_n"] for r in rows] == np.cumsum([1 + x % 3 for x in v]).tolist()
    assert [r["next_value"] for r in rows] == [float(x) for x in v[1:]] + [None]


@pytest.mark.parametrize("window", [2, 9, 70])
def test_slices_of_hot_groups(spark, window):
    rng = np.random.RandomState(8)
    words = [None, "a", "b", "é", "zz"]
    rows = [(i, ["hot", None, f"g{i % 9}"][min(2, rng.randint(0, 4))], words[rng.randint(0, 5)], float(rng.randint(0, 3)), int(rng.randint(0, 1000))) for i in range(900)]
    d = spark.createDataFrame(rows, "id long, g string, t string, u double, v long").withColumn("m", F.create_map(F.lit("k"), F.col("v"))).repartition(5)
    got = fit_apply("RollingAggregate", d, columns=["v"], window=window, aggregations=["sum"], group_by=["g"], sort_by=["t", "u", "id"], hot_rows=50)
    assert got.columns == d.columns + [f"v_roll_sum_{window}"]
    want, groups = {}, {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[3], r[0])):
        past = groups.setdefault(r[1], [])
        past.append(r[4])
        want[r[0]] = float(sum(past[-window:]))
    assert {r["id"]: r[-1] for r in got.collect()} == want
    cut, _, _ = split_hot_groups(d, ["g"], ["t", "u", "id"], window - 1, 50)
    sizes = {(r["g"], r["__slice"]): r["count"] for r in cut.where(~F.col("__halo")).groupBy("g", "__slice").count().collect()}
    whole = {g: sum(n for k, n in sizes.items() if k[0] == g) for g, _ in sizes}
    assert max(sizes.values()) < 110 and sum(sizes.values()) == 900 and all((k[1] == 0) or whole[k[0]] > 50 for k in sizes)


def test_slices_cut_a_shared_tuple(spark):
    d = spark.range(800).select("id", F.lit("same").alias("t"), (F.col("id") % 5).alias("v"))
    out = fit_apply("LagFeatures", d, columns=["v"], lags=[1], sort_by=["t"], hot_rows=100)
    assert out.where("v_lag_1 IS NULL").count() == 1 and out.count() == 800
    cut, _, _ = split_hot_groups(d, [], ["t"], 1, 100)
    assert cut.select("__slice").distinct().count() > 5


def brute_knn(a, b, k, missing=False, same=None, sign=1.0):
    out = {}
    for i, x in enumerate(a):
        ds = []
        for j, y in enumerate(b):
            if same and i == j:
                continue
            diff = (x - y) ** 2
            ok = ~np.isnan(diff)
            if not ok.any():
                continue
            ds.append((sign * round(math.sqrt(diff[ok].sum() * (len(x) / ok.sum())), 9), j))
        out[i] = [j for _, j in sorted(ds)[:k]]
    return out


def points(spark, x, key="id"):
    cols = [f"c{j}" for j in range(x.shape[1])]
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"{key} long, " + ", ".join(f"{c} double" for c in cols)), cols


def result(df):
    got = {}
    for r in df.orderBy("l_id", "rank").collect():
        got.setdefault(r["l_id"], []).append(r["r_id"])
    return got


@pytest.mark.parametrize("broadcast_bytes", [10_000_000, 0])
def test_knn_join_is_exact(spark, broadcast_bytes):
    rng = np.random.RandomState(1)
    x = np.round(rng.normal(size=(220, 3)) * 10)  # whole numbers: equal distances are equal exactly
    x[:70] = x[0]  # a third of the rows are copies of one point
    d, cols = points(spark, x)
    got = result(knn_join(d, d, cols, 4, ["id"], ["id"], exclude_self=True, broadcast_bytes=broadcast_bytes, leaf_rows=16))
    assert got == brute_knn(x, x, 4, same=True)


@pytest.mark.parametrize("broadcast_bytes", [10_000_000, 0])
def test_knn_join_with_missing_coordinates(spark, broadcast_bytes):
    rng = np.random.RandomState(2)
    x = rng.normal(size=(150, 3))
    x[rng.rand(150, 3) < 0.2] = np.nan
    x[np.isnan(x).all(axis=1)] = 0.0
    d, cols = points(spark, x)
    got = result(knn_join(d, d, cols, 3, ["id"], ["id"], missing=True, exclude_self=True, broadcast_bytes=broadcast_bytes, leaf_rows=12))
    assert got == brute_knn(x, x, 3, True, same=True)


def test_knn_join_farthest(spark):
    x = np.random.RandomState(3).normal(size=(120, 2))
    d, cols = points(spark, x)
    got = result(knn_join(d, d, cols, 3, ["id"], ["id"], metric="-euclidean", broadcast_bytes=0, leaf_rows=10))
    assert got == brute_knn(x, x, 3, sign=-1.0)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_join_by_pivots_in_many_dimensions(spark, metric):
    rng = np.random.RandomState(5)
    centres = rng.randint(-200, 200, (6, 24))
    x = (centres[rng.randint(0, 6, 260)] + rng.randint(-5, 6, (260, 24))).astype(float)
    x[200:] = x[3]  # many copies
    x[7, 0] = np.inf  # at no finite distance
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = result(knn_join(d, d, None, 3, ["id"], ["id"], vector="v", metric=metric, exclude_self=True, broadcast_bytes=0, leaf_rows=10))
    use = [i for i in range(260) if i != 7]
    far = np.abs(x[:, None, :] - x[None, :, :]).sum(axis=2) if metric == "manhattan" else ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert got == {i: sorted((j for j in use if j != i), key=lambda j: (far[i, j], j))[:3] for i in use}


def test_blocks_are_exact_far_from_zero():
    rng = np.random.RandomState(6)
    a, b = 1e7 + rng.randint(0, 9, (40, 5)).astype(float), 1e7 + rng.randint(0, 9, (300, 5)).astype(float)
    b[17] = -3e7
    r, c, v = block_top_k(a, b, 4, "euclidean", False)
    far = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    want = [(i, j) for i in range(40) for j in np.lexsort((np.arange(300), far[i]))[:4]]
    assert list(zip(r, c)) == want and np.allclose(v, [far[i, j] for i, j in want], rtol=1e-15)


def test_pivots_bound_and_prune():
    rng = np.random.RandomState(7)
    centres = rng.normal(size=(12, 8)) * 50
    right, left = (centres[rng.randint(0, 12, n)] + rng.normal(size=(n, 8)) for n in (600, 200))
    for metric in ("euclidean", "manhattan", "-euclidean"):
        p = Pivots(right[:30].copy(), metric)
        leaf, reach = p.assign(right)
        p.describe([{"leaf": i, "low": reach[leaf == i].min(), "high": reach[leaf == i].max()} for i in np.unique(leaf)])
        diff = np.abs(left[:, None, :] - right[None, :, :])
        far = diff.sum(axis=2) if metric == "manhattan" else np.sqrt((diff ** 2).sum(axis=2)) * (-1 if metric[0] == "-" else 1)
        bound = p.bounds(left)
        for k, i in enumerate(p.ids):
            assert (bound[:, k] <= far[:, leaf == i].min(axis=1) + 1e-12).all()
        if metric[0] != "-":
            kth = np.sort(far, axis=1)[:, 4]
            assert (bound <= kth[:, None]).mean() < 0.3  # most leaves are never visited


def test_leaves_grow_with_the_table():
    assert [leaf_count(n, 4096, 16 << 20, 536) for n in (100, 10 ** 6, 10 ** 8)] == [1, 245, 10_000]
    assert leaf_count(10 ** 12, 4096, 16 << 20, 536) == (16 << 20) // 536


def test_kendall_matches_pairs(spark, monkeypatch):
    rng = np.random.RandomState(4)
    x = np.where(rng.rand(300) < 0.35, 5, rng.randint(0, 40, 300)).astype(float)
    y = np.round(x * 0.3 + rng.normal(size=300) * 4)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(300) for j in range(i))
    assert signed_pairs(x, y, np.ones(300)) == s
    n0 = 300 * 299 / 2
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    want = s / math.sqrt((n0 - ties(x)) * (n0 - ties(y)))
    d = frame(spark, x=x.tolist(), y=y.tolist())
    assert abs(kendall_tau(d, F.col("x"), F.col("y"), rows_per_bucket=40) - want) < 1e-12
    cells = d.groupBy("x", "y").agg(F.count("*").cast("double").alias("w"))
    assert signed_pairs_by_digits(cells, 60) == s
    monkeypatch.setattr(correlations, "KENDALL_RANGES", 2)
    assert abs(kendall_tau(d, F.col("x"), F.col("y"), rows_per_bucket=60) - want) < 1e-12


def test_shortest_half_with_repeats(spark):
    v = np.array([1, 2, 2, 2, 3, 4, 4, 9, 10, 11, 30, 31.0])
    n, h = len(v), (len(v) + 3) // 2
    s = np.sort(v)
    diff = s[h:] - s[:n - h]
    starts = np.nonzero(diff == diff.min())[0]
    want = np.mean([(s[i] + s[i + h]) / 2 for i in starts])
    assert abs(shortest_half_centre(spark.createDataFrame([(float(x),) for x in v], "x double"), n, h) - want) < 1e-12


def test_smallest_takes_an_exact_number(spark):
    d = spark.range(1000).withColumn("k", F.col("id") % 10)
    assert d.where(smallest(d, hash_order(["id"], 1), 137)).count() == 137
    assert d.where(smallest(d, [F.col("k"), F.col("id")], 250)).agg(F.max("id")).first()[0] == 991
    with pytest.raises(ValueError):
        smallest(d, [F.col("k")], 250)


def test_smallest_per_class_with_many_classes(spark):
    d = spark.range(2000).withColumn("c", (F.col("id") % 80).cast("string"))
    totals = {str(i): 25 for i in range(80)}
    f, cond = smallest_per_class(d, F.col("c"), hash_order(["id"], 5), {k: 3 for k in totals}, totals)
    got = f.where(cond).groupBy("c").count().collect()
    assert len(got) == 80 and all(r["count"] == 3 for r in got)


def test_smallest_per_class_with_large_and_odd_classes(spark):
    size = {"a": 1700, "b": 40, None: 300, "c": 3, "d": 1}
    rows = [(f"{k}{i}", k) for k, n in size.items() for i in range(n)]
    d = spark.createDataFrame(rows, "id string, c string").repartition(4)
    takes = [{"a": 333, "b": 40, None: 1, "c": 2, "d": 0}, {"a": 1500, "b": 0, None: 299, "c": 3, "d": 1}]
    f, conds = smallest_in_classes(d, F.col("c"), hash_order(["id"], 3), takes, size)
    for take, cond in zip(takes, conds):
        assert {r["c"]: r["count"] for r in f.where(cond).groupBy("c").count().collect()} == {k: n for k, n in take.items() if n}
    small = {r["id"] for r in f.where(conds[0]).collect() if r["c"] == "a"}
    assert small < {r["id"] for r in f.where(conds[1]).collect()}
    # hashes that are not spread: few distinct leading values, settled by the others
    g, (cond,) = smallest_in_classes(d, F.col("c"), [F.length("id"), F.col("id")], [takes[0]], size)
    assert {r["id"] for r in g.where(cond & (F.col("c") == "a")).collect()} == set(sorted((r[0] for r in rows if r[1] == "a"), key=lambda x: (len(x), x))[:333])
    with pytest.raises(ValueError):
        smallest_in_classes(d, F.col("c"), [F.length("id")], [takes[0]], size)


def test_segmented_totals(spark):
    rows = [(g, float(v), 1 + v % 3) for g, n in (("hot", 700), ("x", 9), (None, 120)) for v in range(n)]
    d = spark.createDataFrame(rows, "g string, v double, n long").repartition(3)
    for limit in (10_000, 40):
        got = {(r["g"], r["v"]): r["cum_n"] for r in segmented_totals(d, ["g"], "v", ["n"], hot_rows=limit).collect()}
        assert got == {(g, v): sum(1 + k % 3 for k in range(int(v) + 1)) for g, v, _ in rows}


def test_number_sorted_strings(spark):
    words = [f"w{(i * 131) % 997:04d}" for i in range(900)]
    got = {r["v"]: r["code"] for r in number_sorted(spark.createDataFrame([(w,) for w in words], "v string"), "v", ranges=16).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}
