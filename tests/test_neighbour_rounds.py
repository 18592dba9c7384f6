"""Chained filling by nearest rows against a plain version."""

import numpy as np
import pytest

from tabwright.core import apply, fit
from tabwright.plans import neighbour_rounds as NR


def plain(x, k, rounds, train=None):
    """Mean fill, then for each round and column (fewest gaps first) the mean of the k nearest of ``train``'s rows that have it."""
    gaps = np.isnan(x)
    rows = x if train is None else np.vstack([train, x])
    own = np.isnan(rows)
    base = len(rows) if train is None else len(train)
    order = sorted([c for c in range(x.shape[1]) if own[:base, c].any()], key=lambda c: own[:base, c].sum())
    mean = np.nanmean(rows[:base], axis=0)
    now = np.where(own, mean, rows)
    for _ in range(rounds):
        for c in order:
            others = [o for o in range(x.shape[1]) if o != c]
            have = np.flatnonzero(~own[:base, c])
            new = now.copy()
            for i in np.flatnonzero(own[:, c]):
                d = np.zeros(len(have))
                for o in others:
                    d += (now[i, o] - now[have, o]) ** 2
                best = have[np.lexsort((have, np.sqrt(d)))[:k]]
                new[i, c] = np.sort(now[best, c]).sum() / len(best)
            now = new
    return now if train is None else now[base:], gaps


def frame(spark, x, start=0):
    rows = [(start + i, *[None if np.isnan(v) else float(v) for v in r], "t") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, note string")


def gappy(seed, n):
    r = np.random.RandomState(seed)
    x = r.randint(0, 12, (n, 3)).astype(float)
    x[r.rand(n) < 0.3, 0] = np.nan
    x[r.rand(n) < 0.2, 1] = np.nan
    return x


CFG = dict(columns=["a", "b", "c"], key_columns=["id"], estimator="KNeighbors", tol=0.0)


def test_rounds_equal_the_plain_version(spark):
    x = gappy(0, 90)
    d = frame(spark, x)
    art = fit("IterativeImputer", d, max_iter=4, n_neighbors=3, **CFG)
    got = apply(d, art)
    assert got.columns == d.columns and got.where("note = 't'").count() == 90
    want, _ = plain(x, 3, 4)
    assert np.allclose(got.orderBy("id").select("a", "b", "c").toPandas().to_numpy(), want, rtol=0, atol=1e-12)


def test_new_rows_meet_the_donors_of_each_step(spark):
    x, y = gappy(1, 60), gappy(2, 25)
    art = fit("IterativeImputer", frame(spark, x), max_iter=3, **CFG)
    got = apply(frame(spark, y, 1000), art).orderBy("id").select("a", "b", "c").toPandas().to_numpy()
    want, _ = plain(y, 5, 3, train=x)
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_kept_neighbours_spare_the_rest(spark, monkeypatch):
    """Rows all of whose other columns are complete and far from rows that move meet the donors once."""
    met = []
    plain_join = NR.knn_join
    monkeypatch.setattr(NR, "knn_join", lambda a, b, *r, **o: met.append((a.count(), b.count())) or plain_join(a, b, *r, **o))
    x = np.array([[i, i % 7, np.nan if i % 10 == 3 else i * 2.0] for i in range(100)], dtype=float)
    x[95, 0] = np.nan
    fit("IterativeImputer", frame(spark, x), max_iter=3, **CFG)
    whole = [m for m in met if m[0] == 10]
    assert len(whole) == 1 and sum(a * b for a, b in met) < 4 * (10 * 90 + 99)


def test_odd_tables(spark):
    with pytest.raises(ValueError):
        fit("IterativeImputer", frame(spark, gappy(3, 10)), columns=["a", "b"], estimator="KNeighbors")
    whole = frame(spark, np.ones((4, 3)))
    assert apply(whole, fit("IterativeImputer", whole, **CFG)).count() == 4
    few = frame(spark, np.array([[1.0, 2.0, 3.0], [np.nan, 5.0, 6.0], [np.nan, np.nan, 6.0]]))
    out = apply(few, fit("IterativeImputer", few, max_iter=2, **CFG)).orderBy("id").collect()
    assert [r["a"] for r in out] == [1.0, 1.0, 1.0] and out[2]["b"] == 3.5
    none = frame(spark, np.full((3, 3), np.nan))
    assert apply(none, fit("IterativeImputer", none, **CFG)).where("a is null").count() == 3
    got = apply(frame(spark, np.array([[np.nan] * 3])), fit("IterativeImputer", few, max_iter=2, **CFG)).first()
    assert got["c"] == 5.0 and got["a"] == 1.0
