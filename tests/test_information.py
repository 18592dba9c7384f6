"""Mutual information from neighbours, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators.selection import univariate_scores
from tabwright.profiling import information
from tabwright.profiling.information import class_information, digamma, number_information


def psi(m):
    return sum(1.0 / i for i in range(1, m)) - 0.57721566490153286


def plain_class(x, y, k=3):
    keep = [i for i in range(len(x)) if sum(v == y[i] for v in y) > 1]
    x, y = [x[i] for i in keep], [y[i] for i in keep]
    n, total = len(x), 0.0
    for i in range(n):
        mine = sorted(abs(x[j] - x[i]) for j in range(n) if j != i and y[j] == y[i])
        want = min(k, len(mine))
        r = mine[want - 1]
        if r == 0:
            kth, m = sum(d == 0 for d in mine), sum(v == x[i] for v in x) - 1
        else:
            kth, m = want, sum(abs(v - x[i]) < r * (1 - 1e-9) for v in x)
        total += psi(kth) - psi(len(mine) + 1) - psi(m)
    return max(0.0, psi(n) + total / n) if n else 0.0


def plain_number(x, y, k=3):
    x, y = np.array(x) / np.std(x), np.array(y) / np.std(y)
    n, total = len(x), 0.0
    for i in range(n):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        d = np.sort(np.delete(np.maximum(dx, dy), i))
        r = d[k - 1]
        if r == 0:
            total += psi(int((d == 0).sum())) - psi(int((dx == 0).sum()) - 1) - psi(int((dy == 0).sum()) - 1)
        else:
            total += psi(k) - sum(psi(int((g < r - (r + 3) * 1e-11).sum())) for g in (dx, dy))
    return max(0.0, psi(n) + total / n)


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 200).select(digamma(F.col("id"))).collect()]
    assert got == pytest.approx([psi(m) for m in range(1, 200)], abs=1e-12)


@pytest.fixture
def rows():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    return [(float(rng.normal(v)), float(rng.integers(0, 6) + v), float(rng.normal()), None if i % 11 == 0 else float(v * i), "abc"[v]) for i, v in enumerate(y.tolist())] + [(0.5, 1.0, 0.0, 1.0, "alone")]


def test_classes(spark, rows):
    d = spark.createDataFrame(rows, "a double, ties double, noise double, gaps double, y string")
    got = class_information(d, ["a", "ties", "noise", "gaps"], "y")
    for i, c in enumerate(["a", "ties", "noise", "gaps"]):
        has = [r for r in rows if r[i] is not None]
        assert got[c] == pytest.approx(plain_class([r[i] for r in has], [r[4] for r in has]), abs=1e-9), c
    assert got["a"] > 0.1 > got["noise"]
    assert class_information(d.limit(0), ["a"], "y") == {"a": 0.0}


def test_classes_in_slices(spark, rows, monkeypatch):
    d = spark.createDataFrame(rows, "a double, ties double, noise double, gaps double, y string")
    whole = class_information(d, ["a", "ties"], "y")
    split = information.split_hot_groups
    monkeypatch.setattr(information, "split_hot_groups", lambda *a, **o: split(*a, **(o | {"hot_rows": 30})))
    assert class_information(d, ["a", "ties"], "y") == pytest.approx(whole, abs=1e-12)


def test_numbers(spark):
    rng = np.random.default_rng(6)
    x, u = rng.normal(size=250), rng.integers(0, 4, 250).astype(float)
    y = x + 0.3 * rng.normal(size=250)
    v = np.where(rng.random(250) < 0.5, u, rng.integers(0, 4, 250))
    d = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, u, y, v)], "x double, u double, y double, v double")
    got = number_information(d, ["x", "u"], "y")
    assert got == pytest.approx({"x": plain_number(x, y), "u": plain_number(u, y)}, abs=1e-9)
    assert number_information(d, ["u"], "v")["u"] == pytest.approx(plain_number(u, v), abs=1e-9)
    scores = univariate_scores(d, ["x", "u"], "y", "mutual_info_regression")
    assert scores["x"][0] == pytest.approx(got["x"]) and math.isnan(scores["x"][1])
    assert number_information(d.limit(2), ["x"], "y") == {"x": 0.0}
