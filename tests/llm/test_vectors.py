"""Hard negatives and whitening of vectors, against plain versions."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SMALL
from tabwright.llm import hard_negatives as hn, whitening

NAN, INF = float("nan"), float("inf")


def plain_negatives(rows, positives=5, negatives=3, least=50, most=95):
    """rows: (id, label, vector); anchors are ids that 5 divides."""
    rows = [(i, lab, [int(np.floor(256 * c)) for c in v]) for i, lab, v in rows]
    order = lambda s: sorted(s, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for anchor in {(i, lab, tuple(v)) for i, lab, v in rows if i is not None and i % 5 == 0}:
        scored = [(sum(a * b for a, b in zip(anchor[2], v)), i, lab) for i, lab, v in rows if i != anchor[0]]
        for s, i, _ in order(x for x in scored if x[2] == anchor[1])[:positives]:
            band = order(x for x in scored if x[2] != anchor[1] and least * s <= 100 * x[0] <= most * s)
            out += [(anchor[0], i, r + 1, n[1], s, n[0]) for r, n in enumerate(band[:negatives])]
    return brute.in_order(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(frame, **more):
    return brute.in_order(hn.hard_negatives(frame, F.col("key") % 5 == 0, **more).select(COLUMNS).collect())


def test_hard_negatives_by_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    r = c.sql(hn.OP13_SQL)
    want = brute.in_order([tuple(row[r.columns.index(x)] for x in COLUMNS) for row in r.fetchall()])
    got = hn.op13_hard_negatives(spark, SMALL)
    assert brute.in_order(got.select(COLUMNS).collect()) == want and len(want) > 100


@pytest.mark.parametrize("d,slices", [(1, 1), (3, 4), (24, 3)])
def test_hard_negatives_plain(spark, d, slices):
    r = random.Random(d)
    rows = [(i, r.randrange(3), [r.choice([0.0, 0.5, r.random() - 0.2]) for _ in range(d)]) for i in range(400)]
    rows += [(i, lab, v) for i, lab, v in rows[:60]] + [(400 + i, lab, v) for i, lab, v in rows[:40]]  # repeated rows and ties
    f = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    assert mined(f, slice_bytes=90 * d * 8 // slices) == plain_negatives(rows)


def test_hard_negatives_odd(spark):
    good = [(5, 1, [1.0, 2.0]), (6, 1, [1.0, 1.5]), (None, 1, [1.0, 1.0]), (None, 2, [0.9, 1.0]), (7, 2, [1.0, 1.1]), (10, 2, [-1.0, -1.0]), (5, 2, [0.5, 0.5])]
    bad = [(15, None, [1.0, 1.0]), (20, 1, None), (25, 1, [1.0, None]), (30, 2, [NAN, 1.0]), (35, 2, [INF, 0.0]), (40, 2, []), (45, 1, [1.0])]
    kind = "vec_id long, label int, embedding array<double>"
    f = spark.createDataFrame(good + bad, kind).withColumn("key", F.lit("x")).withColumn("vec", F.lit(1)).withColumn("score", F.lit(2))
    assert mined(f) == plain_negatives(good)
    assert mined(f.limit(0)) == [] and mined(spark.createDataFrame(bad[:3], kind)) == []
    far = [(i, i % 2, [3e15 * (i + 1), 1.0]) for i in range(12)]  # beyond long: scores stay at its end, nothing fails
    assert all(x[4] == (1 << 63) - 1 for x in mined(spark.createDataFrame(far, kind)))


def test_bounds_hold():
    r = np.random.default_rng(1)
    a, b = r.integers(-300, 300, (40, 13)), r.integers(-300, 300, (50, 13))
    exact = a @ b.T
    widths = []
    for n in (1, 2, 4, 8, 13):
        lo, hi = hn.Summaries(a, n).bounds(hn.Summaries(b, n))
        assert (lo <= exact).all() and (exact <= hi).all()
        widths.append((hi - lo).mean())
    assert widths == sorted(widths, reverse=True)  # finer segments bound closer


def plain_whitening(rows, components=4):
    """id -> deviation and whitened values; n, explained. rows: (id, vector), by numpy's own eigenvectors."""
    x = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array(v) - np.array(sums) / n) @ vec[:, :components] / np.sqrt(np.maximum(e[:components], 1e-300))) for i, v in x]
    return n, out, e / e.sum()


def compare_whitening(got, rows, components=4):
    n, want, explained = plain_whitening(rows, components)
    by = {}
    for r in got:
        assert r.n == n and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    assert len(got) == components * len(rows)
    sign = None
    for i, deviation, white in want:
        assert (i, deviation) in by
        mine = np.array([by[i, deviation][c + 1][0] for c in range(components)])
        sign = np.sign(mine * white) if sign is None else sign
        assert np.allclose(mine, sign * white, rtol=1e-8, atol=1e-8)


def test_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    compare_whitening(whitening.op11_whitening(spark, SMALL).collect(), rows)


def test_whitening_copies_and_sizes(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1 + d) for d in range(5)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + rows[:20]  # one vector holds much of the table, rows repeat
    f = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    compare_whitening(whitening.whitened(f).collect(), rows)
    compare_whitening(whitening.whitened(f, components=2).collect(), rows, 2)
    far = [(i, [1e12 * r.random(), 1e12 * r.random()]) for i in range(50)]  # deviations beyond long
    got = whitening.whitened(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    want = {i: d for i, d, _ in plain_whitening(far, 2)[1]}
    assert len(got) == 100 and all(r.deviation is None and int(r.deviation_exact) == want[r.vec_id] and r.identity_error < 1e-6 for r in got)


def test_whitening_odd(spark):
    kind = "vec_id long, embedding array<double>"
    good = [(None, [1.0, 2.0, 0.0]), (1, [0.5, 1.0, 0.0]), (1, [0.5, 1.0, 0.0]), (2, [-0.5, 1.5, 0.0])]
    bad = [(3, None), (4, [NAN, 1.0, 1.0]), (5, [1.0, None, 1.0]), (6, [INF, 0.0, 0.0]), (7, []), (8, [1.0])]
    f = spark.createDataFrame(good + bad, kind).withColumn("key", F.lit(1)).withColumn("x", F.lit(2)).withColumn("n", F.lit(2))
    got = whitening.whitened(f).collect()
    assert len(got) == 12 and {r.vec_id for r in got} == {None, 1, 2} and {r.n for r in got} == {3}
    assert all((r.whitened is None) == (r.component == 3) == (r.explained == 0) and r.identity_error < 1e-9 for r in got)
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 2, kind)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, 0.0, None)] * 4
    assert whitening.whitened(f.limit(0)).count() == whitening.whitened(spark.createDataFrame(bad[:5], kind)).count() == 0


def test_spectral():
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.normal(size=(24, 24)))
    for e in (r.random(24), [5.0] * 10 + [1.0] * 14, [3.0, 2.0] + [0.0] * 22, 10.0 ** -np.arange(0, 12, 0.5), np.zeros(24), 1 + 1e-9 * np.arange(24)):
        a = q @ np.diag(e) @ q.T
        values, vectors = whitening.spectral(a)
        assert np.allclose(values, np.sort(e)[::-1], atol=1e-13 * max(1, max(e))) and np.abs(a @ vectors - vectors * values).max() < 1e-13 * max(1, max(e))
        assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-8
    a = r.normal(size=(9, 9))
    a = a + a.T
    u = whitening.polar(a)
    assert np.allclose(u @ u, np.eye(9), atol=1e-13) and np.allclose(u @ a, (u @ a).T, atol=1e-12) and np.linalg.eigvalsh(u @ a).min() > 0
