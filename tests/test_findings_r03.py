"""Rows that made queries fail or slow in round 3."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tabwright.core import fit_apply
from tabwright.llm import language_id, toxicity
from tabwright.models.validation import cross_validate
from tabwright.operators import text
from tabwright.plans import neighbors as N
from tabwright.suite import REGISTRY
from test_queries import canon


def test_ingest_profile_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{SMALL}/orders.parquet')")
    rel, df = con.sql(REGISTRY["ingest_profile"].sql), REGISTRY["ingest_profile"].run(spark, SMALL)
    cols = sorted(df.columns)
    idx = [rel.columns.index(c) for c in cols]
    assert canon([tuple(r[c] for c in cols) for r in df.collect()]) == canon([tuple(r[i] for i in idx) for r in rel.fetchall()])


def test_smote_tomek_with_copies(spark):
    """Rows and synthetic points that are equal: their ids must differ or be told apart."""
    rows = [(i, float(i % 4), 0.0, 0) for i in range(60)] + [(100 + i, 50.0 + i % 2, 1.0, 1) for i in range(8)]
    d = spark.createDataFrame(rows, "k long, x double, y double, label int")
    got = fit_apply("Oversampling", d, method="smote_tomek", target_column="label", key_columns=["k"]).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 60, 1: 60}


@pytest.mark.parametrize("broadcast_bytes", [10_000_000, 0])
def test_knn_join_with_repeated_keys(spark, broadcast_bytes):
    """A key's own rows are left out, however many there are."""
    d = spark.createDataFrame([(1, 0.0), (1, 0.5), (2, 3.0), (3, 9.0), (3, 9.0)], "k long, x double")
    got = N.knn_join(d.where("k <> 1"), d, ["x"], 2, ["k"], ["k"], exclude_self=True, broadcast_bytes=broadcast_bytes, leaf_rows=2)
    assert {(r["l_k"], r["r_k"], r["distance"]) for r in got.where("l_k = 2").collect()} == {(2, 1, 2.5), (2, 1, 3.0)}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "-euclidean"])
def test_cells_give_what_whole_blocks_give(metric, monkeypatch):
    rng = np.random.RandomState(8)
    b = np.round(rng.normal(size=(3_000, 2)) * 30)  # ties and copies
    b[:500] = b[0]
    a, left, right = b[:900], np.arange(900), np.arange(3_000)
    right[1_000:1_200] = 7  # a repeated key

    def same(r, c):
        return left[r][:, None] == right[c][None, :]
    want = N.block_top_k(a, b, 4, metric, False, lambda s, e: same(slice(s, e), slice(None)))
    seen, plain = [], N.block_top_k
    monkeypatch.setattr(N, "block_top_k", lambda x, y, *more: seen.append(len(x) * len(y)) or plain(x, y, *more))
    got = N.cells_top_k(a, b, 4, metric, same)
    order = np.lexsort((got[1], got[2], got[0]))
    assert all((g[order] == w).all() for g, w in zip(got, want))
    assert sum(seen) < 0.6 * len(a) * len(b)


def test_leaves_meet_in_bounded_groups():
    group = N.leaf_groups(np.array([3, 1, 0, 2]), np.array([40, 10, 70, 30]), 80)
    assert group.tolist() == [0, 0, 1, 0]
    assert N.leaf_groups(np.arange(1_000), np.full(1_000, 64), 1_024).max() + 1 == 63


def test_join_sends_a_row_once_for_many_leaves(spark, monkeypatch):
    """Without clusters in many dimensions no leaf can be left out, and a row still goes to few groups."""
    rng = np.random.RandomState(9)
    x = np.round(rng.normal(size=(400, 16)) * 100)
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    sent, meet = [], N._meet
    monkeypatch.setattr(N, "_meet", lambda visits, *more: sent.append(visits.count()) or meet(visits, *more))
    got = N.knn_join(d, d, None, 2, ["id"], ["id"], vector="v", exclude_self=True, broadcast_bytes=0, leaf_rows=2).orderBy("l_id", "rank").collect()
    far = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) + np.diag(np.full(400, np.inf))
    assert [r["r_id"] for r in got] == [j for i in range(400) for j in np.lexsort((np.arange(400), far[i]))[:2]]
    assert sum(sent) <= 400 * 20


@pytest.mark.parametrize("bounds", [3, 40])
def test_slices_with_few_boundaries(spark, monkeypatch, bounds):
    """Slices shorter than the stretches between boundaries; small groups, null groups and shared tuples among them."""
    from tabwright.plans import ordered as O
    monkeypatch.setattr(O, "MAX_BOUNDS", bounds)
    rows = [(i, [None, "a", "small"][0 if i % 3 == 0 else 2 if i % 100 == 1 else 1], "same" if i % 4 else f"t{i % 7}", float(i * 37 % 101)) for i in range(3_000)]
    d = spark.createDataFrame(rows, "id long, g string, t string, v double").repartition(7)
    got = fit_apply("RollingAggregate", d, columns=["v"], window=20, aggregations=["sum"], group_by=["g"], sort_by=["t", "id"], hot_rows=45)
    want, groups = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        past = groups.setdefault(r[1], [])
        past.append(r[3])
        want[r[0]] = sum(past[-20:])
    assert {r["id"]: r["v_roll_sum_20"] for r in got.collect()} == want
    cut, _, _ = O.split_hot_groups(d, ["g"], ["t", "id"], 19, 45)
    cut = cut.where(~F.col("__halo"))
    assert cut.groupBy("g", "__slice").count().agg(F.max("count")).first()[0] <= 45
    assert cut.where("g = 'small'").agg(F.max("__slice")).first()[0] == 0 and cut.count() == 3_000
    ends = cut.groupBy("g", "__slice").agg(F.min(F.struct("t", "id")).alias("a"), F.max(F.struct("t", "id")).alias("b")).orderBy("g", "__slice").collect()
    assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]) if x["g"] == y["g"])


def test_totals_over_few_boundaries(spark, monkeypatch):
    from tabwright.plans import ordered as O
    monkeypatch.setattr(O, "MAX_BOUNDS", 3)
    rows = [(g, float(v), 1 + v % 3) for g, n in (("hot", 900), ("x", 9), (None, 220)) for v in range(n)]
    d = spark.createDataFrame(rows, "g string, v double, n long").repartition(3)
    got = {(r["g"], r["v"]): r["cum_n"] for r in O.segmented_totals(d, ["g"], "v", ["n"], hot_rows=30).collect()}
    assert got == {(g, v): sum(1 + k % 3 for k in range(int(v) + 1)) for g, v, _ in rows}


def test_confusion_grid_is_not_shuffled(spark, monkeypatch):
    """The grid by ranges, null classes and classes of one side only; only occupied cells meet in joins."""
    from tabwright.models import evaluation as E
    monkeypatch.setattr(E, "GRID_RANGE", 4, raising=False)
    rows = [(f"c{i % 11}" if i % 13 else None, f"c{i * 7 % 17}" if i % 19 else None) for i in range(400)]
    got = E.confusion_matrix(spark.createDataFrame(rows, "y string, p string"), "y", "p")
    classes = sorted({x for r in rows for x in r if x is not None})
    want = {(a, b): 0 for a in classes for b in classes}
    for r in rows:
        want[r] = want.get(r, 0) + 1
    cells = [((r["actual"], r["predicted"]), r["count"]) for r in got.collect()]
    assert dict(cells) == want and len(cells) == len(want)
    assert "full outer" not in got._jdf.queryExecution().optimizedPlan().toString().lower().replace("fullouter", "full outer")


def test_slices_between_copies_of_a_row(spark, monkeypatch):
    from tabwright.plans import ordered as O
    monkeypatch.setattr(O, "MAX_BOUNDS", 2)
    rows = [(i // 6, float(i // 6)) for i in range(1_200)]  # six copies of each row
    d = spark.createDataFrame(rows, "id long, v double").repartition(5)
    got = fit_apply("RollingAggregate", d, columns=["v"], window=9, aggregations=["sum"], sort_by=["id"], hot_rows=20)
    want = sorted((v, sum(x for _, x in rows[max(0, i - 8):i + 1])) for i, (_, v) in enumerate(rows))
    assert sorted((r["v"], r["v_roll_sum_9"]) for r in got.collect()) == want


def test_toxicity_threshold_from_all_rows(spark):
    """F8: more rows than the former sample of 20,000; copies and ties among them."""
    d = spark.range(30_000).select((F.col("id") % 5 == 0).cast("int").alias("label"), (F.pmod(F.hash("id"), F.lit(900)) / 1000 + F.when(F.col("id") % 5 == 0, 0.4).otherwise(0.0)).alias("figure"))
    t = d.toPandas()
    values = np.unique(t.figure)[::-1]
    f1 = [2 * t.label[t.figure >= v].sum() / ((t.figure >= v).sum() + t.label.sum()) for v in values]
    k = int(np.argmax(f1))
    cut, slope = toxicity.threshold(d)
    assert cut == pytest.approx((values[k] + values[k + 1]) / 2, rel=1e-12)
    assert slope == pytest.approx(4 / (t.figure[t.label == 1].mean() - t.figure[t.label == 0].mean()), rel=1e-9)
    assert toxicity.threshold(d.where("label = 1")) is None


def test_language_calibration_from_all_rows(spark):
    """temperature, usual cross-entropies and limit of more rows than the former sample of 20,000; one language is rare."""
    n = F.col("id") % 190 + 10
    lang = F.when(F.col("id") % 3000 == 0, "cc").otherwise(F.when(F.col("id") % 2 == 0, "aa").otherwise("bb"))
    noise = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000
    sums = F.array(*[-n * (2.5 + noise(i) * 8 / F.sqrt(n) - F.when(lang == x, 0.4).otherwise(0.0)) for i, x in enumerate(("aa", "bb", "cc"))])
    d = spark.range(30_000).select(lang.alias("lang"), n.alias("n"), sums.alias("sums")).repartition(5)
    t = d.toPandas()
    names, m = ["aa", "bb", "cc"], t.n.to_numpy().astype(float)
    entropy, label = -np.vstack(t.sums) / m[:, None], t.lang.map({"aa": 0, "bb": 1, "cc": 2}).to_numpy()
    rows = np.arange(len(m))
    loss = [-language_id.Verdicts(names, heat, power).shares(m, entropy)[rows, label].mean() for power, heat in language_id.FLATTEN]
    own, usual = entropy[rows, label], []
    for j in range(3):
        h, x = own[label == j], 1 / m[label == j]
        mean = np.average(h, weights=x ** -0.5)
        slope = max(0.0, np.polyfit(x, (h - mean) ** 2, 1)[0])
        usual.append((mean, max(((h - mean) ** 2 - slope * x).mean(), 1e-6), slope))
    usual[2] = (own.mean(), own.var(), 0.0)
    got = language_id.calibrated(d, names, 0.005)
    assert (label == 2).sum() < 20 and (got.power, got.temperature) == language_id.FLATTEN[int(np.argmin(loss))]
    assert np.allclose(got.usual, usual, rtol=1e-8, atol=1e-12)
    middle, a, b = np.array(usual)[label].T
    assert got.limit == pytest.approx(np.quantile((own - middle) / np.sqrt(a + b / m), 0.995), rel=1e-8)
    assert language_id.calibrated(d.limit(0), names, 0.005) is None


def test_bigrams_of_a_long_text(spark):
    """the words of a text are found once, not again for each pair."""
    words = [f"w{i % 977}" for i in range(20_000)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, "one"), (3, None), (4, "a bb cc dd")], "k long, text string").repartition(1)
    began = time.time()
    got = {r["k"]: r["t"] for r in d.select("k", F.array_join(text.tokens(F.col("text"), ngram_range=(1, 3), stop_words=["cc"]), "|").alias("t")).collect()}
    assert time.time() - began < 30
    assert got[1].split("|") == words + [" ".join(words[i:i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]
    assert got[2] == "one" and got[3] == "" and got[4] == "bb|dd|bb dd"


def test_cross_validation_leaves_kept_rows_kept(spark):
    """the first candidate's folds threw away the rows that a search keeps for all candidates."""
    d = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("int").alias("label")).persist()
    cross_validate("decision_tree_classifier", d, ["x"], "label", ["id"], 2, max_depth=2)
    assert d.storageLevel.useMemory
    d.unpersist()
    cross_validate("decision_tree_classifier", d, ["x"], "label", ["id"], 2, max_depth=2)
    assert not d.storageLevel.useMemory
