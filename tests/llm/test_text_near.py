"""Near duplicates and components, against all pairs."""

import random
import tracemalloc

import numpy as np
import pytest

import brute
from conftest import SMALL
from tabwright.llm import near_dedup
from tabwright.llm.components import components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (7, 7), (200, 300), (300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 60: 50, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert brute.in_order(near_dedup.op7_minhash_near_dedup(spark, SMALL).collect()) == brute.in_order(brute.near(docs))


@pytest.mark.parametrize("block", [1024, 16])
def test_odd(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    random.seed(3)
    words = [f"w{i}" for i in range(50)]
    base, rows = [random.choice(words) for _ in range(150)], []
    for i in range(200):
        k, w = random.randrange(8), list(base)
        for _ in range(random.randrange(6)):
            w[random.randrange(len(w))] = random.choice(words)
        t = [None, " \n", " a  B\tc", "a b C", "x " * random.randrange(20)][k - 5] if k >= 5 else " ".join(w)
        rows.append((random.choice([None, i, i, i, i]), t, i))
    d = spark.createDataFrame(rows, "doc_id long, text string, component long")
    assert brute.in_order(near_dedup.minhash_near_dedup(d).collect()) == brute.in_order(brute.near(d.collect()))


def test_repeated_and_empty(spark):
    d = spark.createDataFrame([(5, "one two three four five six")] * 3 + [(4, "ONE two three four five six"), (9, "")], "doc_id long, text string")
    got = brute.in_order(near_dedup.minhash_near_dedup(d).collect())
    assert got == brute.in_order([(5, 2, 4, False)] * 3 + [(4, 2, 4, True), (9, 0, 9, True)])
    assert near_dedup.minhash_near_dedup(d.limit(0)).count() == 0


def test_memory_of_a_pair_of_blocks():
    r = np.random.RandomState(0)
    base = r.randint(0, 1 << 60, 300).astype("u8")
    left, right = ([np.unique(np.append(base[r.rand(300) < 0.95], r.randint(0, 1 << 60, 10).astype("u8"))) for _ in range(near_dedup.BLOCK)] for _ in range(2))
    tracemalloc.start()
    links = near_dedup.linked_pairs(left, right, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # eight bytes for all pairs, twice, and two matrices were 79 MB
    for i, j in [(0, 0), (5, 900), (1000, 17)]:
        both = len(np.intersect1d(left[i], right[j]))
        assert links[i, j] == (100 * both >= 80 * (len(left[i]) + len(right[j]) - both))
