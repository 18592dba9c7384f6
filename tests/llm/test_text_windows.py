"""Removal of repeated windows, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SMALL
from tabwright.llm.recompression import op4_recompression_dedup, recompression_dedup
from tabwright.llm.suffix_dedup import common_prefixes, op1_suffix_dedup, suffix_array, suffix_dedup

ODD = "doc_id long, text string, key int, part int"


def bytes_digest(df):
    return brute.in_order(df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


def words_digest(df):
    return brute.in_order(df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect())


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for turn in range(150):
        text = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 160))).astype(np.uint8)
        if turn % 3 == 0:
            text[rng.integers(0, len(text), 3)] = 0
        b = text.tobytes()
        order = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix_array(text)
        assert list(sa) == order
        want = [0]
        for x, y in zip(order, order[1:]):
            k = 0
            while x + k < len(b) and y + k < len(b) and b[x + k] == b[y + k]:
                k += 1
            want.append(k)
        assert list(common_prefixes(text, sa)) == want


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert brute.in_order(op1_suffix_dedup(spark, SMALL).collect()) == brute.in_order(brute.suffix(docs))
    assert brute.in_order(op4_recompression_dedup(spark, SMALL).collect()) == brute.in_order(brute.words(docs))


@pytest.mark.parametrize("hot", [2, 10**6])
def test_odd_bytes(spark, hot):
    random.seed(2)
    base = "".join(random.choice("ab") for _ in range(400))
    rows = []
    for i in range(60):
        t = [None, "", base[random.randrange(300):][:random.randrange(200)], "a" * random.randrange(300), base[:120] + str(i) + base[50:200], "é\0" * random.randrange(100)][random.randrange(6)]
        rows.append((random.choice([None, i, i, 3]), t, i, i))
    d = spark.createDataFrame(rows, ODD)
    assert bytes_digest(suffix_dedup(d, hot=hot, shard_bytes=300)) == brute.in_order(brute.suffix(d.collect()))


@pytest.mark.parametrize("hot", [2, 10**6])
def test_odd_words(spark, hot):
    random.seed(3)
    base = [random.choice(["a", "b", "ccc"]) for _ in range(300)]
    rows = []
    for i in range(80):
        s = random.randrange(200)
        t = [None, " \n", random.choice([" ", "\n\t "]).join(base[s:s + random.randrange(100)]), " ".join(["a"] * random.randrange(200)),
             " x " + " ".join(base[50:110]) + f" {i} " + " ".join(base[40:140]) + "  ", "é\x00 " * random.randrange(120)][random.randrange(6)]
        rows.append((random.choice([None, i, i, 3]), t, i, i))
    d = spark.createDataFrame(rows, ODD)
    assert words_digest(recompression_dedup(d, hot=hot)) == brute.in_order(brute.words(d.collect()))


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], ODD)
    assert suffix_dedup(empty).count() == recompression_dedup(empty).count() == 0
    random.seed(4)
    long = " ".join(str(random.randrange(10**6)) for _ in range(400_000))  # longer than a chunk
    d = spark.createDataFrame([(1, long[1000:3000]), (2, long), (3, long[-5000:])], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup(d).orderBy("doc_id").collect()] == [0, 2000, 5000]
