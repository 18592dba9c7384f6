"""Quality rules, decontamination, sharding and the two classifiers."""

from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pandas as pd
import pytest

import brute
from conftest import SMALL
from tabwright.llm import preference_quality, quality_rules, sharding, toxicity
from tabwright.llm.decontamination import decontaminate, op2_decontamination

MIDDLE = "/root/testdata/sf0.1"
FIGURES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept"]


def by_sql(documents, limit):
    c = duckdb.connect()
    c.register("documents", documents)
    r = c.sql(quality_rules.OP5_SQL.replace(f"> {quality_rules.LIMIT})", f"> {limit})"))
    return brute.in_order([tuple(row[r.columns.index(x)] for x in FIGURES) for row in r.fetchall()])


@pytest.mark.parametrize("limit", [2, quality_rules.LIMIT])
def test_quality_rules(spark, limit):
    got = quality_rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet"), limit=limit)
    assert brute.in_order(got.select(FIGURES).collect()) == by_sql(pd.read_parquet(f"{SMALL}/documents.parquet"), limit)


def test_quality_rules_odd(spark):
    texts = [None, "", " \n\t", "a b c a b c a b c", "x\n x\nx\n\n12 X", "12 x\n99 x\nend of # it", "é " * 60, ("same line here\n" * 3) + "w " * 55, "\x0b\x0c a"]
    rows = [(i, t, "h", i) for i, t in enumerate(texts)] + [(100 + i, f"{i} shared words\n" + " ".join("abcde"[i] + "v" * (k + 1) for k in range(60)), "h", 1) for i in range(5)]  # digits count as alike
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    out = quality_rules.quality_rules(d, limit=3)
    assert brute.in_order(out.select(FIGURES).collect()) == by_sql(d.drop("kept").toPandas(), 3)
    clean = {r.doc_id: r.clean_text for r in out.collect()}
    assert all("shared" not in clean[100 + i] and len(clean[100 + i].split()) == 60 for i in range(5))
    assert quality_rules.quality_rules(d.limit(0)).count() == 0
    no_host = spark.createDataFrame([(1, "a b", None), (None, "a b", None), (1, "a b", None)], "doc_id long, text string, source string")
    assert quality_rules.quality_rules(no_host).count() == 3


def test_copies_do_not_count_twice(spark):
    text = "first line of a text\n" + " ".join(f"w{i}" for i in range(80))
    d = spark.createDataFrame([(i, text, "h") for i in range(20)], "doc_id long, text string, source string")
    assert {r.kept for r in quality_rules.quality_rules(d, limit=3).collect()} == {True}


def test_decontamination(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in op2_decontamination(spark, SMALL).collect()}
    assert got == brute.leaks(docs.collect(), items.collect())
    assert {(r.doc_id, r.item_id) for r in decontaminate(docs, items, slice_bytes=2000).collect()} == got  # several slices
    bench = [(1, " ".join(f"q{i}" for i in range(30))), (2, "short item"), (3, None), (4, ""), (5, " ".join(f"z{i}" for i in range(150)))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    fill = " ".join(f"f{i}" for i in range(500))
    texts = [None, "", fill, f"{fill} {bench[0][1]} {fill}", "a SHORT, item b", f"{fill[:300]} {bench[4][1]}", bench[0][1][:60]]
    d = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0)], "doc_id long, text string, item_id int")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate(d, b).collect())
    assert got == {(3, 1): 2, (4, 2): 1, (5, 5): 1} and set(got) == brute.leaks(d.collect(), b.collect())
    assert decontaminate(d, b.limit(0)).count() == decontaminate(d.limit(0), b).count() == 0


@pytest.mark.parametrize("own", [0, 1])
def test_decontamination_does_not_depend_on_slices(spark, own):
    template = [f"t{k}" for k in range(30)]
    items = [(i, " ".join(template[:20] + [f"own{i}"] + template[20:])) for i in range(40)] + [(100 + i, " ".join(f"z{i}w{k}" for k in range(12 + i))) for i in range(20)]
    size = sum(len(t) + 64 for _, t in items)
    texts = [" ".join(template[:20] + ["other" if not own else "own7"] + template[20:]), items[45][1], "nothing of it " * 30, f"{items[50][1]} and {items[3][1]}"]
    d, b = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(tuple, decontaminate(d, b, slice_bytes=-(-size // n)).collect())) for n in (1, 2, 8, 40)]
    assert got[0] and all(g == got[0] for g in got[1:])  # rows, scores and overlaps
    assert {(r[0], r[1]) for r in got[0]} >= {(1, 105), (3, 110), (3, 3)}


def check_shards(rows, source):
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in source)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest, even = max((r.size for r in rows), default=0), sum(size.values()) / 8
    assert all(abs(size[k] - even) <= largest for k in range(8))


def test_sharding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sharding.op6_sampled_splitters(spark, SMALL).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    odd = [(i if i % 3 else None, "same text" if i % 2 else "x" * (i % 40), 1) for i in range(600)] + [(5, "same text", 1)] * 300 + [(7, "big" * 2000, 1), (8, None, 1)]
    d = spark.createDataFrame(odd, "doc_id long, text string, size int")
    check_shards(sharding.split_evenly(d).collect(), [r[:2] for r in odd])
    assert sharding.split_evenly(d.limit(0)).count() == 0


def area(score, label):
    rank, one = score.rank(), (label == 1).sum()
    return (rank[label == 1].sum() - one * (one + 1) / 2) / (one * (label == 0).sum())


def held_out(query, spark, label):
    got = query(spark, MIDDLE).toPandas()
    assert len(got) == len(pd.read_parquet(f"{MIDDLE}/documents.parquet", columns=["doc_id"])) and got.score.between(0, 1).all()
    m = got.merge(pd.read_parquet(f"{MIDDLE}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    return m.score, m[label], m.predicted


def test_quality_classifier(spark):
    score, label, predicted = held_out(preference_quality.op9_preference_quality, spark, "quality")
    assert area(score, label) > 0.99 and (predicted == label).mean() > 0.98


def test_toxicity(spark):
    # three in ten toxic labels are on texts without any mark of it, so the ranking has a bound well below 1
    score, label, predicted = held_out(toxicity.op10_toxicity, spark, "toxic")
    assert area(score, label) > 0.75 and (predicted == label).mean() > 0.94 and (label[predicted == 1] == 1).mean() > 0.9


def test_classifiers_odd(spark):
    d = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "x", 3), (2, "y z", 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None, None), (2, 7, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (preference_quality.preference_quality, toxicity.toxicity):
        out = run(d, none).collect()
        assert len(out) == 4 and {r.score for r in out} == {0.5}
        assert run(d.limit(0), none).count() == 0


def test_toxicity_scores_rare_expressions(spark):
    code = lambda t: int.from_bytes(t.encode(), "big")
    counts = [(code("hello"), 900, 100), (code("hellp"), 300, 30), (code("grunk"), 0, 3), (code("grunt"), 5, 0), (code("rarer"), 1, 0)]
    got = {r.code: r.ratio for r in toxicity.ratios(spark.createDataFrame(counts, "code long, plain long, toxic long")).collect()}
    context = lambda t: code(t) + toxicity.CONTEXT
    assert set(got) == {c for c, _, _ in counts} | {context(t) for t in ("hell", "grun", "rare")}  # all counted, and all contexts
    assert got[code("grunk")] > 0 and got[code("grunt")] < 0 and got[code("rarer")] < 0 and all(got.values())


def test_toxicity_uses_the_whole_table(spark):
    docs = [(i, f"plain words number {i % 7} about weather" + (" grunkle" if i % 3 == 0 else "")) for i in range(120)] + [(None, "a grunkle"), (None, "a grunkle"), (5, "again"), (5, None)]
    d = spark.createDataFrame([(i, f"{t} {i}" if i else t) for i, t in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    whole, sliced = (sorted((r.doc_id or -1, round(r.score, 6)) for r in toxicity.toxicity(d, labels, entries=n).collect()) for n in (1 << 20, 100))
    assert len(whole) == len(docs) and whole == sliced
