"""Language identification against a plain Kneser-Ney model, on held-out texts and on odd input."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.llm import language_id as li

MIDDLE = "/root/testdata/sf0.1"
KIND = "doc_id long, text string, lang string"
WORDS = {"aa": "gata noro lami tave pilo", "bb": "strk brumf schlong wertz krumm", "cc": "ñandú éçoulé über größe çava"}


def folded(text):
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
    return " ".join(words) + " " if words else ""


class Plain:
    """Interpolated Kneser-Ney by dictionaries and recursion."""

    def __init__(self, texts, chars):
        self.c = {4: Counter()}
        for t in texts:
            x = "   " + folded(t)
            self.c[4].update(x[i - 3:i + 1] for i in range(3, len(x)))
        for k in (3, 2, 1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.chars, self.d, self.total, self.types = chars, {}, {}, {}
        for k, c in self.c.items():
            n = Counter(c.values())
            self.d[k] = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.75
            self.total[k], self.types[k] = Counter(), Counter()
            for g, x in c.items():
                self.total[k][g[:-1]] += x
                self.types[k][g[:-1]] += 1

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / (self.chars + 1)
        n = self.total[k][g[:-1]]
        return self.p(g[1:]) if not n else max(self.c[k][g] - self.d[k], 0) / n + self.d[k] * self.types[k][g[:-1]] / n * self.p(g[1:])

    def entropy(self, text):
        x = "   " + folded(text)
        return -sum(math.log(self.p(x[i - 3:i + 1])) for i in range(3, len(x))) / max(1, len(x) - 3)


def sample():
    rng = np.random.default_rng(2)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), rng.integers(1, 30))) + (", 12! " if i % 3 else "") + " MIXED"[: i % 7], lang) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]


@pytest.mark.parametrize("entries", [1 << 23, 900])
def test_plain(spark, entries):
    docs = sample()
    taught = defaultdict(list)
    for i, t, lang in docs:
        if crc32(str(i).encode()) % 3 != 1:
            taught[lang].append(t)
    chars = len({c for ts in taught.values() for t in ts for c in folded(t)})
    models = {lang: Plain(ts, chars) for lang, ts in taught.items()}
    extra = [(None, "gata noro", "zz"), (None, "gata noro", "zz"), (7, "Krumm größe", None), (7, docs[7][1], None), (500, "", "aa"), (501, "12 %", "bb"), (502, None, "cc")]
    got = li.language_id(spark.createDataFrame(docs + extra, KIND).repartition(3), entries=entries).collect()
    assert len(got) == len(docs) + len(extra)
    want = Counter()
    for i, t, _ in docs + extra:
        h = {lang: m.entropy(t) for lang, m in models.items()}
        best = min(h, key=h.get) if folded(t) else "und"
        want[i, i is not None and crc32(str(i).encode()) % 3 == 1, best, round(h[best], 4) if folded(t) else None] += 1
    assert Counter((r.doc_id, r.held_out, r.lang_pred, None if r.cross_entropy is None else round(r.cross_entropy, 4)) for r in got) == want
    assert all(0 <= r.score <= 1 and (r.lang_pred != "und" or (r.score == 0 and r.rejected)) for r in got)


def test_held_out(spark):
    got = li.op12_language_id(spark, MIDDLE).toPandas()
    docs = pd.read_parquet(f"{MIDDLE}/documents.parquet", columns=["doc_id", "lang"])
    assert len(got) == len(docs) and not got.lang_pred.isna().any()
    m = got.merge(docs, on="doc_id")
    assert (m.held_out == m.doc_id.map(lambda i: crc32(str(i).encode()) % 3 == 1)).all()
    m = m[m.held_out & (m.lang_pred != "und")]
    right = m.lang_pred == m.lang
    assert right.mean() > 0.995 and abs(m.score.mean() - right.mean()) < 0.02  # right, and as sure as it should be
    assert m.rejected.mean() < 0.02


def test_rejects_other_writing(spark):
    docs = sample() + [(1000 + i, "qxqz jvvw xkkq wqjx zzxj " * 3, None) for i in range(3)]
    got = {r.doc_id: r.rejected for r in li.language_id(spark.createDataFrame(docs, KIND)).collect()}
    assert all(got[1000 + i] for i in range(3)) and sum(got[i] for i in range(240)) < 24


def test_odd(spark):
    long = ("gata noro é " * 300_000) + "x"  # 3.6 million characters, several blocks
    docs = [(i, t, lang) for i, t, lang in sample()] + [(900, long, "aa"), (901, "𐐀𐐁 \x00 İstanbul ǅ", "dd"), (902, "٣ ... ", "aa"), (903, "一二三", "aa")]
    f = spark.createDataFrame(docs, KIND).withColumn("key", F.lit(1)).withColumn("n", F.lit("n")).withColumn("aside", F.lit(None).cast("int"))
    got = {r.doc_id: r for r in li.language_id(f).collect()}
    assert len(got) == len(docs) and got[900].lang_pred == "aa" and got[902].lang_pred == "und" and got[903].lang_pred != "und"
    none = li.language_id(f.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == len(docs) and {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert li.language_id(f.limit(0)).count() == 0
    one = li.language_id(f.select("doc_id", "text", F.lit("only").alias("tongue")), lang_col="tongue").collect()
    assert {r.lang_pred for r in one} == {"only", "und"}


def test_broken_bytes_part_words(spark):
    f = spark.range(1).selectExpr("1L AS doc_id", "cast(concat(encode('gata', 'UTF-8'), X'FFC3', encode('noro', 'UTF-8')) AS string) AS text", "'aa' AS lang")
    got = li.language_id(f.unionByName(spark.createDataFrame([(0, "gata noro", "aa")], KIND))).collect()
    assert len({round(r.cross_entropy, 5) for r in got}) == 1
