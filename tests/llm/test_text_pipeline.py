"""The pipeline, against plain versions of its stages; odd inputs for every stage."""

import public_tokenizers
import pytest
import sentencepiece

import brute
import corpus_pipeline
from conftest import SMALL

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept int, words int"


def test_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == brute.pipeline(docs, items, lambda t: [*sp.encode(t), 2], corpus_pipeline.NEAR)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd(spark, name, stage):
    rows = [(None, None, "en", None, 1, 5, 5), (None, "", "en", "s", 0, 5, 5), (1, "a b c", None, "s", 3, 6, 6), (1, "a b c", None, "s", 3, 6, 6), (None, "x " * 80, "e", "s", 3, 6, 6), (None, "x " * 80, "e", "s", 3, 6, 6),
            (7, " ".join(f"é{i}" for i in range(90)), "e", "s", 3, 6, 6), (8, " ".join(f"é{i}" for i in range(30, 150)), "e", "s", 3, 6, 6)]
    d = spark.createDataFrame(rows, COLUMNS)
    out = stage(spark, d, SMALL)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == d.columns
    assert len(out.collect()) == {"quality_rules": 2, "near_duplicates": 6, "repeated_passages": 8, "test_items": 8, "tokens": 8}[name]
    assert stage(spark, d.limit(0), SMALL).count() == 0


def test_near_duplicates_from_four_fifths(spark):
    words = [[f"w{k}x{i}" for i in range(104)] for k in range(3)]  # 100 shingles each; a changed last word costs one, an inner one five
    texts = []
    for w, cut in zip(words, (11, 10, 12)):
        texts += [" ".join(w), " ".join(w[:-cut] + [f"other{i}" for i in range(cut)])]  # shares 100 - cut of 100 + cut
    d = spark.createDataFrame([(i, t, "en", "s", len(t), 0, 0) for i, t in enumerate(texts)], COLUMNS)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, SMALL).collect()}
    want = {r[0] for r in brute.near([r.asDict() for r in d.collect()], threshold=80) if r[3]}
    assert kept == want == {0, 2, 4, 5}  # 89/111 and 90/110 are alike, 88/112 is not


def test_rows_of_one_id_are_judged_alone(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()
    leak = " ".join(str(v) for v in item if isinstance(v, str))
    words = [" ".join(f"{p}{i}" for i in range(90)) for p in "abc"]
    rows = [(5, words[0]), (5, words[1]), (5, words[1] + " more"), (9, words[2]), (9, leak), (9, words[2])]
    d = spark.createDataFrame([(i, t, "en", "s", len(t), 0, 0) for i, t in rows], COLUMNS)

    def after(stage):
        return sorted((r.doc_id, r.text) for r in stage(spark, d, SMALL).collect())
    near = after(corpus_pipeline.near_duplicates)
    assert (5, words[0]) in near and (9, words[2]) in near and (9, leak) in near and len(near) == 4
    assert after(corpus_pipeline.test_items) == sorted(r for r in rows if r[1] != leak)
    assert len(after(corpus_pipeline.repeated_passages)) >= 5
