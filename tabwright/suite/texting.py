"""Text vectorisation and text profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import fit, fit_apply, q
from ..operators import text as T
from .base import query, r6, rounded, table

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


@query("N1", f"""SELECT doc_id, array_to_string({WORDS}, ' ') AS text__tokens, len({WORDS})::INTEGER AS text__token_count FROM documents""")
def tokenize_words(spark, sf):
    d = fit_apply("tokenizer", table(spark, sf, "documents"), columns=["text"], add_token_count=True)
    return d.select("doc_id", "text__tokens", "text__token_count")


@query("N1", f"""WITH w AS (SELECT conv_id, turn, list_filter({WORDS}, lambda x: x NOT IN ('the', 'and', 'la')) AS t FROM conversations)
  SELECT conv_id, turn, array_to_string(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), ' ') AS text__tokens FROM w""")
def tokenize_bigrams(spark, sf):
    d = fit_apply("tokenizer", table(spark, sf, "conversations"), columns=["text"], ngram_range=[1, 2], stop_words=["the", "and", "la"])
    return d.select("conv_id", "turn", "text__tokens")


@query("N1", r"""WITH t AS (SELECT c_custkey, regexp_replace(lower(c_name), '\s\s+', ' ', 'g') AS s FROM customer)
  SELECT c_custkey, array_to_string(list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) || list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)), ' ') AS c_name__tokens FROM t""")
def tokenize_characters(spark, sf):
    return fit_apply("tokenizer", table(spark, sf, "customer"), columns=["c_name"], analyzer="char", ngram_range=[2, 3]).select("c_custkey", "c_name__tokens")


@query("N1", """SELECT o_orderkey, array_to_string(flatten(list_transform(string_split(lower(o_orderpriority), ' '), lambda w: CASE WHEN length(w) + 2 >= 4 THEN list_transform(range(1, length(w)), lambda i: substr(' ' || w || ' ', i, 4)) ELSE [' ' || w || ' '] END)), ' ')
  AS o_orderpriority__tokens FROM orders""")
def tokenize_padded_characters(spark, sf):
    return fit_apply("tokenizer", table(spark, sf, "orders"), columns=["o_orderpriority"], analyzer="char_wb", ngram_range=[4, 4]).select("o_orderkey", "o_orderpriority__tokens")


@query("N2", f"""SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY 1, 2""")
def count_terms_long(spark, sf):
    return T.term_counts(table(spark, sf, "documents"), ["doc_id"], ["text"])


@query("N2", f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), v AS (SELECT term FROM w GROUP BY term HAVING count(DISTINCT doc_id) BETWEEN 5 AND 0.6 * (SELECT count(*) FROM documents) ORDER BY count(*) DESC, term LIMIT 40),
  c AS (SELECT doc_id, count(*) AS total, count(DISTINCT term) AS terms FROM w JOIN v USING (term) GROUP BY 1) SELECT doc_id, coalesce(total, 0)::DOUBLE AS total, coalesce(terms, 0)::BIGINT AS terms FROM documents LEFT JOIN c USING (doc_id)""")
def count_vectors_wide(spark, sf):
    d = fit_apply("count_vectorizer", table(spark, sf, "documents"), columns=["text"], max_features=40, min_df=5, max_df=0.6)
    cols = [c for c in d.columns if c.startswith("text__count__")]
    total, terms = F.lit(0.0), F.lit(0)
    for c in cols:
        total, terms = total + q(c), terms + (q(c) > 0).cast("bigint")
    return d.select("doc_id", total.alias("total"), terms.cast("bigint").alias("terms"))


TFIDF = f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
  x AS (SELECT doc_id, term, {{tf}} * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM t JOIN d USING (term){{limit}})"""


@query("N3", TFIDF.replace("{tf}", "(1 + ln(tf))").replace("{limit}", "") + " SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM x")
def tfidf_long(spark, sf):
    return rounded(T.tfidf_long(table(spark, sf, "documents"), ["doc_id"], ["text"], sublinear_tf=True), "tfidf")


@query("N3", TFIDF.replace("{tf}", "tf").replace("{limit}", " WHERE term IN (SELECT term FROM t GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 30)") +
       ", n AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS v FROM x), s AS (SELECT doc_id, round(sum(v), 6) AS s FROM n GROUP BY 1) SELECT doc_id, coalesce(s, 0.0::DOUBLE) AS total FROM documents LEFT JOIN s USING (doc_id)")
def tfidf_vectors_wide(spark, sf):
    d = fit_apply("tfidf_vectorizer", table(spark, sf, "documents"), columns=["text"], max_features=30)
    total = F.lit(0.0)
    for c in d.columns:
        if c.startswith("text__tfidf__"):
            total = total + q(c)
    return d.select("doc_id", r6(total).alias("total"))


HASH = f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket, sum(CASE WHEN ('0x' || substr(md5(term), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2 HAVING v <> 0)"""


@query("N4", HASH + " SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM h")
def hashed_terms_long(spark, sf):
    return rounded(T.hashed_long(table(spark, sf, "documents"), ["doc_id"], ["text"], n_features=256), "value")


@query("N4", HASH + ", x AS (SELECT doc_id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM h), s AS (SELECT doc_id, round(sum(v * bucket), 4) AS s FROM x GROUP BY 1) SELECT doc_id, coalesce(s, 0.0::DOUBLE) AS checksum FROM documents LEFT JOIN s USING (doc_id)")
def hashed_vectors(spark, sf):
    d = fit_apply("hashing_vectorizer", table(spark, sf, "documents"), columns=["text"], n_features=256, output="array")
    s = F.aggregate(F.transform("text__hash", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return d.select("doc_id", r6(s, 4).alias("checksum"))


LEX = "(SELECT word, CASE WHEN length(word) % 3 = 0 THEN 1.5 WHEN length(word) % 3 = 1 THEN -0.9 ELSE 0.1 END AS score FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS word FROM benchmark))"


def _lexicon(spark, sf):
    from ..functions.expressions import word_tokens
    w = table(spark, sf, "benchmark").select(F.explode(word_tokens(q("text"))).alias("word")).distinct()
    n = F.length("word") % 3
    return w.select("word", F.when(n == 0, 1.5).when(n == 1, -0.9).otherwise(0.1).alias("score"))


SENT = f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents), s AS (SELECT doc_id, sum(score) AS s FROM w JOIN {LEX} USING (word) GROUP BY 1),
  c AS (SELECT doc_id, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS c FROM documents LEFT JOIN s USING (doc_id))"""


@query("N5", SENT + " SELECT doc_id, round(c, 6) + 0.0::DOUBLE AS compound FROM c")
def sentiment_scores(spark, sf):
    return rounded(T.lexicon_sentiment(table(spark, sf, "documents"), "text", _lexicon(spark, sf), ["doc_id"]), "compound")


@query("N5", SENT + " SELECT CASE WHEN round(c, 9) >= 0.05 THEN 'positive' WHEN round(c, 9) <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY 1")
def sentiment_share(spark, sf):
    s = T.lexicon_sentiment(table(spark, sf, "documents"), "text", _lexicon(spark, sf), ["doc_id"])
    return rounded(T.sentiment_shares(s.withColumn("compound", F.round("compound", 9))), "share")


@query("J10", r"""SELECT round(avg((regexp_matches(text, '^[^@]+@[^@]+\.[^@]+') OR (regexp_matches(text, '^\+?[\d\s().-]{7,20}$') AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= 7))::INT), 6) AS rate FROM documents""")
def pii_share(spark, sf):
    d = table(spark, sf, "documents")
    return rounded(d.agg(T.pii_rate(d, "text").alias("rate")), "rate")


@query("J11", r"""SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def common_words(spark, sf):
    return T.common_words(table(spark, sf, "documents"), "text")
