"""Text vectorisers. Tokens stay in the JVM; long tables are the main output and wide columns are
made without a shuffle from a fitted vocabulary."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed_values as V
from ..core import Operator, nn, operator, q, with_columns
from ..functions.expressions import word_tokens
from ..plans.lookup import size_checked_join
from ..session import cut_lineage, spread

MAX_WIDE_TERMS = 10_000


def stop_word_list(value) -> list[str] | None:
    """``english`` is Spark ML's published English list; a list is used as given."""
    if not value:
        return None
    if isinstance(value, str):
        return StopWordsRemover.loadDefaultStopWords(value)
    return list(value)


def _joined(items: Column, n: int, sep: str):
    return lambda i: F.concat_ws(sep, *[F.get(items, i + j) for j in range(-1, n - 1)])


def _substring(word: Column, n: int):
    return lambda i: F.substr(word, i, F.lit(n))


def _grams(items: Column, lo: int, hi: int, sep: str) -> Column:
    """n-grams for n = lo..hi, shorter ones first.

    The items are bound as the variable of a one-element transform: as an expression they would be made again for each gram."""
    return F.transform(F.array(items), lambda bound: _bound_grams(bound, lo, hi, sep))[0]


def _bound_grams(items: Column, lo: int, hi: int, sep: str) -> Column:
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(items)
            continue
        last = F.size(items) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
            F.array().cast("array<int>"))
        parts.append(F.transform(starts, _joined(items, n, sep)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def tokens(text: Column, analyzer: str = "word", lowercase: bool = True, stop_words=None,
           ngram_range=(1, 1)) -> Column:
    lo, hi = int(ngram_range[0]), int(ngram_range[1])
    text = F.coalesce(text.cast("string"), F.lit(""))
    if analyzer == "word":
        base = word_tokens(text, lowercase, stop_word_list(stop_words))
        return base if (lo, hi) == (1, 1) else _grams(base, lo, hi, " ")
    t = F.lower(text) if lowercase else text
    if analyzer == "char":
        chars = F.regexp_extract_all(F.regexp_replace(t, r"\s\s+", " "), F.lit("(?s)."), F.lit(0))
        return _grams(chars, lo, hi, "")
    if analyzer == "char_wb":
        words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
        return F.flatten(F.transform(words, lambda w: _padded_grams(w, lo, hi)))
    raise ValueError(f"unknown analyzer {analyzer!r}")


def _padded_grams(word: Column, lo: int, hi: int) -> Column:
    """Character n-grams of a blank-padded word; a word shorter than n gives itself once."""
    w = F.concat(F.lit(" "), word, F.lit(" "))
    parts = []
    for n in range(lo, hi + 1):
        last = F.greatest(F.length(w) - n + 1, F.lit(1))
        grams = F.transform(F.sequence(F.lit(1), last), _substring(w, n))
        if n > lo:  # a short word was already given whole at a smaller n
            grams = F.when(F.length(w) > n - 1, grams).otherwise(F.array().cast("array<string>"))
        parts.append(grams)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def joined_text(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(nn(df, c).cast("string"), F.lit("")) for c in columns])


@operator("tokenizer")
class Tokenizer(Operator):
    category = "text"
    description = "Space-joined tokens and their number"
    defaults = {"analyzer": "word", "lowercase": True, "stop_words": None, "ngram_range": [1, 1],
                "add_token_count": False, "drop_original": False}

    def fit(self, df, cfg):
        return {"columns": [c for c in cfg.get("columns") or [] if c in df.columns],
                **{k: cfg[k] for k in self.defaults}}

    def apply(self, df, art):
        new, drop = {}, []
        for c in art["columns"]:
            if c not in df.columns:
                continue
            t = tokens(q(c), art["analyzer"], art["lowercase"], art["stop_words"], art["ngram_range"])
            new[f"{c}__tokens"] = F.array_join(t, " ")
            if art["add_token_count"]:
                new[f"{c}__token_count"] = F.size(t)
            if art["drop_original"]:
                drop.append(c)
        return with_columns(df, new, drop)


def term_counts(df: DataFrame, key: list[str], columns: list[str], binary: bool = False, **opts) -> DataFrame:
    """Long form (key, term, tf).

    A document's terms are counted inside its own row, so no shuffle is needed: sort the tokens,
    find where runs start, take differences. Every array is a column of its own, because a lambda
    that refers to an expression would compute it again for each element.
    """
    keys = [q(k) for k in key]
    narrow = spread(df.select(*keys, joined_text(df, columns).alias("__x")))
    d = narrow.select(*keys, F.sort_array(tokens(q("__x"), **opts)).alias("__s"))
    every = F.when(F.size("__s") > 0, F.sequence(F.lit(0), F.greatest(F.size("__s") - 1, F.lit(0))))
    d = d.select(*keys, "__s", F.filter(every, lambda i: (i == 0) | (F.get("__s", i) != F.get("__s", i - 1))).alias("__b"))
    runs = F.transform("__b", lambda i, j: F.struct(
        F.get("__s", i).alias("term"), (F.coalesce(F.get("__b", j + 1), F.size("__s")) - i).cast("bigint").alias("tf")))
    # the outer form keeps the optimiser from computing the arrays again in an inferred filter
    long = d.select(*keys, F.inline_outer(runs)).where("term is not null")
    return long.withColumn("tf", F.lit(1).cast("bigint")) if binary else long


def vocabulary_table(df: DataFrame, columns: list[str], min_df=1, max_df=1.0, max_features=None,
                     **opts) -> tuple[DataFrame, int]:
    """(term, df, tf) after the document-frequency limits, and the number of documents.

    One pass over the text; what is shuffled is one partial sum per term and input partition.
    """
    n = df.count()
    v = term_counts(df, [], columns, **opts).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    low = min_df if isinstance(min_df, int) else min_df * n
    high = max_df if isinstance(max_df, int) else max_df * n
    v = v.where((F.col("df") >= F.lit(low)) & (F.col("df") <= F.lit(high)))
    if max_features:
        v = v.orderBy(F.desc("tf"), "term").limit(int(max_features))
    return v, n


class _Vectorizer(Operator):
    category = "text"
    suffix = ""
    defaults = {"max_features": None, "min_df": 1, "max_df": 1.0, "ngram_range": [1, 1],
                "lowercase": True, "stop_words": None, "drop_original": False}

    def _opts(self, cfg):
        return {k: cfg[k] for k in ("ngram_range", "lowercase", "stop_words")}

    def fit(self, df, cfg):
        cols = [c for c in cfg.get("columns") or [] if c in df.columns]
        v, n = vocabulary_table(df, cols, cfg["min_df"], cfg["max_df"], cfg["max_features"], **self._opts(cfg))
        rows = v.limit(MAX_WIDE_TERMS + 1).collect()
        if len(rows) > MAX_WIDE_TERMS:
            raise ValueError(f"more than {MAX_WIDE_TERMS} terms: set max_features or use the long form")
        rows = sorted(rows, key=lambda r: r["term"])
        prefix = cols[0] if len(cols) == 1 else "_".join(cols)
        import math
        return {"columns": cols, "terms": [r["term"] for r in rows], "prefix": f"{prefix}__{self.suffix}__",
                "idf": [math.log((1.0 + n) / (1.0 + r["df"])) + 1.0 for r in rows],
                **{k: cfg[k] for k in self.defaults if k in cfg}}

    def _counts(self, df, art):
        """Dense term counts of a row as an array, made inside the JVM."""
        t = df.withColumn("__t", tokens(joined_text(df, art["columns"]), **self._opts(art)))
        m = CountVectorizerModel.from_vocabulary(art["terms"],
                                                 "__t", "__v")
        return m.transform(t).withColumn("__a", vector_to_array("__v")).drop("__t", "__v")

    def _values(self, df, art):
        raise NotImplementedError

    def apply(self, df, art):
        if not art["terms"]:
            return df
        out = self._values(self._counts(df, art), art)
        drop = art["columns"] if art.get("drop_original") else []
        return out.select(*[q(c) for c in df.columns if c not in drop],
                          *[F.col("__a")[i].alias(art["prefix"] + t) for i, t in enumerate(art["terms"])])


@operator("count_vectorizer")
class CountVectorizer(_Vectorizer):
    description = "Term counts per vocabulary term"
    suffix = "count"
    defaults = {**_Vectorizer.defaults, "binary": False}

    def _values(self, df, art):
        one = (lambda x: (x > 0).cast("double")) if art["binary"] else (lambda x: x)
        return df.withColumn("__a", F.transform("__a", one))


@operator("tfidf_vectorizer")
class TfidfVectorizer(_Vectorizer):
    description = "Smoothed tf-idf with unit rows"
    suffix = "tfidf"
    defaults = {**_Vectorizer.defaults, "sublinear_tf": False}

    def _values(self, df, art):
        idf = F.array(*[F.lit(v) for v in art["idf"]])
        tf = (lambda x: F.when(x > 0, F.log(x) + 1.0).otherwise(F.lit(0.0))) if art["sublinear_tf"] else (lambda x: x)
        w = F.zip_with(F.col("__a"), idf, lambda x, i: tf(x) * i)
        df = df.withColumn("__a", w)
        norm = F.sqrt(F.aggregate("__a", F.lit(0.0), lambda acc, x: acc + x * x))
        df = df.withColumn("__n", norm)
        return df.withColumn("__a", F.transform("__a", lambda x: F.when(F.col("__n") > 0, x / F.col("__n"))
                                                .otherwise(F.lit(0.0)))).drop("__n")


def tfidf_long(df: DataFrame, key: list[str], columns: list[str], sublinear_tf: bool = False, min_df=1,
               max_df=1.0, max_features=None, **opts) -> DataFrame:
    """(key, term, tfidf) with unit L2 norm per document, for any vocabulary size."""
    v, n = vocabulary_table(df, columns, min_df, max_df, max_features, **opts)
    v = cut_lineage(v)  # the fitted vocabulary: read twice below, computed once
    idf = v.select("term", (F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    tf = term_counts(df, key, columns, **opts)
    x = F.log(F.col("tf").cast("double")) + 1.0 if sublinear_tf else F.col("tf").cast("double")
    w = size_checked_join(tf, idf, "term", "inner").select(*[q(k) for k in key], "term", (x * F.col("idf")).alias("w"))
    # the norm of a document: a window over one document's distinct terms
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*[q(k) for k in key])))
    return w.select(*[q(k) for k in key], "term", (F.col("w") / norm).alias("tfidf"))


def token_hash(term: Column, n: int) -> tuple[Column, Column]:
    """(bucket, sign) from different bits of one md5."""
    h = F.md5(term)
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(n)
    odd = F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2
    return bucket, F.when(odd == 0, F.lit(1)).otherwise(F.lit(-1))


def hashed_long(df: DataFrame, key: list[str], columns: list[str], n_features: int = 1024,
                norm: str | None = "l2", alternate_sign: bool = True, **opts) -> DataFrame:
    """(key, bucket, value) of the hashed bag of words, zero buckets left out."""
    tf = term_counts(df, key, columns, **opts)
    b, s = token_hash(F.col("term"), n_features)
    val = F.sum(F.col("tf") * (s if alternate_sign else F.lit(1))).cast("double")
    g = tf.groupBy(*[q(k) for k in key], b.alias("bucket")).agg(val.alias("value")).where("value <> 0")
    w = W.partitionBy(*[q(k) for k in key])
    if norm == "l2":
        g = g.withColumn("value", F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(w)))
    elif norm == "l1":
        g = g.withColumn("value", F.col("value") / F.sum(F.abs("value")).over(w))
    return g


@operator("hashing_vectorizer")
class HashingVectorizer(Operator):
    """Hashed bag of words; nothing is fitted, so it runs on streams."""

    category = "text"
    description = "Signed hashed term counts with unit rows"
    defaults = {"n_features": 1024, "norm": "l2", "alternate_sign": True, "lowercase": True,
                "stop_words": None, "drop_original": False, "output": "columns"}

    def fit(self, df, cfg):
        cols = [c for c in cfg.get("columns") or [] if c in df.columns]
        return {"columns": cols, "prefix": (cols[0] if len(cols) == 1 else "_".join(cols)) + "__hash__",
                **{k: cfg[k] for k in self.defaults}}

    def apply(self, df, art):
        n = int(art["n_features"])
        toks = tokens(joined_text(df, art["columns"]), lowercase=art["lowercase"], stop_words=art["stop_words"])

        def label(t):
            b, s = token_hash(t, n)
            sign = F.when(s > 0, F.lit("+")).otherwise(F.lit("-")) if art["alternate_sign"] else F.lit("+")
            return F.concat(sign, b.cast("string"))
        m = CountVectorizerModel.from_vocabulary([f"{s}{i}" for s in "+-" for i in range(n)], "__t", "__v")
        out = m.transform(df.withColumn("__t", F.transform(toks, label))).withColumn("__a", vector_to_array("__v"))
        out = out.withColumn("__a", F.zip_with(F.slice("__a", 1, n), F.slice("__a", n + 1, n), lambda a, b: a - b))
        if art["norm"]:
            size = (F.sqrt(F.aggregate("__a", F.lit(0.0), lambda acc, x: acc + x * x)) if art["norm"] == "l2"
                    else F.aggregate("__a", F.lit(0.0), lambda acc, x: acc + F.abs(x)))
            out = out.withColumn("__n", size).withColumn("__a", F.transform(
                "__a", lambda x: F.when(F.col("__n") > 0, x / F.col("__n")).otherwise(F.lit(0.0))))
        drop = art["columns"] if art["drop_original"] else []
        keep = [q(c) for c in df.columns if c not in drop]
        if art["output"] == "array":
            return out.select(*keep, F.col("__a").alias(art["prefix"].rstrip("_")))
        return out.select(*keep, *[F.col("__a")[i].alias(f"{art['prefix']}{i}") for i in range(n)])


# --- text profile ----------------------------------------------------------------------------

def lexicon_sentiment(df: DataFrame, column: str, lexicon: DataFrame, key: list[str]) -> DataFrame:
    """(key, compound): summed word scores squashed to -1..1; lexicon has (word, score)."""
    toks = df.select(*[q(k) for k in key], F.explode(word_tokens(q(column))).alias("word"))
    hit = size_checked_join(toks, lexicon.select("word", F.col("score").cast("double").alias("score")), "word", "inner")
    sums = hit.groupBy(*[q(k) for k in key]).agg(F.sum("score").alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    return (df.select(*[q(k) for k in key]).join(sums, key, "left")
            .select(*[q(k) for k in key], (s / F.sqrt(s * s + 15.0)).alias("compound")))


def sentiment_shares(scored: DataFrame) -> DataFrame:
    c = F.col("compound")
    label = F.when(c >= 0.05, "positive").when(c <= -0.05, "negative").otherwise("neutral")
    return scored.groupBy(label.alias("label")).agg(F.count("*").alias("n")).select(
        "label", "n", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("share"))


def pii_condition(c: Column) -> Column:
    """Looks like an e-mail address, or is a phone-like text with seven digits or more."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return c.rlike(V.EMAIL_PATTERN) | (c.rlike(V.PHONE_PATTERN) & (digits >= 7))


def pii_rate(df: DataFrame, column: str) -> Column:
    return F.avg(F.when(nn(df, column).isNotNull(), pii_condition(nn(df, column).cast("string")).cast("double")))


def common_words(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most common words of all rows: lower, punctuation removed, split on blanks."""
    clean = F.regexp_replace(F.lower(q(column)), r"[^\p{L}\p{N}_\s]", "")
    w = df.select(F.explode(F.split(clean, " ")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)
