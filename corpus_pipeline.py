"""From raw documents to token ids: each stage calls one operator of tabwright.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Rows are judged one by
one: those without an id, or with an id that another text has too, are told apart by their text; all but one text of an id stand
behind all others. Every stage is defined for null and empty texts, repeated rows and ids,
empty tables and extra columns; see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.llm.decontamination import decontaminate
from tabwright.llm.near_dedup import minhash_near_dedup
from tabwright.llm.quality_rules import quality_rules
from tabwright.llm.sentencepiece_bpe import sentencepiece_encode
from tabwright.llm.suffix_dedup import suffix_dedup
from tabwright.session import shared_table_path

KEY = "__row_key"
FIRST = "__first_text"
#: near duplicates of the corpus: five words, 100 * intersection >= 80 * union (op7's own contract is stricter)
NEAR = 80


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each text: the id, or beyond all ids a hash, for rows without an id and for further texts of a repeated id.

    Rows equal in id and text share a key. The table of repeated ids is written, so that Spark knows its size when it
    chooses the join; as a rule it is empty.
    """
    spark, mark = docs.sparkSession, F.xxhash64("text")
    path = shared_table_path(spark, "repeated-ids")
    texts = docs.groupBy("doc_id").agg(F.min(mark).alias(FIRST), F.max(mark).alias("most"))
    texts.where((F.col(FIRST) != F.col("most")) & F.col("doc_id").isNotNull()).select("doc_id", FIRST).write.parquet(path)
    beyond = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND((1 << 61) - 1)
    named = F.when(F.col(FIRST).isNull() | (F.col(FIRST) == mark), F.col("doc_id").cast("long"))
    return docs.join(spark.read.parquet(path), "doc_id", "left").withColumn(KEY, F.coalesce(named, beyond)).drop(FIRST)


def _restored(out: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs from rest, with the text of this stage."""
    held = {"text": F.col(text)} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[held.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that too many texts of their host have."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    out = quality_rules(docs.select("doc_id", "text", "source", rest)).filter("kept")
    return _restored(out, docs, "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    carry = [c for c in docs.columns if c != "text"]
    out = minhash_near_dedup(_keyed(docs), id_col=KEY, threshold=NEAR, carry=carry).filter("kept")
    return _restored(out, docs, "text")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what a smaller document has already; documents of which nothing is left go."""
    carry = [c for c in docs.columns if c != "text"]
    out = suffix_dedup(_keyed(docs), id_col=KEY, whole_chars=True, carry=carry).filter("n_removed = 0 OR kept <> ''")
    return _restored(out, docs, "kept")


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    keyed = _keyed(docs)
    leaks = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=KEY).select(KEY).distinct()
    return keyed.join(leaks, KEY, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text."""
    out = sentencepiece_encode(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("test_items", test_items), ("tokens", tokens)]

#: Near duplicates by components, byte runs and token ids have no SQL form; the tests compare the result with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            path = shared_table_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
