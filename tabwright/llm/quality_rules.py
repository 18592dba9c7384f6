"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base figures come from the words and lines of each text. Then each line is normalised (lower case, white space as one blank,
digits as 0) and hashed, and the distinct texts that hold it are counted for each host: copies of one text count once, so a text
does not lose its lines by being copied. Lines held by more than `limit` texts of a host are removed there, and a document that
loses more than `depleted` of its words is rejected. Counting is a grouped aggregate by (line, host, text), then by (line, host),
both with partial sums before the shuffle: a line that a third of all texts hold is one row for each task.

Three-word windows are compared by 64-bit hashes within a text, packed with their place and sorted.

Defined cases: null texts are empty (no words, base_failed, not kept); a null host is a host of its own; rows equal in id, text and
host get the same answer; other columns are kept, those named like a result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLANK = "[ \\x09-\\x0D]+"
LIMIT = 100
DEPLETED = 0.5
MIN_WORDS = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


#: number of words in repeated three-word windows, from grams (a hash for each window, in order)
REPEATED = """
  aggregate(
    transform(__places, (p, k) -> least(3, coalesce(get(__places, k + 1), p + 3) - p)),
    0, (a, x) -> a + x)"""
PLACES = """
  sort_array(transform(
    filter(__packed, (x, k) -> shiftrightunsigned(x, __bits) = shiftrightunsigned(get(__packed, k + 1), __bits)
                          OR shiftrightunsigned(x, __bits) = shiftrightunsigned(get(__packed, k - 1), __bits)),
    x -> CAST(x & (shiftleft(1L, __bits) - 1L) AS INT)))"""
PACKED = "sort_array(transform(__grams, (h, k) -> shiftleft(h, __bits) | CAST(k AS BIGINT)))"
GRAMS = "CASE WHEN size(__words) > 3 THEN transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])) ELSE CAST(array() AS ARRAY<BIGINT>) END"
NONE = "CAST(array() AS ARRAY<BIGINT>)"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __text, __lines (lines with a word) and the base figures."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.withColumn("__text", text).withColumn("__words", words_of(F.col("__text")))
    d = d.withColumn("__lines", F.expr("filter(split(__text, '\n'), x -> x rlike '[^ \\\\x09-\\\\x0D]')"))
    d = d.withColumn("__grams", F.expr(GRAMS))
    d = d.withColumn("__bits", F.length(F.bin(F.size("__grams").cast("long"))))
    # most texts repeat no window: they skip the sorted form
    d = d.withColumn("__packed", F.expr(f"CASE WHEN size(array_distinct(__grams)) < size(__grams) THEN {PACKED} ELSE {NONE} END"))
    d = d.withColumn("__places", F.expr(PLACES)).withColumn("n_repeat_words", F.expr(REPEATED).cast("long"))
    d = d.withColumn("n_words", F.size("__words").cast("long")).withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    d = d.withColumn("n_symbols", F.length(F.regexp_replace("__text", "[^#*$%&|<>]+", "")).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.drop("__words", "__grams", "__bits", "__packed", "__places")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, kept and clean_text (the lines left)."""
    taken = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept", "clean_text"}
    docs = docs.select(*[c for c in docs.columns if c not in taken - {id_col, text_col, host_col}])
    d = measured(docs, text_col)
    norm = "xxhash64(regexp_replace(lower(trim(regexp_replace(x, '[ \\\\x09-\\\\x0D]+', ' '))), '[0-9]', '0'))"
    keys = [F.col(f"`{id_col}`").alias("__id"), F.xxhash64("__text").alias("__print"), F.col(f"`{host_col}`").alias("__host")]
    lines = d.select(*keys, F.explode(F.expr(f"transform(__lines, x -> named_struct('line', {norm}, 'words', size(array_remove(split(x, '[ \\\\x09-\\\\x0D]+'), ''))))")).alias("l"))
    lines = lines.select("__id", "__print", "__host", "l.*")
    often = lines.select("line", "__host", "__print").distinct().groupBy("line", "__host").count().filter(F.col("count") > limit).select("line", F.col("__host").alias("__host2"))
    gone = lines.join(often, (lines.line == often.line) & lines["__host"].eqNullSafe(F.col("__host2")), "left_semi")
    lost = gone.groupBy("__id", "__print", "__host").agg(F.sum("words").alias("n_lost_words"), F.collect_set("line").alias("__gone"))
    lost = lost.select(F.col("__id").alias("__i2"), F.col("__print").alias("__p2"), F.col("__host").alias("__h2"), "n_lost_words", "__gone")
    d = d.withColumn("__print", F.xxhash64("__text"))
    out = d.join(lost, (F.col("__print") == F.col("__p2")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__i2")) & F.col(f"`{host_col}`").eqNullSafe(F.col("__h2")), "left")
    out = out.withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0)).cast("long"))
    # one comparison over both sides of the join: as two conditions, the first would be pushed down and its figures computed again inside it
    lost = F.when(F.col("base_failed"), F.col("n_words") + 1).otherwise(F.col("n_lost_words"))
    out = out.withColumn("kept", lost <= F.lit(min(depleted, 1.0)) * F.col("n_words"))
    clean = F.expr(f"CASE WHEN __gone IS NULL THEN __text ELSE array_join(filter(split(__text, '\n'), x -> NOT array_contains(__gone, {norm})), '\n') END")
    return out.withColumn("clean_text", clean).drop("__text", "__lines", "__print", "__i2", "__p2", "__h2", "__gone")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS x FROM d),
lw AS (SELECT *, regexp_replace(lower(trim(regexp_replace(x, '[ \x09-\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g') AS line,
  len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM lw GROUP BY doc_id),
often AS (SELECT line, source FROM lw GROUP BY line, source HAVING count(DISTINCT t) > {LIMIT}),
lost AS (SELECT doc_id, sum(n) AS n_lost FROM lw SEMI JOIN often USING (line, source) GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= {DEPLETED} * n_words AS kept FROM base
"""
