"""Toxicity by two Kneser-Ney models of bytes, one of toxic and one of ordinary texts.

Both models are of order five over lower-cased bytes; an expression counts once for each distinct text that holds it, so neither a
word that one text repeats nor copies of a text weigh more. A class's model discounts its counts by D and gives what it
saves to a backoff that both share: the continuation model of four bytes (in how many contexts a byte follows three others),
itself backed off to the share of byte types. An expression that no text of either class holds is left to the context
weights of the two models, the backoff being the same. Every place has its log-likelihood ratio, times the chance that the classes
differ there: a logistic function of Dunning's log-likelihood statistic around `EVIDENCE` (of the context's counts where the expression is
unseen). None is left out, but those far below `EVIDENCE` weigh little: plain ratios at every place rank worse (README). A text's figure is the mean over its places.

Counts cover every labelled row that may teach, but for an eighth of them: on all of these the threshold is chosen (running totals over
their figures), since rows that were counted look too good. Counting reduces in the tasks first, then by context buckets, and the ratio table is built
by grouped aggregates. It goes to the scoring tasks whole, in slices of about `ENTRIES` rows by a hash of the context, one pass over the texts
for each slice; a text's sums over the slices are added.

Defined cases: null and empty texts have figure 0; labels that are null or not 0 or 1, and documents without one, teach nothing;
several labels of one id count as their largest; if a class is missing every score is 0.5; a null id is never held out; repeated rows get
the same score; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import running_totals
from ..session import cut_lineage
from . import arrays as A
from .preference_quality import CUT, fold_of, teachers
from .tables import keyed, named_id
from .units import text_chunks

U = np.uint64
ORDER = 5
DISCOUNT = 0.75
ENTRIES = 1 << 20
EVIDENCE = 30.0
HELD_PART = 8
#: the codes of contexts lie beyond those of expressions
CONTEXT = 1 << 8 * ORDER
BUCKETS = 64


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the five bytes at every place and each text's first (rows + 1). A blank stands before each text."""
    size = np.diff(off)
    text = np.insert(A.FOLD[buf], off[:-1], 32)
    at = off + np.arange(len(off))
    many = np.maximum(size + 1 - ORDER + 1, 0)
    if len(text) < ORDER:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    x = text.astype(U)
    n = len(x) - ORDER + 1
    code = np.zeros(n, U)
    for k in range(ORDER):
        code = (code << U(8)) | x[k: k + n]
    first = np.concatenate([[0], np.cumsum(many)])
    return code[A.spread_ranges(at[:-1], many)], first


def _sum(code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    c = code[order]
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    return c[start], np.add.reduceat(counts[order], start, axis=0) if len(c) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by class of a task's texts, reduced; sent by bucket of the context."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows():
        code, counts = _sum(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        bucket = A.bucket_of(A.mix(code >> U(8)), BUCKETS)
        order = np.argsort(bucket, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(at):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket[at[0]]], pa.int32()), "codes": pa.array([A.pack(code[at])], pa.binary()), "counts": pa.array([A.pack(counts[at].astype("<i4"))], pa.binary())})
    for batch, text in text_chunks(batches):
        label = batch.column("label").to_numpy()
        code, first = grams(*A.column_bytes(text))
        row = np.repeat(np.arange(len(label)), np.diff(first))
        once = np.unique((row.astype(U) << U(8 * ORDER)) | code)
        toxic = label[(once >> U(8 * ORDER)).astype(np.int64)]
        both, n = np.unique(((once & U((1 << 8 * ORDER) - 1)) << U(1)) | toxic.astype(U), return_counts=True)
        held.append(_sum(both >> U(1), np.stack([n * ((both & U(1)) == 0), n * ((both & U(1)) == 1)], 1)))
        if sum(len(h[0]) for h in held) > 1 << 21:
            held[:] = [_sum(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
            if len(held[0][0]) > 1 << 20:
                yield from rows()
                held.clear()
    if held:
        yield from rows()


def _merge(table):
    code = np.concatenate([A.unpack(x, "<u8") for x in table["codes"].to_pylist()])
    counts = np.concatenate([A.unpack(x, "<i4").reshape(-1, 2) for x in table["counts"].to_pylist()]).astype(np.int64)
    code, counts = _sum(code, counts)
    return pa.table({"code": code.astype(np.int64), "plain": counts[:, 0], "toxic": counts[:, 1]})


def ratios(counts: DataFrame, discount: float = DISCOUNT, evidence: float = EVIDENCE) -> DataFrame:
    """code, ratio and weight (the evidence) of every expression, and of every context (its code plus `CONTEXT`) for what is unseen after it."""
    g = counts.select("*", F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND((1 << 32) - 1).alias("tail"))
    tails = g.groupBy("tail").agg(F.count("*").alias("k")).withColumn("mid", F.shiftright("tail", 8)).withColumn("byte", F.col("tail").bitwiseAND(255))
    mids = tails.groupBy("mid").agg(F.sum("k").alias("k_mid"), F.count("*").alias("types"))
    byte = tails.groupBy("byte").agg(F.count("*").alias("k_byte"))  # at most 256 rows
    every = tails.agg(F.count("*").alias("k_all"))
    shared = tails.join(mids, "mid").join(F.broadcast(byte), "byte").join(F.broadcast(every))
    shared = shared.select("tail", ((F.col("k") - discount + discount * F.col("types") * F.col("k_byte") / F.col("k_all")) / F.col("k_mid")).alias("back"))
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    contexts = g.groupBy("context").agg(F.sum("plain").alias("plain_all"), F.sum("toxic").alias("toxic_all"), seen("plain").alias("plain_types"), seen("toxic").alias("toxic_types"))
    totals = counts.agg((F.sum("toxic") / F.sum(F.col("toxic") + F.col("plain"))).alias("share"))

    def weight(plain: str, toxic: str) -> Column:
        n = F.col(plain) + F.col(toxic)
        part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * share))).otherwise(0.0)
        return 2 * (part(toxic, F.col("share")) + part(plain, 1 - F.col("share")))
    left = lambda c: F.when(F.col(f"{c}_all") > 0, discount * F.col(f"{c}_types") / F.col(f"{c}_all")).otherwise(1.0)
    of = lambda c: F.greatest(F.col(c) - discount, F.lit(0.0)) / F.greatest(F.col(f"{c}_all"), F.lit(1)) + left(c) * F.col("back")
    seen_ones = g.join(contexts, "context").join(shared, "tail").join(F.broadcast(totals)).withColumn("weight", weight("plain", "toxic"))
    seen_ones = seen_ones.select("code", (F.log(of("toxic")) - F.log(of("plain"))).alias("ratio"), "weight")
    unseen = contexts.join(F.broadcast(totals)).withColumn("weight", weight("plain_all", "toxic_all"))
    unseen = unseen.select((F.col("context") + F.lit(CONTEXT)).alias("code"), (F.log(left("toxic")) - F.log(left("plain"))).alias("ratio"), "weight")
    chance = 1 / (1 + F.exp((evidence - F.col("weight")) / 2))
    return seen_ones.unionByName(unseen).withColumn("ratio", F.col("ratio") * chance)


def in_slice(table: DataFrame, slices: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th part of a ratio table (code, ratio) as sorted arrays; a context and what follows it share a part."""
    context = F.when(F.col("code") >= CONTEXT, F.col("code") - CONTEXT).otherwise(F.shiftright("code", 8))
    rows = table.filter(F.pmod(F.xxhash64(context), F.lit(slices)) == k).select("code", F.col("ratio").cast("float")).toPandas().sort_values("code")
    return rows["code"].to_numpy().astype(U), rows["ratio"].to_numpy().astype(np.float32)


def measured(base: DataFrame, table: DataFrame, entries: int) -> DataFrame:
    """key and figure of every row of base, by the whole table."""
    table = cut_lineage(table)
    slices = max(1, -(-table.count() // entries))
    # equal rows have equal sums: with several slices they are told by two hashes of the text and counted
    texts = base.select("key", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"), "text")
    found = []
    for k in range(slices):
        model = Lookup(*in_slice(table, slices, k))
        found.append(cut_lineage(texts.mapInArrow(_scorer(model), "key long, one long, two long, figure double")))
    if slices == 1:
        return found[0].select("key", "figure")
    each = reduce(DataFrame.unionByName, found).groupBy("key", "one", "two").agg(F.sum("figure").alias("figure"), (F.count("*") / slices).cast("long").alias("n"))
    return each.select("key", (F.col("figure") / F.col("n")).alias("figure"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).select("key", "figure")


class Lookup:
    """Ratios by code: an open-addressed table at most half full."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(2 * len(code) + 1))) + 1)
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, U)
        self.values = np.zeros(1 << self.bits, np.float32)
        self.probes, slot, left = 0, self.slot(code), np.arange(len(code))
        while len(left):
            s = (slot[left] + self.probes) & ((1 << self.bits) - 1)
            free = self.keys[s] == np.iinfo(np.uint64).max
            _, one = np.unique(s[free], return_index=True)
            put = left[free][one]
            where = s[free][one]
            self.keys[where], self.values[where] = code[put], value[put]
            left = np.setdiff1d(left, put)
            self.probes += 1

    def __reduce__(self):
        """Tasks get the rows and build the table themselves."""
        have = self.keys != np.iinfo(np.uint64).max
        return Lookup, (self.keys[have], self.values[have])

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * A.C1) >> U(64 - self.bits)).astype(np.int64)

    def get(self, code: np.ndarray) -> np.ndarray:
        """Values; not a number where unknown."""
        out = np.full(len(code), np.nan, np.float32)
        left, slot = np.arange(len(code)), self.slot(code)
        for p in range(self.probes):
            s = (slot + p) & ((1 << self.bits) - 1)
            k = self.keys[s]
            hit = k == code[left]
            out[left[hit]] = self.values[s[hit]]
            go = np.flatnonzero(~hit & (k != np.iinfo(np.uint64).max))
            left, slot = left[go], slot[go]
        return out


def figures(buf: np.ndarray, off: np.ndarray, model: Lookup) -> np.ndarray:
    """Mean log-likelihood ratio of each text."""
    code, first = grams(buf, off)
    ratio = model.get(code)
    unseen = np.flatnonzero(np.isnan(ratio))
    ratio[unseen] = np.nan_to_num(model.get((code[unseen] >> U(8)) + U(CONTEXT)))
    upto = np.concatenate([[0], np.cumsum(ratio, dtype=np.float64)])
    return (upto[first[1:]] - upto[first[:-1]]) / np.maximum(np.diff(first), 1)


def threshold(check: DataFrame) -> tuple[float, float] | None:
    """The cut with the best F1 for the toxic class, and a slope, from label and figure of every row; None without both classes."""
    means = {r["label"]: r["mean"] for r in check.groupBy("label").agg(F.avg("figure").alias("mean")).collect()}  # at most two rows
    if len(means) < 2:
        return None
    each = cut_lineage(check.groupBy((-F.col("figure")).alias("down")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("hit")))
    positives = each.agg(F.sum("hit")).first()[0]
    f1 = 2 * F.col("cum_hit") / (F.col("cum_n") + positives)
    best = running_totals(each, "down", ["n", "hit"]).agg(F.max(F.struct(f1.alias("f1"), (-F.col("down")).alias("figure"), (-F.coalesce("next_value", "down")).alias("next"))).alias("b")).first()["b"]
    return (best["figure"] + best["next"]) / 2, 4 / (means[1] - means[0] + 1e-12) if means[1] > means[0] else 1.0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2,
             entries: int = ENTRIES) -> DataFrame:
    """One row for each document: the id, held_out, score."""
    base = keyed(docs, id_col, text_col)
    known = teachers(labels, id_col, label_col, folds, held)
    # one id for each distinct text: copies teach once
    prints = base.select("key", F.xxhash64("text").alias("print")).filter(F.coalesce(fold_of("key", folds) != held, F.lit(False))).join(known, "key")
    known = cut_lineage(prints.groupBy("print").agg(F.min("key").alias("key"), F.max("label").alias("label")).select("key", "label"))
    aside = F.pmod(F.xxhash64("key"), F.lit(HELD_PART)) == 0
    taught = base.filter(F.coalesce(fold_of("key", folds) != held, F.lit(False)) & ~aside).join(known.filter(~aside), "key")
    counts = taught.select("text", "label").mapInArrow(_count, "bucket int, codes binary, counts binary").groupBy("bucket").applyInArrow(_merge, "code long, plain long, toxic long")
    counts = cut_lineage(counts)
    rest = known.filter(aside)
    plain, toxic = counts.agg(F.sum("plain"), F.sum("toxic")).first()
    out, cut, slope, shift = base.select("key", F.lit(0.0).alias("figure")), 0.0, 0.0, 0.0
    if plain and toxic:
        out = measured(base, ratios(counts), entries)
        slope, shift = 1.0, float(np.log(CUT / (1 - CUT)))
        cut, slope = threshold(cut_lineage(out.join(rest, "key").select("label", "figure"))) or (cut, slope)
    out = out.withColumn("key", named_id())
    score = 1 / (1 + F.exp(-(F.lit(slope) * (F.col("figure") - F.lit(cut)) + F.lit(shift))))
    return out.select(F.col("key").alias(id_col), F.coalesce(fold_of("key", folds) == held, F.lit(False)).alias("held_out"), score.alias("score"))


def _scorer(model: Lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_chunks(batches, limit=1 << 20):
            names = ["key", "one", "two"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(figures(*A.column_bytes(text), model))], [*names, "figure"])
    return run


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
