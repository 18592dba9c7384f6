"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage of the training texts (two neighbouring stretches of `stride` words; the stride is at least the longest item, so
each item lies whole in some passage) is a query against the index of all items. Weights are divided by the item's score against itself,
so one threshold serves all items. A passage is dropped if the largest weights of its terms cannot reach the threshold
(the WAND bound); then every block of items whose block maxima cannot reach it is skipped; what is left is scored in full. All
items at or above the threshold are retrieved. Each retrieved pair is verified on words: at least `overlap` of the five-word
shingles of the item's question (its first four fifths) and of its answer (the rest) are in the passage.

The items are the bounded side: they are read in slices of `SLICE_BYTES` of text at most and each slice is one pass over the texts, so
the index in a task has a fixed bound. Item count, mean length and document frequencies are Spark aggregates over all items, so no score depends
on how the items are sliced. The texts are never shuffled.

Defined cases: null and empty texts have no passage; null and empty items are never retrieved; repeated rows and ids are
judged each by itself; a null id stays null; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import arrays as A
from .tables import keyed, named_id
from .units import text_chunks

U = np.uint64
K1, B = 1.2, 0.75
BLOCK = 16
SHINGLE = 5
RETRIEVE, OVERLAP = 0.5, 0.8
STRIDE = 64
SLICE_BYTES = 8 << 20


def _csr(rows: np.ndarray, n: int, *values: np.ndarray):
    order = np.argsort(rows, kind="stable")
    return (np.searchsorted(rows[order], np.arange(n + 1)), *(v[order] for v in values))


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of five neighbouring words (of all, if there are fewer)."""
    k = min(SHINGLE, len(words))
    if not k:
        return words
    out = np.zeros(len(words) - k + 1, U)
    for i in range(k):
        out = A.mix(out * A.C1 + words[i: i + len(out)])
    return np.unique(out)


def shared(part: np.ndarray, own: np.ndarray, have: np.ndarray) -> float:
    """Share of a part's shingles that a passage has; a part under five words is there as a whole or not."""
    if len(part) >= SHINGLE:
        return float(np.isin(shingles(part), have).mean())
    hit = np.ones(max(0, len(own) - len(part) + 1), bool)
    for j in range(len(part)):
        hit &= own[j: j + len(hit)] == part[j]
    return float(hit.any())


class Statistics:
    """What BM25 weighs by: the number of all items, their mean length, and in how many of them a slice's terms occur."""

    def __init__(self, items: int, mean: float, term: np.ndarray, found: np.ndarray):
        order = np.argsort(term)
        self.items, self.mean, self.term, self.found = items, mean, term[order], found[order]

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.term, terms)]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct term of an item, and one without a term that holds its length."""
    for batch in batches:
        buf, off = A.column_bytes(batch.column("text").cast(pa.large_string()))
        w = A.Words(buf, off, A.LOOSE)
        length = np.diff(w.first)
        item = np.repeat(np.arange(len(length)), length)
        pair = np.unique(np.stack([item.astype(U), w.hashes(A.FOLD)], 1), axis=0) if len(item) else np.zeros((0, 2), U)
        part = batch.column("part").to_numpy()
        some = np.flatnonzero(length)
        at = np.concatenate([pair[:, 0].astype(np.int64), some])
        term = pa.array(np.concatenate([pair[:, 1], np.zeros(len(some), U)]).view(np.int64), mask=np.arange(len(at)) >= len(pair))
        words = pa.array(np.concatenate([np.zeros(len(pair), np.int64), length[some]]))
        yield pa.RecordBatch.from_arrays([pa.array(part[at]), term, words], ["part", "term", "words"])


class ItemIndex:
    """Postings, block maxima and term maxima of a slice of items, weighed by the statistics of all items."""

    def __init__(self, ids: list, texts: list[str], every: Statistics):
        buf, off = A.column_bytes(pa.array(texts, pa.large_string()))
        w = A.Words(buf, off, A.LOOSE)
        h = w.hashes(A.FOLD)
        length = np.diff(w.first)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]  # items of like length share a block
        self.ids = [ids[i] for i in order]
        self.words = [h[w.first[i]: w.first[i + 1]] for i in order]
        self.length = length[order]
        n = len(order)
        self.terms = np.unique(np.concatenate(self.words)) if n else np.zeros(0, U)
        if not n:
            return
        item = np.repeat(np.arange(n), self.length)
        term = np.searchsorted(self.terms, np.concatenate(self.words))
        pair, tf = np.unique(term * n + item, return_counts=True)
        term, item = pair // n, pair % n
        df = every.of(self.terms)
        weight = np.log1p((every.items - df + 0.5) / (df + 0.5))[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.length / every.mean)[item])
        weight = (weight / np.bincount(item, weights=weight, minlength=n)[item]).astype(np.float32)
        self.blocks = ceil(n / BLOCK)
        pair, where = np.unique(term * self.blocks + item // BLOCK, return_inverse=True)
        top = np.zeros(len(pair), np.float32)
        np.maximum.at(top, where, weight)
        self.block_at, self.block, self.block_top = _csr(pair // self.blocks, len(self.terms), pair % self.blocks, top)
        self.item_at, self.item, self.weight = _csr(term, len(self.terms), item, weight)
        self.top = np.maximum.reduceat(self.weight, self.item_at[:-1])
        cut = np.maximum(1, (self.length * 4) // 5)
        self.question = [x[:c] for x, c in zip(self.words, cut)]
        self.answer = [x[c:] if len(x) > c else x[-1:] for x, c in zip(self.words, cut)]


def _sums(group: np.ndarray, place: np.ndarray, wide: int, value: np.ndarray, least: float):
    """Sums of value by (group, place); those of at least `least`."""
    key, where = np.unique(group * wide + place, return_inverse=True)
    total = np.bincount(where, weights=value)
    good = total >= least
    return key[good] // wide, key[good] % wide, total[good]


def search(index: ItemIndex, buf: np.ndarray, off: np.ndarray, stride: int, retrieve: float, overlap: float) -> list[tuple]:
    """(text, item, score, question overlap, answer overlap) of all verified pairs, the best passage of each."""
    w = A.Words(buf, off, A.LOOSE)
    h = w.hashes(A.FOLD)
    if not len(h) or not len(index.terms):
        return []
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == h)
    n = np.diff(w.first)
    halves = np.concatenate([[0], np.cumsum(-(-n // stride))])  # stretches of each text
    text = np.searchsorted(w.first, known, "right") - 1
    half = halves[text] + (known - w.first[text]) // stride
    vocabulary = len(index.terms)
    pair = np.unique(half * vocabulary + at[known])
    half, term = pair // vocabulary, pair % vocabulary
    total = int(halves[-1])
    bound = np.bincount(half, weights=index.top[term], minlength=total + 1)
    # passage p is the stretches p and p + 1 of one text; the last stretch alone if it is the only one
    follows = np.zeros(total, bool)
    follows[:-1] = np.searchsorted(halves, np.arange(total - 1), "right") == np.searchsorted(halves, np.arange(1, total), "right")
    both = bound[:-1] + np.where(follows, bound[1:], 0)
    passage = np.flatnonzero(both >= retrieve)
    if not len(passage):
        return []
    first = np.searchsorted(half, np.arange(total + 2))
    lens = first[passage + 1 + follows[passage]] - first[passage]
    owner = np.repeat(np.arange(len(passage)), lens)
    pair = np.unique(owner * vocabulary + term[A.spread_ranges(first[passage], lens)])
    owner, terms = pair // vocabulary, pair % vocabulary
    many = index.block_at[terms + 1] - index.block_at[terms]
    where = A.spread_ranges(index.block_at[terms], many)
    po, block, _ = _sums(np.repeat(owner, many), index.block[where], index.blocks, index.block_top[where], retrieve)
    if not len(po):
        return []
    left = np.isin(owner, po)
    owner, terms = owner[left], terms[left]
    many = index.item_at[terms + 1] - index.item_at[terms]
    where = A.spread_ranges(index.item_at[terms], many)
    group, item = np.repeat(owner, many), index.item[where]
    open_ = np.isin(group * index.blocks + item // BLOCK, po * index.blocks + block)
    group, item, score = _sums(group[open_], item[open_], len(index.ids), index.weight[where][open_], retrieve)
    best: dict[tuple[int, int], tuple] = {}
    for g, i, s in zip(group, item, score):
        p = passage[g]
        t = int(np.searchsorted(halves, p, "right") - 1)
        a = w.first[t] + (p - halves[t]) * stride
        own = h[a: min(a + 2 * stride, w.first[t + 1])]
        have = shingles(own)
        q = shared(index.question[i], own, have)
        r = shared(index.answer[i], own, have)
        if q >= overlap and r >= overlap and (s, q, r) > best.get((t, i), (0,)):
            best[t, i] = (float(s), float(q), float(r))
    return [(t, index.ids[i], *v) for (t, i), v in sorted(best.items())]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  retrieve: float = RETRIEVE, overlap: float = OVERLAP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Verified leaks: the document's id, item_id, score (BM25 over the item's own), question_overlap, answer_overlap."""
    bench = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).filter("length(text) > 0").distinct()
    size, longest = bench.agg(F.sum(F.octet_length("text") + 64), F.max(F.size(F.split("text", "[^A-Za-z0-9\\x80-\\uffff]+")))).first()
    base = keyed(docs, id_col, text_col)
    slices = max(1, ceil((size or 0) / slice_bytes))
    bench = bench.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)).cast("int"))
    # the same statistics for every slice, so a score does not depend on which items lie beside an item
    terms = cut_lineage(bench.select("part", "text").mapInArrow(_item_terms, "part int, term long, words long"))
    n, mean = terms.filter("term IS NULL").agg(F.count("*"), F.avg("words")).first()
    often = terms.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    found = []
    for k in range(slices):
        rows = bench.filter(F.col("part") == k).orderBy("item_id", "text").collect()
        own = terms.filter((F.col("part") == k) & F.col("term").isNotNull()).select("term").distinct().join(often, "term").toArrow()  # a slice's terms
        index = ItemIndex([r[0] for r in rows], [r[1] for r in rows], Statistics(n, mean or 1.0, own["term"].to_numpy().view(U), own["n"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], index=index, stride=max(STRIDE, longest or 0)) -> Iterator[pa.RecordBatch]:
            for batch, text in text_chunks(batches):
                buf, off = A.column_bytes(text)
                hits = search(index, buf, off, stride, retrieve, overlap)
                key = batch.column("key").to_pylist()
                rows = [(key[t], *rest) for t, *rest in hits]
                names = ["key", "item_id", "score", "question_overlap", "answer_overlap"]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        found.append(base.mapInArrow(run, "key long, item_id long, score double, question_overlap double, answer_overlap double"))
    return reduce(DataFrame.unionByName, found).select(named_id().alias(id_col), "item_id", "score", "question_overlap", "answer_overlap")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
