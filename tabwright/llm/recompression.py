"""Removal of repeated word sequences by recompression.

Every text becomes a row of symbols, one for each word. Rounds replace short runs of one symbol and then pairs (a, b) with a
in the round's left class and b in its right class; the class is a bit of the symbol's name, so whether two
neighbours join depends on them alone. A name is a 64-bit value computed from what it stands for, hence all tasks of
all rounds give equal things equal names without exchanging a table of pairs (that table would be as large as the
text in the first round). Equal word sequences therefore have equal symbols inside, but for a margin: with spans of
at most `CAP` words, `MARGIN` words at either end. Five neighbouring symbols form one high-level symbol; every window of 50
words holds a whole one behind its margins. The smallest name among these (leftmost on ties) is the window's seed
(see `windows`), and only high-level symbols that more than one document has are followed up.

The repeats are verified exactly: a shard names words, then pairs of names of 1, 2, 4, 8, 16 words by sorting, so two windows
get one name only if all words agree. Names of the first stage can thus cost work if two collide, never a wrong cut.

Defined cases: null and blank texts have no word; a null id sorts after all others and rows with equal ids never remove
each other; repeated rows are both kept or both cut; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .windows import Runs, Scheme, remove_repeated_windows

U = np.uint64
RUN, CAP = 2, 4
#: what a round can change at an end: a run of RUN words, then a symbol of RUN words, then one of CAP words
MARGIN = RUN + RUN + CAP
HIGH = 5
WIDTH = 50
HOT = 20_000
PLACE = U(28)


def _named(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros(len(parts[0]), U)
    for p in parts:
        x = A.mix(x * A.C1 + p)
    return x


def compress_runs(name: np.ndarray, at: np.ndarray, text: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace maximal runs of one symbol that span RUN words at most. at: first word of each symbol; text: its row."""
    if not len(name):
        return name, at, text
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    many = np.diff(np.append(start, len(name)))
    span = np.diff(np.append(at[start], end))
    short = (many > 1) & (span <= RUN)
    keep = np.ones(len(name), bool)
    inner = A.spread_ranges(start[short] + 1, many[short] - 1)
    keep[inner] = False
    out = name.copy()
    out[start[short]] = _named(name[start[short]], many[short].astype(U), np.full(int(short.sum()), 7, U))
    return out[keep], at[keep], text[keep]


def compress_pairs(name: np.ndarray, at: np.ndarray, text: np.ndarray, end: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace neighbours of which the first is in the left and the second in the right class, up to CAP words."""
    if len(name) < 2:
        return name, at, text
    side = (name >> U(20 + turn)) & U(1)
    stop = np.append(at, end)
    join = np.zeros(len(name), bool)
    join[:-1] = (side[:-1] == 0) & (side[1:] == 1) & (text[1:] == text[:-1]) & (stop[2:] - stop[:-2] <= CAP)
    first = np.flatnonzero(join)
    out = name.copy()
    out[first] = _named(name[first], name[first + 1])
    keep = np.ones(len(name), bool)
    keep[first + 1] = False
    return out[keep], at[keep], text[keep]


def high_symbols(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words and closing words of the high-level symbols of texts (first: first word of each, rows + 1)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(word))
    name, at, text = compress_runs(word, at, text, len(word))
    for turn in range(2):
        name, at, text = compress_pairs(name, at, text, len(word), turn)
    m = len(name) - HIGH + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z
    whole = np.flatnonzero(text[:m] == text[HIGH - 1:])
    stop = np.append(at, len(word))
    # the symbols of a text tile it, so the next symbol's start closes this one, also at the end of a text
    return _named(*(name[k: k + m][whole] for k in range(HIGH))), at[:m][whole], stop[HIGH: HIGH + m][whole]


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words with one space after each (none after those marked last), and where each begins."""
    lens = end - start + 1
    begin = np.concatenate([[0], np.cumsum(lens)])
    padded = np.append(buf, np.uint8(32))
    out = A.gather(padded, start, lens)
    out[begin[1:] - 1] = 32
    if last is not None and last.any():
        keep = np.ones(len(out), bool)
        keep[begin[1:][last] - 1] = False
        out = out[keep]
    return out, begin


class WordWindows(Scheme):
    """Windows of `width` words."""

    def __init__(self, width: int):
        self.width = width

    def runs(self, buf, off):
        w = A.Words(buf, off)
        words, first, width = w.hashes(), w.first, self.width
        norm, begin = joined(buf, w.start, w.end)
        name, at, stop = high_symbols(words, first)
        windows = np.maximum(np.diff(first) - width + 1, 0)
        p = A.spread_ranges(first[:-1], windows)
        if not len(p):
            z = np.zeros(0, np.int64)
            return norm, Runs(z, z, z, z.astype(U), z, z)
        lo = np.searchsorted(at, np.arange(len(words) + 1))[p + MARGIN]
        hi = np.searchsorted(stop, np.arange(len(words) + 1), "right")[p + width - MARGIN] - 1
        packed = (name & ~((U(1) << PLACE) - U(1))) | np.arange(len(name), dtype=U)
        levels = [packed]
        while (1 << len(levels)) <= width:
            step = 1 << (len(levels) - 1)
            prev = levels[-1]
            nxt = prev.copy()
            if len(prev) > step:
                nxt[:-step] = np.minimum(prev[:-step], prev[step:])
            levels.append(nxt)
        size = hi - lo + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        best = np.empty(len(p), U)
        for k in range(len(levels)):
            m = np.flatnonzero(level == k)
            if len(m):
                best[m] = np.minimum(levels[k][lo[m]], levels[k][hi[m] - (1 << k) + 1])
        where = (best & ((U(1) << PLACE) - U(1))).astype(np.int64)
        row = np.repeat(np.arange(len(off) - 1), windows)
        go = np.zeros(len(p), bool)
        go[1:] = (where[1:] == where[:-1]) & (row[1:] == row[:-1])
        s = A.runs_of(go)
        count = np.diff(np.append(s, len(p)))
        word = p[s]
        return norm, Runs(row[s], word - first[row[s]], count, name[where[s]], begin[word], begin[word + count + width - 1] - 1)

    def units(self, buf, off):
        return np.diff(A.Words(buf, off).first)

    def single(self, buf, r):
        # content words are parted by one space: each window starts after one of the first count - 1 spaces
        data, first, count = [], [], []
        rows = []
        for i in range(len(r.row)):
            b = buf[r.start[i]: r.end[i]]
            gap = np.flatnonzero(b == 32)
            start = np.concatenate([[0], gap + 1])
            end = np.append(gap, len(b))
            n = int(r.count[i])
            first.append(r.first[i] + np.arange(n))
            data.append(np.stack([start[:n], end[self.width - 1: self.width - 1 + n]]) + r.start[i])
            rows.append(np.full(n, i))
        of = np.concatenate(rows)
        cut = np.concatenate(data, axis=1)
        return Runs(r.row[of], np.concatenate(first), np.ones(len(of), np.int64), r.seed[of], cut[0], cut[1])

    def earliest(self, data, off, seed, least):
        width = self.width
        w = A.Words(data, off)
        count = np.diff(w.first)
        woff = np.concatenate([[0], np.cumsum(count - width + 1)])
        early = np.repeat(least, np.diff(woff))
        order = np.argsort(seed, kind="stable")
        s = seed[order]
        several = np.zeros(len(s), bool)
        several[1:] |= s[1:] == s[:-1]
        several[:-1] |= s[1:] == s[:-1]
        todo = np.sort(order[several])
        if not len(todo):
            return woff, early
        at = A.spread_ranges(w.first[todo], count[todo])
        name = A.gather_bytes(data, w.start[at], w.end[at]).dictionary_encode().indices.to_numpy().astype(np.int64)
        span = 1
        while span * 2 <= width:
            name = self._pairs(name, span)
            span *= 2
        if span < width:
            name = self._pairs(name, width - span)
        begin = np.concatenate([[0], np.cumsum(count[todo])])[:-1]
        many = count[todo] - width + 1
        name = name[A.spread_ranges(begin, many)]
        owner = np.repeat(least[todo], many)
        best = np.full(int(name.max()) + 1, (1 << 63) - 1, np.int64)
        np.minimum.at(best, name, owner)
        early[A.spread_ranges(woff[todo], many)] = best[name]
        return woff, early

    @staticmethod
    def _pairs(name: np.ndarray, apart: int) -> np.ndarray:
        """Names of the pairs (name[i], name[i + apart]), counted from 0. Past the end a pair is the name alone."""
        second = np.zeros(len(name), np.int64)
        second[: len(name) - apart] = name[apart:] + 1
        return np.unique((name << 32) | second, return_inverse=True)[1]

    def cut(self, key, text, spans) -> Iterator[dict]:
        buf, off = A.column_bytes(text)
        for a, b in A.row_chunks(off):
            part = buf[off[a]: off[b]]
            w = A.Words(part, off[a: b + 1] - off[a])
            lo, hi = np.searchsorted(spans["row"], [a, b])
            s = spans[lo:hi]
            row = s["row"].astype(np.int64) - a
            edge = np.zeros(len(w) + 1, np.int8)
            edge[w.first[row] + s["start"]] += 1
            edge[w.first[row] + s["end"]] -= 1
            kept = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
            first = np.searchsorted(kept, w.first)
            last = np.zeros(len(kept), bool)
            last[first[1:][np.diff(first) > 0] - 1] = True
            data, _ = joined(part, w.start[kept], w.end[kept], last)
            lens = np.concatenate([[0], np.cumsum(w.end[kept] - w.start[kept] + 1 - last)])
            soff = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(s["start"].astype(np.int64)), pa.array(s["end"].astype(np.int64))], ["start", "end"])
            n = np.diff(w.first)
            yield {"key": key[a:b], "n_words": n, "n_removed": n - np.diff(first), "spans": pa.ListArray.from_arrays(pa.array(soff), pairs),
                   "kept": A.from_bytes(data, lens[first], pa.large_string()).cast(pa.string())}


KINDS = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
DDL = "key long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"


def recompression_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """Remove every word that a window of `width` words covers whose words also start in a document with a smaller id.

    One row for each document: the id, n_words, n_removed, spans (removed runs, in words), kept (kept words joined by one space).
    """
    if width < 2 * MARGIN + (HIGH + 1) * CAP - 1:
        raise ValueError(f"width must be {2 * MARGIN + (HIGH + 1) * CAP - 1} or more")
    out = remove_repeated_windows(docs, WordWindows(width), KINDS, DDL, id_col, text_col, hot)
    return out.withColumnRenamed("key", id_col)


def op4_recompression_dedup(spark, sf_dir: str) -> DataFrame:
    out = recompression_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
