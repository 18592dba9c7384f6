"""Exact removal of repeated byte strings with suffix arrays.

Seeds (see `windows`) are 20-byte grams: the smallest hash, leftmost on ties, among those inside a 50-byte window.
Each shard of stretches builds one suffix array by Larsson-Sadakane refinement: suffixes are ranked by their first
eight bytes, then only groups that are still tied are sorted again by the rank `h` bytes on, with `h` doubling.
Kasai's common prefixes follow from the permuted form: only places where the preceding bytes differ are compared, the
rest lose one byte for each step. Neighbours with a common prefix of 50 bytes or more hold one window, and the smallest
document of such a block has it first. A shard is built as arrays of whole seeds of some `shard_bytes` together; they share no
window. Only a seed above `shard_bytes` gets several arrays, whose sorted windows are merged.

Defined cases: null and empty texts have no window; a null id sorts after all others and rows with equal ids never
remove each other; repeated rows are both kept or both cut; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .windows import Runs, Scheme, remove_repeated_windows

U = np.uint64
GRAM = 20
BLOCK = 1 << 16
HOT = 20_000
PART = 0xFF
SHARD_BYTES = 1 << 19


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the 20 bytes from every position on."""
    x = b.astype(U)
    x = x[:-1] | (x[1:] << U(8))
    x = x[:-2] | (x[2:] << U(16))
    e = x[:-4] | (x[4:] << U(32))
    n = len(b) - GRAM + 1
    h = e[:n] * A.C1
    h ^= h >> U(32)
    h += e[8: 8 + n]
    h *= A.C2
    h ^= h >> U(29)
    h += x[16: 16 + n]
    h *= A.C3
    h ^= h >> U(32)
    h *= A.C1
    h ^= h >> U(31)
    return h


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a byte text, by Larsson-Sadakane refinement from eight bytes on."""
    n = len(text)
    key = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U)
    for k in (1, 2, 4):
        key = (key[:-k] << U(8 * k)) | key[k:]
    key = key[:n]
    # a shorter suffix comes before one that goes on with zero bytes
    sa = np.lexsort((-np.arange(n), key)) if n < 9 or (text == 0).any() else np.argsort(key)
    k = key[sa]
    tail = np.flatnonzero(sa > n - 8)
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    new[tail] = True
    new[np.minimum(tail + 1, n - 1)] = True
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank[sa] = np.repeat(start, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    h = 8
    while len(open_):
        pos = sa[open_]
        nxt = pos + h
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        first = rank[pos]
        both = (first << 31) | second
        order = np.argsort(both)  # ties stay open
        pos, both = pos[order], both[order]
        sa[open_] = pos
        new = np.ones(len(pos), bool)
        new[1:] = both[1:] != both[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(pos)))
        rank[pos] = np.repeat(open_[start], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order (0 for the first): Kasai's rule by positions."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    fresh = (before <= 0) | (pos == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = text[rest - 1] != text[before[rest] - 1]
    at = np.flatnonzero(fresh & (before >= 0))
    e = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U)
    for k in (1, 2, 4):
        e = e[:-k] | (e[k:] << U(8 * k))
    length = np.zeros(n, np.int64)
    p, q, here = at.copy(), before[at].copy(), at
    while len(here):
        room = np.minimum(n - p, n - q)
        diff = e[np.minimum(p, n)] ^ e[np.minimum(q, n)]
        same = (np.bitwise_count((diff & (~diff + U(1))) - U(1)) >> 3).astype(np.int64)  # equal bytes, 8 if all are
        same = np.minimum(same, room)
        length[here] += same
        go = (same == 8) & (room > 8)
        p, q, here = p[go] + 8, q[go] + 8, here[go]
    base = np.where(fresh, pos + length, 0)
    base = np.maximum.accumulate(base) - pos
    base[before < 0] = 0
    return np.maximum(base, 0)[sa]


def whole_characters(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrink spans of UTF-8 bytes until they begin and end between characters."""
    start, end, padded = start.copy(), end.copy(), np.append(buf, np.uint8(0))
    for _ in range(3):
        start += ((padded[start] & 0xC0) == 0x80) & (start < end)
        end -= ((padded[end] & 0xC0) == 0x80) & (start < end)
    return start, end


class ByteWindows(Scheme):
    """Windows of `width` bytes."""

    def __init__(self, width: int, shard_bytes: int, whole_chars: bool = False):
        self.width, self.shard_bytes, self.whole_chars = width, shard_bytes, whole_chars

    def runs(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Runs]:
        n, w = len(buf), self.width
        inside = w - GRAM + 1
        firsts, wheres = [], []
        for lo in range(0, n - w + 1, BLOCK):
            hi = min(lo + BLOCK, n - w + 1)
            h = gram_hashes(buf[lo: hi + w - 1])
            key = (h & ~U((1 << 20) - 1)) | np.arange(len(h), dtype=U)
            where = (A.sliding_min(key, inside) & U((1 << 20) - 1)).astype(np.int64)
            go = np.zeros(len(where), bool)
            go[1:] = where[1:] == where[:-1]
            at = A.runs_of(go)
            firsts.append(at + lo)
            wheres.append(np.stack([where[at] + lo, h[where[at]].view(np.int64)]))
        if not firsts:
            z = np.zeros(0, np.int64)
            return buf, Runs(z, z, z, z.astype(U), z, z)
        first, where = np.concatenate(firsts), np.concatenate(wheres, axis=1)
        seed, where = where[1].view(U), where[0]
        last = np.append(first[1:], n - w + 1)
        # a run ends where its document does; windows that reach into the next document go
        row = np.searchsorted(off, first, "right") - 1
        keep = last > first
        first, last, where, seed, row = first[keep], last[keep], where[keep], seed[keep], row[keep]
        spill = np.flatnonzero(last > off[row + 1])
        more = []
        for i in spill:  # at most one run crosses each document's end
            r, end = row[i] + 1, last[i]
            while r < len(off) - 1 and off[r] < end:
                if off[r + 1] > off[r]:
                    more.append((off[r], min(end, off[r + 1]), where[i], seed[i], r))
                r += 1
        if more:
            m = list(zip(*more))
            first, last = np.append(first, m[0]), np.append(np.minimum(last, off[row + 1]), m[1])
            where, seed, row = np.append(where, m[2]), np.append(seed, np.array(m[3], U)), np.append(row, m[4])
        last = np.minimum(last, off[row + 1] - w + 1)
        keep = last > first
        first, last, seed, row = first[keep], last[keep], seed[keep], row[keep]
        return buf, Runs(row, first - off[row], last - first, seed, first, last + w - 1)

    def units(self, buf, off):
        return np.diff(off)

    def single(self, buf: np.ndarray, r: Runs) -> Runs:
        of = np.repeat(np.arange(len(r.row)), r.count)
        step = A.spread_ranges(np.zeros(len(r.row), np.int64), r.count)
        start = r.start[of] + step
        return Runs(r.row[of], r.first[of] + step, np.ones(len(of), np.int64), r.seed[of], start, start + self.width)

    def earliest(self, data, off, seed, least):
        w = self.width
        lens = np.diff(off)
        woff = np.concatenate([[0], np.cumsum(lens - w + 1)])
        early = np.repeat(least, lens - w + 1)
        order = np.argsort(seed, kind="stable")
        s = seed[order]
        several = np.zeros(len(s), bool)
        several[1:] |= s[1:] == s[:-1]
        several[:-1] |= s[1:] == s[:-1]
        todo = order[several]  # a stretch that is alone with its seed shares no window
        kept, now = [], -1
        for owner, piece in self._pieces(seed[todo], lens[todo] + 1):
            if owner != now:
                self._merge(early, kept)
                kept, now = [], owner
            piece = todo[piece]
            block, where, best = self._one_array(data, off, woff, least, piece)
            if owner < 0:
                early[where] = best[block]
            else:
                kept.append((block, where, best, self._windows(data, off, woff, piece, block, where, len(best))))
        self._merge(early, kept)
        return woff, early

    def _pieces(self, seed: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Stretches (by seed, with their bytes) for one array each: whole seeds of some `shard_bytes` together (-1), the parts of a larger seed under its number.

        Equal windows have equal seeds, so only the arrays of one seed have to meet."""
        if not len(seed):
            return
        new = np.concatenate([[True], seed[1:] != seed[:-1]])
        start, of = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.add.reduceat(size, start)
        large = total > self.shard_bytes
        before = np.cumsum(size) - size
        room = np.where(large[of], before - before[start][of], before[start][of]) // self.shard_bytes
        cut = (room[1:] != room[:-1]) | (new[1:] & (large[of[1:]] | large[of[:-1]]))
        for piece in np.split(np.arange(len(seed)), np.flatnonzero(cut) + 1):
            yield (int(of[piece[0]]) if large[of[piece[0]]] else -1), piece

    def _merge(self, early: np.ndarray, kept: list[tuple]) -> None:
        """The smallest key of each window over the arrays of one seed: their sorted windows are merged once."""
        if not kept:
            return
        windows = np.concatenate([x[3] for x in kept])
        order = np.argsort(windows, kind="stable")  # merges sorted runs
        new = np.ones(len(order), bool)
        for a in range(1, len(order), BLOCK):
            new[a: a + BLOCK] = windows[order[a: a + BLOCK]] != windows[order[a - 1: min(a + BLOCK, len(order)) - 1]]
        start = np.flatnonzero(new)
        best = np.concatenate([x[2] for x in kept])
        best[order] = np.repeat(np.minimum.reduceat(best[order], start), np.diff(np.append(start, len(order))))
        at = 0
        for block, where, mine, _ in kept:
            early[where] = best[at: at + len(mine)][block]
            at += len(mine)

    def _one_array(self, data, off, woff, least, piece):
        """Blocks of equal windows of some contents: block of each window, the window's place, smallest key of each block."""
        w = self.width
        lens = off[piece + 1] - off[piece]
        text = np.full(int((lens + 1).sum()), PART, np.uint8)
        begin = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        text[A.spread_ranges(begin, lens)] = A.gather(data, off[piece], lens)
        sa = suffix_array(text)
        lcp = common_prefixes(text, sa)
        holds = np.full(len(text), -1, np.int64)
        owner = np.repeat(np.arange(len(piece)), lens - w + 1)
        at = A.spread_ranges(begin, lens - w + 1)
        holds[at] = owner
        mine = holds[sa]
        block = np.cumsum(lcp < w) - 1
        keep = np.flatnonzero(mine >= 0)
        block, mine, pos = block[keep], mine[keep], sa[keep]
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        start = np.flatnonzero(new)
        best = np.minimum.reduceat(least[piece[mine]], start)
        return np.cumsum(new) - 1, woff[piece[mine]] + pos - begin[mine], best

    def _windows(self, data, off, woff, piece, block, where, blocks):
        """The distinct windows of an array in its order, as fixed-width strings (a closing byte keeps trailing zeros)."""
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        content = np.searchsorted(woff, where[first], "right") - 1
        start = off[content] + where[first] - woff[content]
        out = np.ones((blocks, self.width + 1), np.uint8)
        out[:, :-1] = data[start[:, None] + np.arange(self.width)]
        return out.view(f"S{self.width + 1}").ravel()

    def cut(self, key, text, spans) -> Iterator[dict]:
        buf, off = A.column_bytes(text)
        for a, b in A.row_chunks(off):
            lo, hi = np.searchsorted(spans["row"], [a, b])
            s = spans[lo:hi]
            row = s["row"].astype(np.int64)
            start, end = off[row] + s["start"], off[row] + s["end"]
            if self.whole_chars:
                start, end = whole_characters(buf, start, end)
            edge = np.zeros(int(off[b] - off[a]) + 1, np.int8)
            edge[start - off[a]] += 1
            edge[end - off[a]] -= 1
            keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
            gone = np.bincount(row - a, weights=end - start, minlength=b - a).astype(np.int64)
            lens = np.diff(off[a: b + 1])
            koff = np.concatenate([[0], np.cumsum(lens - gone)])
            soff = np.searchsorted(row, np.arange(a, b + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(start - off[row]), pa.array(end - off[row])], ["start", "end"])
            yield {"key": key[a:b], "n_bytes": lens, "n_removed": gone, "n_spans": np.diff(soff).astype(np.int64), "spans": pa.ListArray.from_arrays(pa.array(soff), pairs),
                   "kept": A.from_bytes(buf[off[a]: off[b]][keep], koff, pa.large_string()).cast(pa.string()) if self.whole_chars else A.from_bytes(buf[off[a]: off[b]][keep], koff).cast(pa.binary())}


KINDS = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
DDL = "key long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, hot: int = HOT, shard_bytes: int = SHARD_BYTES,
                 whole_chars: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Remove every byte that a `width`-byte string covers which also starts in a document with a smaller id.

    One row for each document: the id, n_bytes, n_removed, n_spans (maximal removed runs), spans, kept (binary), and rest, a struct
    of the columns to carry along. With whole_chars spans shrink to whole characters and kept is a string.
    """
    if width < GRAM + 8:
        raise ValueError(f"width must be {GRAM + 8} or more")
    kinds = KINDS.set(5, pa.field("kept", pa.string())) if whole_chars else KINDS
    ddl = DDL.replace("kept binary", "kept string") if whole_chars else DDL
    out = remove_repeated_windows(docs, ByteWindows(width, shard_bytes, whole_chars), kinds, ddl, id_col, text_col, hot, carry)
    return out.withColumnRenamed("key", id_col)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
