"""Numpy views of Arrow text columns: bytes, words, packed rows. Small helpers of the tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
CHUNK = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)
#: everything in ASCII but letters and digits parts words
LOOSE = np.ones(256, bool)
LOOSE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def release() -> None:
    """Give memory that a finished group used back to the system: a worker lives on through other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its offsets (rows + 1). Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def row_chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spread_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + len), one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


class Words:
    """Words of a run of texts: start, end (bytes), and for each text its first word (rows + 1)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE):
        inside = ~apart[buf]
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        both = np.zeros(0, np.int64)
        if n:
            edge[1:n] = inside[1:] != inside[:-1]
            edge[0], edge[n] = inside[0], inside[-1]
            cut = np.unique(off[1:-1])
            cut = cut[(cut > 0) & (cut < n)]
            both = cut[inside[cut] & inside[cut - 1]]
            edge[both] = False
        at = np.flatnonzero(edge)
        if len(both):
            at = np.sort(np.concatenate([at, both, both]), kind="stable")
        self.start, self.end, self.buf = at[0::2], at[1::2], buf
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, fold: np.ndarray = PLAIN) -> np.ndarray:
        """A mixed polynomial hash of every word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lens = self.end - self.start
        power = np.full(int(lens.max()), 0xD6E8FEB86659FD93, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        out = np.empty(len(lens), np.uint64)
        for a in range(0, len(lens), 1 << 16):
            s, ln = self.start[a: a + (1 << 16)], lens[a: a + (1 << 16)]
            begin = np.concatenate([[0], np.cumsum(ln)[:-1]])
            where = spread_ranges(np.zeros(len(ln), np.int64), ln)
            x = fold[self.buf[where + np.repeat(s, ln)]].astype(np.uint64)
            x += U(1)
            x *= power[where]
            out[a: a + (1 << 16)] = np.add.reduceat(x, begin)
        out += lens.astype(np.uint64) * C2
        return mix(out)


def gather(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """The given slices, one after another; place numbers are made for a bounded number of items at a time."""
    off = np.concatenate([[0], np.cumsum(lens)])
    out = np.empty(int(off[-1]), buf.dtype)
    a = 0
    while a < len(lens):
        b = max(a + 1, int(np.searchsorted(off, off[a] + step, "right")) - 1)
        if b == a + 1:
            out[off[a]: off[b]] = buf[starts[a]: starts[a] + lens[a]]
        else:
            out[off[a]: off[b]] = buf[spread_ranges(starts[a:b], lens[a:b])]
        a = b
    return out


def gather_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the given slices."""
    lens = ends - starts
    return from_bytes(gather(buf, starts, lens), np.concatenate([[0], np.cumsum(lens)]))


def from_bytes(data: np.ndarray, off: np.ndarray, kind=pa.large_binary()) -> pa.Array:
    """A column of `kind` over contiguous bytes."""
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def unpack(b: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(b or b"", kind)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n-1 by the upper bits of a mixed hash."""
    return (((h >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step:]) if width > step else x


def runs_of(same_as_before: np.ndarray) -> np.ndarray:
    """Starts of the runs, given for each item whether it goes on with the one before."""
    return np.flatnonzero(~same_as_before)


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the half-open spans cover; touching ones join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate([at[1:] - 1, [len(s) - 1]])]
