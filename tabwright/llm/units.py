"""Tokenising large columns through their distinct words: each task encodes a distinct piece once and gathers the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import arrays as A


class Encoded:
    """Answers for the distinct items of a chunk: values of all, with start and length of each, and which item each position is."""

    def __init__(self, values: np.ndarray, start: np.ndarray, lens: np.ndarray, index: np.ndarray):
        self.values, self.start, self.lens = values, start[index], lens[index]
        self.ends = np.concatenate([[0], np.cumsum(self.lens)])

    def gather(self) -> np.ndarray:
        return A.gather(self.values, self.start, self.lens)


class _Generation:
    """Answers by piece: for each kind the values one after another."""

    def __init__(self, kinds: list):
        self.pieces = pa.array([], pa.large_binary())
        self.values = [np.zeros(0, k) for k in kinds]
        self.off = [np.zeros(1, np.int64) for _ in kinds]

    def __len__(self) -> int:
        return len(self.pieces)

    def add(self, pieces: pa.Array, values: list[np.ndarray], lens: list[np.ndarray]) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.values = [np.concatenate([a, b]) for a, b in zip(self.values, values)]
        self.off = [np.concatenate([o, o[-1] + np.cumsum(x)]) for o, x in zip(self.off, lens)]

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece, -1 for new ones."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def parts(self, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        lens = [o[at + 1] - o[at] for o in self.off]
        return [A.gather(v, o[at], x) for v, o, x in zip(self.values, self.off, lens)], lens


class Memo:
    """What a worker has encoded lately. Beyond `entries` the older half goes, so its memory is bounded; frequent pieces move along.

    encode takes pieces and gives, for each kind of answer, the values one after another and their numbers."""

    def __init__(self, encode: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], kinds: list, entries: int = 120_000):
        self.encode, self.kinds, self.entries = encode, kinds, entries
        self.new, self.old = _Generation(kinds), _Generation(kinds)

    def answers(self, pieces: pa.Array) -> list[Encoded]:
        """Encode a binary column through its distinct values; one Encoded for each kind."""
        code = pieces.cast(pa.large_binary()).dictionary_encode()
        index, distinct = code.indices.to_numpy().astype(np.int64), code.dictionary
        if len(self.new) > self.entries:
            self.new, self.old = _Generation(self.kinds), self.new
        where = self.new.find(distinct)
        for known in (True, False):
            lost = np.flatnonzero(where < 0)
            missing = distinct.take(pa.array(lost))
            if known:
                at = self.old.find(missing)
                lost, missing = lost[at >= 0], missing.filter(pa.array(at >= 0))
                values, lens = self.old.parts(at[at >= 0])
            elif len(missing):
                values, lens = (list(x) for x in zip(*self.encode(missing.to_pylist())))
            if len(missing):
                where[lost] = len(self.new) + np.arange(len(missing))
                self.new.add(missing, values, lens)
        return [Encoded(v, o[where], o[where + 1] - o[where], index) for v, o in zip(self.new.values, self.new.off)]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = A.CHUNK) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with at most `limit` bytes of text (one row at least), null texts as empty ones."""
    for batch in batches:
        text = batch.column(column).cast(pa.large_string())
        _, off = A.column_bytes(text)
        for a, b in A.row_chunks(off, limit):
            yield batch.slice(a, b - a), text.slice(a, b - a)
