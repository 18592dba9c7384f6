"""Removal of fixed-width windows that an earlier document holds: the exchanges that two operators share.

A window is `width` consecutive units (bytes or words) of one document. Both operators pick, for every window, one
seed inside it from its content alone, so equal windows have equal seeds, wherever they stand. The work runs in
five passes over groups of whole documents (all read one exchange of the documents):

1. seeds:    every group sends its distinct seed hashes to hash buckets; a bucket answers which of them more than
             one document has. Only windows with such a seed can repeat. Fingerprints of the texts go along: a copy
             of a smaller document is covered as a whole and sends nothing further.
2. contents: a group cuts the stretches of windows with the same shared seed, drops equal stretches (all but the
             smallest document's are covered at once) and sends each distinct one to its seed's bucket.
3. shards:   a bucket finds, for every window of its stretches, the smallest document that has it. How is the
             operator's own method (`Scheme.earliest`).
4. spans:    what is covered goes back to the groups as unit spans.
5. cut:      the groups remove the covered units.

A seed that `hot` or more documents share is not sent as stretches but window by window, to buckets of the
window's own hash, so no bucket holds the contexts of one passage that many documents quote. Equal stretches and
windows are reduced in their group first, so a bucket meets each at most once a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .tables import GROUP_BYTES, grouped, keyed, named_id, text_bytes

U = np.uint64
SEEDS = "bucket int, part int, hashes binary, counts binary, prints binary, least binary"
ANSWER = "part int, shared binary, hot binary, prints binary, least binary"
SENT = "bucket int, part int, data binary, lens binary, seed binary, least binary, item binary, row binary, at binary, spans binary"
SPANS = "part int, spans binary"
#: windows looked at together in a shard
WINDOWS = 1 << 20
SPAN = np.dtype([("row", "<i4"), ("start", "<i8"), ("end", "<i8")])


@dataclass
class Runs:
    """Stretches of windows with one seed: row, first unit in the row, number of windows, seed hash, byte slice of the content."""
    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def take(self, at: np.ndarray) -> "Runs":
        return Runs(*(getattr(self, k)[at] for k in ("row", "first", "count", "seed", "start", "end")))


class Scheme:
    """What an operator defines: units, seeds, and the search inside a shard. Instances travel to the tasks."""
    width = 50
    schema = ""

    def runs(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Runs]:
        """Normalised bytes that the slices refer to, and the stretches of all windows."""
        raise NotImplementedError

    def units(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Units of each text."""
        raise NotImplementedError

    def single(self, buf: np.ndarray, runs: Runs) -> Runs:
        """The same windows as stretches of one window each."""
        raise NotImplementedError

    def earliest(self, data: np.ndarray, off: np.ndarray, seed: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct contents: windows of each (contents + 1 offsets), and the smallest key that has each window."""
        raise NotImplementedError

    def cut(self, key: np.ndarray, text: pa.Array, spans: np.ndarray) -> Iterator[dict]:
        """Final columns of a group, in pieces; spans (SPAN) refer to units."""
        raise NotImplementedError


def in_order(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Keys and texts of a group in an order that every pass repeats: by key, then text."""
    return in_order_with(table)[:2]


def in_order_with(table: pa.Table) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Keys, texts and the row numbers that put the table into this order."""
    key = table["key"].to_numpy().astype(np.int64)
    text = table["text"].cast(pa.large_string()).combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
    text = pc.fill_null(text, "")
    order = np.argsort(key, kind="stable")
    if len(key) > 1 and (np.diff(key[order]) == 0).any():
        order = pc.sort_indices(pa.table({"k": key, "t": text}), [("k", "ascending"), ("t", "ascending")]).to_numpy()
    return key[order], text.take(pa.array(order)), pa.array(order)


def _prints(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """128-bit fingerprints of texts."""
    raw = memoryview(np.ascontiguousarray(buf))
    return np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off[:-1], off[1:])), "<u8").reshape(-1, 2)


def _first_of(prints: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by print, starts of equal ones, smallest key of each."""
    order = np.lexsort((key, prints[:, 1], prints[:, 0]))
    p = prints[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]).any(1)
    start = np.flatnonzero(new)
    return order, start, key[order][start]


def _bucket(seed: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of seeds. They are the smallest hashes of their windows, so without mixing nearly all would share the first few."""
    return A.bucket_of(A.mix(seed), buckets)


def _rows_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, edge) if len(order) else []:
        yield int(bucket[at[0]]), at


def _batches(schema: str, rows: list[tuple]) -> pa.Table:
    names = [x.strip().split(" ") for x in schema.split(",")]
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(names)})


def _seed_rows(scheme: Scheme, buckets: int):
    """Pass 1 of a group: bucket, part, seed hashes whose lowest bit says that several rows here have it, and their row counts."""
    def seeds(key, table):
        part = key[0].as_py()
        ids, text = in_order(table)
        buf, off = A.column_bytes(text)
        found = []
        for a, b in A.row_chunks(off):
            _, r = scheme.runs(buf[off[a]: off[b]], off[a: b + 1] - off[a])
            one = np.lexsort((r.row, r.seed))
            h, row = r.seed[one], r.row[one]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            found.append(h[new])
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, U), return_counts=True)
        mark = (h & ~U(1)) | (n > 1).astype(U)
        rows = []
        for b, at in _rows_by(_bucket(h & ~U(1), buckets)):
            rows.append((b, part, A.pack(mark[at]), A.pack(n[at][n[at] > 1].astype("<u4")), None, None))
        prints = _prints(buf, off)
        order, start, least = _first_of(prints, ids)
        prints = prints[order[start]]
        for b, at in _rows_by(A.bucket_of(prints[:, 0], buckets)):
            rows.append((b, part, None, None, A.pack(prints[at]), A.pack(least[at])))
        return _batches(SEEDS, rows)
    return seeds


def _copies(table) -> list[tuple]:
    """Which groups hold texts that a smaller document of another group has."""
    if not table.num_rows:
        return []
    each = [A.unpack(x, "<u8").reshape(-1, 2) for x in table["prints"].to_pylist()]
    keys = [A.unpack(x, "<i8") for x in table["least"].to_pylist()]
    part = np.repeat(table["part"].to_numpy(), [len(x) for x in keys])
    prints, key = np.concatenate(each), np.concatenate(keys)
    order, start, least = _first_of(prints, key)
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(start, len(key))))
    late = np.flatnonzero(first < key)
    return [(p, None, None, A.pack(prints[late[at]]), A.pack(first[late[at]])) for p, at in _rows_by(part[late])]


def _answer(hot: int):
    """Pass 1 of a bucket: which hashes more than one row has, and which of them very many."""
    def answer(table):
        rows = _copies(table.filter(pc.is_valid(table["prints"])))
        table = table.filter(pc.is_valid(table["hashes"]))
        part = table["part"].to_numpy()
        each = [A.unpack(x, "<u8") for x in table["hashes"].to_pylist()]
        if not each:
            return _batches(ANSWER, rows)
        h = np.concatenate(each)
        n = np.ones(len(h), np.int64)
        n[(h & U(1)) == U(1)] = np.concatenate([A.unpack(x, "<u4") for x in table["counts"].to_pylist()])
        h &= ~U(1)
        order = np.argsort(h, kind="stable")
        s = h[order]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(n[order], begin)
        state = np.zeros(len(h), np.int8)
        state[order] = np.repeat((total > 1).astype(np.int8) + (total >= hot), np.diff(np.append(begin, len(s))))
        at = 0
        for i, x in enumerate(each):
            mine, own = h[at: at + len(x)], state[at: at + len(x)]
            at += len(x)
            if own.any():
                rows.append((int(part[i]), A.pack(mine[own > 0]), A.pack(mine[own == 2]), None, None))
        return _batches(ANSWER, rows)
    return answer


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    parts = [A.unpack(x, kind) for x in table[column].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _known(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def _later_copies(prints: np.ndarray, ids: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Rows whose whole text a smaller document has, here or in another group."""
    order, start, least = _first_of(prints, ids)
    known = answers.filter(pc.is_valid(answers["prints"]))
    if known.num_rows:
        there, key = _joined(known, "prints", "<u8").reshape(-1, 2), _joined(known, "least", "<i8")
        both = np.concatenate([prints, there])
        order, start, least = _first_of(both, np.concatenate([ids, key]))
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(start, len(order))))
    return first[: len(ids)] < ids


def _content_rows(scheme: Scheme, buckets: int):
    """Pass 2 of a group: distinct stretches for the seed buckets, and spans that are certain here already."""
    def contents(key, docs, answers):
        part = key[0].as_py() if key[0].as_py() is not None else -1
        shared, hot = np.sort(_joined(answers, "shared", "<u8")), np.sort(_joined(answers, "hot", "<u8"))
        if not docs.num_rows or not len(shared):
            return _batches(SENT, [])
        ids, text = in_order(docs)
        buf, off = A.column_bytes(text)
        copy = _later_copies(_prints(buf, off), ids, answers)
        rows = []
        if copy.any():
            n = np.concatenate([scheme.units(buf[off[a]: off[b]], off[a: b + 1] - off[a]) for a, b in A.row_chunks(off)])
            at = np.flatnonzero(copy & (n >= scheme.width))
            rows.append((int(part) % buckets, part, None, None, None, None, None, None, None, A.pack(_spans(at, np.zeros(len(at), np.int64), n[at]))))
        columns, runs = [], []
        for a, b in A.row_chunks(off):
            norm, r = scheme.runs(buf[off[a]: off[b]], off[a: b + 1] - off[a])
            r = r.take(np.flatnonzero(_known(r.seed & ~U(1), shared) & ~copy[a:b][r.row]))
            much = _known(r.seed & ~U(1), hot)
            kinds = [(r.take(np.flatnonzero(~much)), False)] + ([(scheme.single(norm, r.take(np.flatnonzero(much))), True)] if much.any() else [])
            for q, alone in kinds:
                for lo in range(0, len(q.row), 1 << 14):
                    p = q.take(np.arange(lo, min(lo + (1 << 14), len(q.row))))
                    columns.append(A.gather_bytes(norm, p.start, p.end))
                    p.row = p.row + a
                    if alone:
                        p.seed = np.full(len(p.row), 1, U)
                    runs.append(p)
        if not runs:
            return _batches(SENT, rows)
        r = Runs(*(np.concatenate([getattr(x, k) for x in runs]) for k in ("row", "first", "count", "seed", "start", "end")))
        code = pa.chunked_array(columns).dictionary_encode().unify_dictionaries()
        index = np.concatenate([x.indices.to_numpy() for x in code.chunks]).astype(np.int64)
        data, doff = A.column_bytes(code.chunk(0).dictionary)
        least = np.full(len(doff) - 1, A_LAST, np.int64)
        np.minimum.at(least, index, ids[r.row])
        seed = np.zeros(len(least), U)
        seed[index] = r.seed
        mine = ids[r.row] == least[index]
        certain = np.flatnonzero(~mine)
        if len(certain):
            spans = _spans(r.row[certain], r.first[certain], r.first[certain] + r.count[certain] + (scheme.width - 1))
            rows.append((int(part) % buckets, part, None, None, None, None, None, None, None, A.pack(spans)))
        alone = seed == U(1)
        seed[alone] = slice_hashes(data, doff[:-1][alone], doff[1:][alone]) | U(1)
        bucket = _bucket(seed, buckets)
        entry = np.flatnonzero(mine)
        entry = entry[np.argsort(index[entry], kind="stable")]
        held = index[entry]
        for b, at in _rows_by(bucket):
            lo, hi = np.searchsorted(held, at), np.searchsorted(held, at, "right")
            e = entry[A.spread_ranges(lo, hi - lo)]
            lens = doff[at + 1] - doff[at]
            rows.append((b, part, A.pack(A.gather(data, doff[at], lens)), A.pack(lens.astype("<u4")), A.pack(seed[at]), A.pack(least[at]),
                         A.pack(np.repeat(np.arange(len(at)), hi - lo).astype("<i4")), A.pack(r.row[e].astype("<i4")), A.pack(r.first[e].astype("<i8")), None))
        return _batches(SENT, rows)
    return contents


A_LAST = (1 << 63) - 1


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    w = object.__new__(A.Words)
    w.start, w.end, w.buf = start, end, data
    return w.hashes() if len(start) else np.zeros(0, U)


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans, those of one row that touch or overlap joined."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return np.zeros(0, SPAN)
    wide = int(end.max()) + 2
    s, e = A.merge_spans(start + row.astype(np.int64) * wide, end + row.astype(np.int64) * wide)
    out = np.zeros(len(s), SPAN)
    out["row"] = s // wide
    out["start"], out["end"] = s - out["row"].astype(np.int64) * wide, e - out["row"].astype(np.int64) * wide
    return out


def _shard(scheme: Scheme):
    """Pass 3: one bucket of stretches from all groups."""
    def shard(table):
        plain = [(int(p), s) for p, s in zip(table["part"].to_pylist(), table["spans"].to_pylist()) if s is not None]
        table = table.filter(pc.is_valid(table["data"]))
        if not table.num_rows:
            return _batches(SPANS, plain)
        data = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["data"]])
        table = table.drop_columns(["data"])
        per_row = [A.unpack(x, "<u4") for x in table["lens"].to_pylist()]
        lens = np.concatenate(per_row).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(lens)])
        seed, least = _joined(table, "seed", "<u8"), _joined(table, "least", "<i8")
        code = A.from_bytes(data, off).dictionary_encode()
        index = code.indices.to_numpy().astype(np.int64)
        n = len(code.dictionary)
        best = np.full(n, A_LAST, np.int64)
        np.minimum.at(best, index, least)
        kind = np.zeros(n, U)
        kind[index] = seed
        ddata, doff = A.column_bytes(code.dictionary)
        del data, code
        woff, early = scheme.earliest(ddata, doff, kind, best)
        base = np.concatenate([[0], np.cumsum([len(x) for x in per_row])])
        out = list(plain)
        item = [A.unpack(x, "<i4") for x in table["item"].to_pylist()]
        part, sent = table["part"].to_numpy(), np.repeat(np.arange(table.num_rows), [len(x) for x in item])
        item = np.concatenate(item).astype(np.int64) + base[sent]
        row, at = _joined(table, "row", "<i4").astype(np.int64), _joined(table, "at", "<i8")
        held = index[item]
        many = woff[held + 1] - woff[held]
        for a, b in A.row_chunks(np.concatenate([[0], np.cumsum(many)]), WINDOWS):
            c, n = held[a:b], many[a:b]
            hit = early[A.spread_ranges(woff[c], n)] < np.repeat(least[item[a:b]], n)
            if hit.any():
                pos = A.spread_ranges(at[a:b], n)[hit]
                # rows of all groups at once, numbered through
                rows = int(row[a:b].max()) + 1
                names, code = np.unique(sent[a:b] * rows + row[a:b], return_inverse=True)
                found = _spans(np.repeat(code, n)[hit], pos, pos + scheme.width)
                of = names[found["row"]]
                found["row"] = of % rows
                out += [(int(part[i]), A.pack(found[x])) for i, x in _rows_by(of // rows)]
        return _batches(SPANS, out)
    return shard


def _cut(scheme: Scheme, kinds: pa.Schema):
    def cut(key, docs, spans):
        has_rest = "rest" in docs.column_names
        if not docs.num_rows:
            return (kinds.append(docs.schema.field("rest")) if has_rest else kinds).empty_table()
        ids, text, order = in_order_with(docs)
        got = _joined(spans, "spans", SPAN)
        if len(got):
            got = _spans(got["row"], got["start"], got["end"])
        out = pa.concat_tables([pa.table(x, schema=kinds) for x in scheme.cut(ids, text, got)])
        return out.append_column("rest", docs["rest"].take(order)) if has_rest else out
    return cut


def _released(run, arguments: int):
    """The function of a group, after which the worker gives memory back."""
    def done(*given):
        try:
            return run(*given)
        finally:
            A.release()
    return {1: lambda a: done(a), 2: lambda a, b: done(a, b), 3: lambda a, b, c: done(a, b, c)}[arguments]


def remove_repeated_windows(docs: DataFrame, scheme: Scheme, kinds: pa.Schema, ddl: str, id_col: str, text_col: str, hot: int,
                            carry: list[str] | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The five passes. Columns: key, what the scheme's `cut` gives (`kinds`, `ddl`), and rest, the carried columns."""
    base = keyed(docs, id_col, text_col, carry)
    groups = max(64, ceil(text_bytes(base) / group_bytes))
    parts = grouped(base, groups)
    # every group sends a row to every bucket, so their number counts in rows: seeds are 8 bytes for some 16 of text, stretches about as many bytes as the text
    seeds = parts.groupBy("part").applyInArrow(_released(_seed_rows(scheme, max(64, groups // 4)), 2), SEEDS)
    answers = seeds.groupBy("bucket").applyInArrow(_released(_answer(hot), 1), ANSWER)
    contents = parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_released(_content_rows(scheme, groups), 3), SENT)
    spans = contents.groupBy("bucket").applyInArrow(_released(_shard(scheme), 1), SPANS)
    out = parts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_released(_cut(scheme, kinds), 3), ddl + (f", rest {base.schema['rest'].dataType.simpleString()}" if carry else ""))
    return out.withColumn("key", named_id())
