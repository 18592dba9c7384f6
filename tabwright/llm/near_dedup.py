"""Near-duplicate documents: MinHash with tensored banding, confirmed on whole shingle sets.

Two collections of `tables` sub-keys are computed, each sub-key from two minimum hashes; every pair of a sub-key of the
first and one of the second is a table key. So tables x tables tables of four hashes need 4 x tables hashes. Two sets of similarity s
share no table key with a probability of about 2 (1 - s^2)^tables: 5e-6 at 0.85 with ten.

1. Groups of documents reduce equal sets to their smallest document, and equal table keys to the smallest document with that
   key, before anything is sent; a key's bucket meets a key once a group at most. Each document with a key is joined
   to the key's smallest one (stars, never pairs). The components of these candidate edges hold every candidate pair.
2. The members' whole sets go to their component, one for each distinct set (sets with equal 128-bit fingerprints are linked at once). A component above `BLOCK` members is
   cut into blocks, and each pair of blocks is a task of its own. A task counts all intersections exactly by products of
   0/1 matrices, keeps pairs with 100 * intersection >= threshold * union, and sends a spanning star of them.
3. Components of the confirmed links give each document the smallest id it can reach.

Defined cases: texts without words (null, blank) have no set and are linked with nothing; rows with a null id have no name,
so they are linked with nothing, keep a null component and are kept; rows with equal ids count as one document, the first
by text is kept; equal texts are linked; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import arrays as A
from .components import components
from .tables import GROUP_BYTES, LAST, grouped, keyed, named_id, part_of, text_bytes
from .windows import _batches, _released, _rows_by, in_order, in_order_with

U = np.uint64
SHINGLE = 5
TABLES = 10
BLOCK = 1024
COLUMNS = 4096
SLICE = 128
THRESHOLD = 85
FACTORS = A.mix(np.arange(1, 4 * TABLES + 1, dtype=U) * A.C1) | U(1)


def shingle_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and each text's first shingle (rows + 1). Fewer than five words make one shingle."""
    w = A.Words(buf, off)
    words = w.hashes(A.FOLD)
    n = np.diff(w.first)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    at = A.spread_ranges(w.first[:-1], many)
    row = np.repeat(np.arange(len(n)), many)
    left = w.first[1:][row] - at
    out = np.zeros(len(at), U)
    for k in range(SHINGLE):
        step = np.where(k < left, words[np.minimum(at + k, max(len(words) - 1, 0))], U(0)) if len(words) else out
        out = A.mix(out * A.C1 + step + U(k))
    return out, np.concatenate([[0], np.cumsum(many)])


def sets_of(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    h, first = shingle_hashes(buf, off)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]


def table_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Table keys of non-empty sets: sets x (tables * tables)."""
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    least = np.stack([np.minimum.reduceat(flat * f, start) for f in FACTORS])
    sub = A.mix(least[0::2] * A.C2 + least[1::2])
    one, two = sub[:TABLES].T, sub[TABLES:].T
    place = np.arange(TABLES * TABLES, dtype=U).reshape(TABLES, TABLES)
    return A.mix(one[:, :, None] * A.C1 + two[:, None, :] + place).reshape(len(sets), -1)


def _distinct(ids: np.ndarray, text: pa.Array, wanted=None):
    """Distinct non-empty sets of a group with their smallest id, and (id, smallest id) of equal sets."""
    buf, off = A.column_bytes(text)
    first: dict[bytes, int] = {}
    equal = []
    for a, b in A.row_chunks(off):
        rows = np.arange(a, b)
        if wanted is not None:
            rows = rows[wanted[a:b]]
            if not len(rows):
                continue
        lens = off[rows + 1] - off[rows]
        part = buf[A.spread_ranges(off[rows], lens)] if wanted is not None else buf[off[a]: off[b]]
        for i, s in zip(rows, sets_of(part, np.concatenate([[0], np.cumsum(lens)]))):
            if len(s) and ids[i] != LAST:
                k = s.tobytes()
                rep = first.setdefault(k, int(ids[i]))  # ids ascend
                if rep != ids[i]:
                    equal.append((int(ids[i]), rep))
    return first, np.array(equal, np.int64).reshape(-1, 2)


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit numbers for each whole set."""
    return np.array([[int(np.add.reduce(A.mix(s))), int(np.bitwise_xor.reduce(A.mix(s ^ A.C2))) ^ len(s)] for s in sets], U).reshape(-1, 2)


def _sketch(buckets: int):
    def sketch(key, table):
        ids, text = in_order(table)
        first, equal = _distinct(ids, text)
        rows = []
        edges = np.zeros((0, 2), np.int64)
        if first:
            rep = np.fromiter(first.values(), np.int64, len(first))
            sets = [np.frombuffer(k, "<u8") for k in first]
            prints = _fingerprints(sets)
            for b, at in _rows_by(A.bucket_of(A.mix(prints[:, 0]), buckets)):
                rows.append((b, None, A.pack(rep[at]), A.pack(prints[at]), None, None))
            keys, reps = [], []
            for a in range(0, len(sets), 256):
                k = table_keys(sets[a: a + 256])
                keys.append(k.ravel())
                reps.append(np.repeat(rep[a: a + 256], k.shape[1]))
            keys, reps = np.concatenate(keys), np.concatenate(reps)
            order = np.lexsort((reps, keys))
            keys, reps = keys[order], reps[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            least = reps[new][np.cumsum(new) - 1]
            edges = np.unique(np.stack([reps, least], 1)[reps != least], axis=0)
            keys, reps = keys[new], reps[new]
            for b, at in _rows_by(A.bucket_of(keys, buckets)):
                rows.append((b, A.pack(keys[at]), A.pack(reps[at]), None, None, None))
        if len(edges) or len(equal):
            rows.append((key[0].as_py() % buckets, None, None, None, A.pack(edges), A.pack(equal)))
        return _batches("bucket int, keys binary, least binary, prints binary, edges binary, equal binary", rows)
    return sketch


def _edge_table(*kinds: np.ndarray) -> pa.Table:
    """Distinct edges; those of the second array, if given, are marked as between equal sets."""
    each = [np.unique(e, axis=0) if len(e) else e for e in kinds]
    out = np.concatenate(each).astype(np.int64)
    table = pa.table({"u": out[:, 0], "v": out[:, 1]})
    return table.append_column("equal", pa.array(np.repeat([False, True], [len(e) for e in each]))) if len(kinds) > 1 else table


def _to_smallest(order: np.ndarray, same: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Edges from each document to the first of its run in a sorted order."""
    new = np.append(True, ~same) if len(order) else np.zeros(0, bool)
    least = least[order]
    star = least[new][np.cumsum(new) - 1] if len(order) else least
    return np.stack([least, star], 1)[least != star]


def _stars(table):
    """A bucket of table keys and fingerprints: each document with a key is joined to the smallest one."""
    lists = table.to_pydict()
    keys = [(A.unpack(k, "<u8"), A.unpack(m, "<i8")) for k, m in zip(lists["keys"], lists["least"]) if k is not None]
    prints = [(A.unpack(k, "<u8").reshape(-1, 2), A.unpack(m, "<i8")) for k, m in zip(lists["prints"], lists["least"]) if k is not None]
    edges = [A.unpack(x, "<i8").reshape(-1, 2) for x in lists["edges"] if x is not None] + [np.zeros((0, 2), np.int64)]
    equal = [A.unpack(x, "<i8").reshape(-1, 2) for x in lists["equal"] if x is not None] + [np.zeros((0, 2), np.int64)]
    if keys:
        k, least = (np.concatenate(x) for x in zip(*keys))
        order = np.lexsort((least, k))
        edges.append(_to_smallest(order, k[order][1:] == k[order][:-1], least))
    if prints:
        k, least = (np.concatenate(x) for x in zip(*prints))
        order = np.lexsort((least, k[:, 1], k[:, 0]))
        edges.append(e := _to_smallest(order, (k[order][1:] == k[order][:-1]).all(1), least))
        equal.append(e)
    return _edge_table(np.concatenate(edges), np.concatenate(equal))


def _members(key, docs, nodes):
    """Sets of a group's documents that stand for a set in some candidate component."""
    kinds = pa.schema([("root", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("set", pa.binary())])
    if not docs.num_rows or not nodes.num_rows:
        return kinds.empty_table()
    ids, text = in_order(docs)
    node = nodes["node"].to_numpy()
    order = np.argsort(node)
    node, root, n = node[order], nodes["root"].to_numpy()[order], nodes["n"].to_numpy()[order]
    at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
    first, _ = _distinct(ids, text, node[at] == ids)
    rep = np.fromiter(first.values(), np.int64, len(first))
    at = np.searchsorted(node, rep)
    return pa.table({"root": root[at], "n": n[at], "key": rep, "set": pa.array(list(first), pa.binary())}, schema=kinds)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: int) -> np.ndarray:
    """Which sets are alike: exact intersections by products of 0/1 matrices over the shingles that at least two have."""
    sets = left + (right or [])
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(count > 1) - 1
    use = count[column] > 1
    rows, column = rows[use], often[column[use]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    a = len(left)
    both = np.zeros((a, len(sets) - a if right is not None else a), np.float32)
    x = np.empty((len(sets), min(COLUMNS, int(often[-1]) + 1)), np.float32)
    for lo in range(0, int(often[-1]) + 1, COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        x[:] = 0
        x[rows[i:j], column[i:j] - lo] = 1
        for r in range(0, a, SLICE):
            both[r: min(r + SLICE, a)] += x[r: min(r + SLICE, a)] @ (x[a:] if right is not None else x).T
    del x
    size = np.array([len(s) for s in sets], np.int64)
    one, two = size[:a], size[a:] if right is not None else size
    links = np.zeros(both.shape, bool)
    for r in range(0, a, SLICE):  # a few rows at a time: whole numbers of all pairs are eight bytes each
        inter = np.rint(both[r: r + SLICE]).astype(np.int64)
        links[r: r + SLICE] = 100 * inter >= threshold * (one[r: r + SLICE, None] + two[None, :] - inter)
    return links


def _spanning(keys: np.ndarray, links: np.ndarray, split: int | None) -> np.ndarray:
    """Edges that join what the links join: each member with the smallest one it reaches."""
    n = len(keys)
    label = np.arange(n)
    big = n
    while True:
        if split is None:
            near = np.where(links, label[None, :], big).min(1)
        else:
            near = np.concatenate([np.where(links, label[None, split:], big).min(1), np.where(links.T, label[None, :split], big).min(1)])
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return np.stack([keys, keys[label]], 1)[label != np.arange(n)]


def _confirm(threshold: int):
    def confirm(table):
        edges = [np.zeros((0, 2), np.int64)]
        where = np.stack([table[c].to_numpy() for c in ("root", "low", "high")], 1)
        keys, mine, raw = table["key"].to_numpy(), table["mine"].to_numpy(), table["set"]
        order = np.lexsort((keys, *where.T[::-1]))
        cut = np.flatnonzero((np.diff(where[order], axis=0) != 0).any(1)) + 1
        for at in np.split(order, cut):
            low, high = where[at[0]][1:]
            ids, side = keys[at], mine[at]
            sets = [np.frombuffer(raw[int(i)].as_py(), "<u8") for i in at]
            if low == high:
                if len(ids) > 1:
                    edges.append(_spanning(ids, linked_pairs(sets, None, threshold), None))
                continue
            one, two = np.flatnonzero(side == low), np.flatnonzero(side == high)
            if len(one) and len(two):
                edges.append(_spanning(np.concatenate([ids[one], ids[two]]), linked_pairs([sets[i] for i in one], [sets[i] for i in two], threshold), len(one)))
        return _edge_table(np.concatenate(edges))
    return confirm


def _labels(key, docs, roots):
    kinds = pa.schema([("key", pa.int64()), ("n_shingles", pa.int64()), ("component", pa.int64()), ("kept", pa.bool_())])
    carried = [c for c in ("rest",) if c in docs.column_names]
    if carried:
        kinds = kinds.append(pa.field("text", pa.string())).append(docs.schema.field("rest"))
    if not docs.num_rows:
        return kinds.empty_table()
    ids, text, order_of_rows = in_order_with(docs)
    buf, off = A.column_bytes(text)
    n = np.concatenate([np.fromiter((len(s) for s in sets_of(buf[off[a]: off[b]], off[a: b + 1] - off[a])), np.int64, b - a) for a, b in A.row_chunks(off)])
    node = roots["node"].to_numpy()
    order = np.argsort(node)
    node, root = np.append(node[order], LAST), np.append(roots["root"].to_numpy()[order], LAST)
    at = np.searchsorted(node, ids)
    component = np.where(node[at] == ids, root[at], ids)
    again = np.zeros(len(ids), bool)
    again[1:] = ids[1:] == ids[:-1]
    kept = (ids == LAST) | ((component == ids) & ~again)
    out = {"key": ids, "n_shingles": n, "component": component, "kept": kept}
    if carried:
        out |= {"text": docs["text"].take(order_of_rows), "rest": docs["rest"].take(order_of_rows)}
    return pa.table(out, schema=kinds)


def minhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= threshold * union.

    One row for each document: the id, n_shingles, component_id (smallest id reachable), kept (it is that one), and,
    if columns are to be carried along, text and rest (a struct of them).
    """
    base = keyed(docs, id_col, text_col, carry)
    groups = max(64, ceil(text_bytes(base) / GROUP_BYTES))
    parts = grouped(base, groups)
    sketches = parts.groupBy("part").applyInArrow(_released(_sketch(groups), 2), "bucket int, keys binary, least binary, prints binary, edges binary, equal binary")
    edges = cut_lineage(sketches.groupBy("bucket").applyInArrow(_released(_stars, 1), "u long, v long, equal boolean"))
    equal = edges.filter("equal").select("u", "v")
    # one member for each distinct set: what is equal to a smaller document goes along with that one
    candidates = components(edges.select("u", "v")).join(equal.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    size = candidates.groupBy("root").agg(F.count("*").alias("n"))
    nodes = candidates.join(size, "root").filter("n > 1").withColumn("part", part_of("node", groups))
    members = parts.groupBy("part").cogroup(nodes.groupBy("part")).applyInArrow(_released(_members, 3), "root long, n long, key long, set binary")
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "key", "set")
    tasks = max(64, ceil(candidates.count() / 256))
    members = members.withColumn("task", F.pmod(F.xxhash64("root", "low", "high"), F.lit(tasks)).cast("int"))
    links = members.groupBy("task").applyInArrow(_released(_confirm(threshold), 1), "u long, v long").unionByName(equal)
    roots = components(links).withColumn("part", part_of("node", groups))
    out = parts.groupBy("part").cogroup(roots.groupBy("part")).applyInArrow(
        _released(_labels, 3), "key long, n_shingles long, component long, kept boolean" + (f", text string, rest {base.schema['rest'].dataType.simpleString()}" if carry else ""))
    return out.select(named_id().alias(id_col), "n_shingles", named_id("component").alias("component_id"), "kept", *(["text", "rest"] if carry else []))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
