"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def rows_of(docs):
    return [(LAST if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs]


def covered(units, first, key, width):
    out = bytearray(len(units))
    for i in range(len(units) - width + 1):
        if first[units[i:i + width]] < key:
            out[i:i + width] = b"\1" * width
    return out


def earliest(rows, width):
    first = {}
    for key, units in rows:
        for i in range(len(units) - width + 1):
            w = units[i:i + width]
            first[w] = min(first.get(w, LAST), key)
    return first


def suffix(docs, width=50):
    rows = [(k, t.encode()) for k, t in rows_of(docs)]
    first, out = earliest(rows, width), []
    for key, b in rows:
        c = covered(b, first, key, width)
        spans = len(re.findall(b"\1+", bytes(c)))
        kept = bytes(x for x, gone in zip(b, c) if not gone)
        out.append((None if key == LAST else key, len(b), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(docs, width=50):
    rows = [(k, tuple(WORD.findall(t))) for k, t in rows_of(docs)]
    first, out = earliest(rows, width), []
    for key, w in rows:
        c = covered(w, first, key, width)
        kept = " ".join(x for x, gone in zip(w, c) if not gone)
        out.append((None if key == LAST else key, len(w), sum(c), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def near(docs, threshold=85):
    """Links between all pairs on whole sets, and their components."""
    rows, sets = [], []
    for k, t in rows_of(docs):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t)]
        rows.append(k)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {k: k for k in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if LAST not in (rows[i], rows[j]) and 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(rows[i]), find(rows[j])))
                root[b] = a
    return [(None, len(s), None, True) if k == LAST else (k, len(s), find(k), find(k) == k) for k, s in zip(rows, sets)]


def repeat_words(w):
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    return len({i + o for at in seen.values() if len(at) > 1 for i in at for o in range(3)})


LOOSE = re.compile("[^A-Za-z0-9\x80-\U0010ffff]+")


def loose(t):
    return [x for x in LOOSE.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]


def _shingles(w, k=5):
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()


def leaks(docs, items, overlap=0.8):
    """(doc_id, item_id) whose question and answer are in the document, by a scan of all pairs."""
    out = set()
    for r in docs:
        w = loose(r["text"])
        have = _shingles(w)
        for i in items:
            x = loose(i["text"])
            if not x:
                continue
            c = max(1, len(x) * 4 // 5)
            def there(part):
                if len(part) < 5:
                    return any(w[k:k + len(part)] == part for k in range(len(w) - len(part) + 1))
                return len(_shingles(part) & have) >= overlap * len(_shingles(part))
            ok = there(x[:c]) and there(x[c:] or x[-1:])
            if ok:
                out.add((r["doc_id"], i["item_id"]))
    return out


def whole_chars(b, c):
    """Removed runs of bytes, shrunk to whole characters."""
    out = bytearray(len(c))
    for m in re.finditer(b"\1+", bytes(c)):
        s, e = m.span()
        while s < e and b[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(b) and b[e] & 0xC0 == 0x80:
            e -= 1
        out[s:e] = b"\1" * (e - s)
    return out


def pipeline(docs, items, encode, threshold):
    """Rows (doc_id, ids) after all stages; no line is frequent in so small a table, ids are distinct."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs]
    rows = [(k, t) for k, t in rows for w in [WORD.findall(t)] if len(w) >= 50 and 100 * repeat_words(w) <= 50 * len(w)]
    kept = {r[0] for r in near([{"doc_id": k, "text": t} for k, t in rows], threshold) if r[3]}
    rows = [(k, t) for k, t in rows if k in kept]
    raw = [(k, t.encode()) for k, t in rows]
    first, after = earliest(raw, 50), []
    for k, b in raw:
        c = whole_chars(b, covered(b, first, k, 50))
        left = bytes(x for x, gone in zip(b, c) if not gone)
        if left or not any(c):
            after.append((k, left.decode()))
    bad = {k for k, _ in leaks([{"doc_id": k, "text": t} for k, t in after], items)}
    return sorted((k, tuple(encode(t))) for k, t in after if k not in bad)
