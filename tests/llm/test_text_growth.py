"""Work of a shard as the corpus grows: even buckets, and arrays that only meet where they can share a window."""

import numpy as np
import pyarrow as pa

from tabwright.llm import windows as W
from tabwright.llm.suffix_dedup import GRAM, ByteWindows


def random_texts(n, length, seed=5):
    rng = np.random.default_rng(seed)
    return ["".join(map(chr, rng.integers(97, 123, length))) for _ in range(n)]


def test_buckets_are_even():
    """Seeds are the smallest hashes of their windows; buckets must not follow their size."""
    texts = random_texts(200, 2_000)
    docs = pa.table({"key": pa.array(range(200), pa.int64()), "text": pa.array(texts)})
    sent = W._seed_rows(ByteWindows(50, 1 << 19), 64)([pa.scalar(0)], docs)
    sizes = [len(x) for x in sent["hashes"].to_pylist() if x]
    assert len(sizes) == 64 and max(sizes) < 2 * np.mean(sizes)


def test_arrays_meet_for_large_seeds_only(monkeypatch):
    scheme, merged = ByteWindows(50, 2_000), []
    monkeypatch.setattr(ByteWindows, "_windows", lambda self, *a, was=ByteWindows._windows: merged.append(1) or was(self, *a))

    def earliest(texts, seed):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        woff, early = scheme.earliest(data, off, np.array(seed, np.uint64), np.arange(len(texts))[::-1].copy())
        first = {}
        for i, t in reversed(list(enumerate(texts))):
            for a in range(len(t) - 49):
                first.setdefault((seed[i], t[a: a + 50]), len(texts) - 1 - i)
        want = [first[seed[i], t[a: a + 50]] for i, t in enumerate(texts) for a in range(len(t) - 49)]
        assert list(np.diff(woff)) == [len(t) - 49 for t in texts] and list(early) == want

    base = random_texts(50, 70)
    many = [t[k:] for t in base for k in range(3)]  # fifty seeds of three stretches each
    earliest(many, [i // 3 for i in range(len(many))])
    assert not merged
    one = [x[k:] + y for x in random_texts(1, 90) for y in ["", *random_texts(60, GRAM, 6)] for k in range(2)]
    earliest(one + many, [1000] * len(one) + [i // 3 for i in range(len(many))])
    assert len(merged) > 2
