"""Joining branches of the same rows by key, and stacking different rows."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..core import Splits, q


def merge_columns(frames: Sequence[DataFrame], key: Sequence[str], strategy: str = "last_wins",
                  owners: dict[str, int] | None = None) -> DataFrame:
    """Columns of the same rows side by side. A column that several frames have is taken from the
    last (or first) of them, or from its owner. Only the columns that are kept are joined."""
    key = list(key)
    source: dict[str, int] = {}
    order: list[str] = []
    for i, f in enumerate(frames):
        for c in f.columns:
            if c in key:
                continue
            if c not in source:
                order.append(c)
                source[c] = i
            elif strategy == "last_wins":
                source[c] = i
    source.update({c: i for c, i in (owners or {}).items() if c in source})
    parts = [f.select(*[q(k) for k in key], *[q(c) for c in f.columns if source.get(c) == i])
             for i, f in enumerate(frames)]
    out = reduce(lambda a, b: a.join(b, key, "inner"), parts)
    return out.select(*[q(k) for k in key], *[q(c) for c in order])


def changed_columns(frame: DataFrame, baseline: DataFrame, key: Sequence[str]) -> list[str]:
    """Shared columns whose values differ from the baseline in any row: one join, one aggregate."""
    cols = [c for c in frame.columns if c in baseline.columns and c not in key]
    if not cols:
        return []
    b = baseline.select(*[q(k) for k in key], *[q(c).alias(f"__b_{c}") for c in cols])
    row = frame.join(b, list(key)).agg(*[F.bool_or(~q(c).eqNullSafe(q(f"__b_{c}"))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def merge_columns_owned(frames: Sequence[DataFrame], baseline: DataFrame, key: Sequence[str],
                        strategy: str = "last_wins") -> DataFrame:
    """A column that only one branch changed belongs to that branch, whatever the order."""
    changed = [set(changed_columns(f, baseline, key)) for f in frames]
    owners = {}
    for c in {c for s in changed for c in s}:
        who = [i for i, s in enumerate(changed) if c in s]
        if len(who) == 1:
            owners[c] = who[0]
    return merge_columns(frames, key, strategy, owners)


def merge_rows(frames: Sequence[DataFrame]) -> tuple[DataFrame, list[str]]:
    """Rows of all frames over their common columns, and the columns left out."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    if not common:
        raise ValueError("the frames share no columns")
    dropped = sorted({c for f in frames for c in f.columns} - set(common))
    parts = [f.select(*[q(c) for c in common]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), parts), dropped


def train_plus_validation(s: Splits) -> DataFrame:
    return s.train if s.validation is None else s.train.unionByName(s.validation)


def merge_splits(splits: Sequence[Splits], key: Sequence[str] | None = None, strategy: str = "last_wins") -> Splits:
    """Merge each part of several splits: by key when given, by rows otherwise."""
    def part(name):
        got = [getattr(s, name) for s in splits if getattr(s, name) is not None]
        if not got:
            return None
        if len(got) == 1:
            return got[0]
        return merge_columns(got, key, strategy) if key else merge_rows(got)[0]
    return Splits(part("train"), part("test"), part("validation"))
