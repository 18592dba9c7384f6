"""What the operators share on the Spark side: keys, groups of whole documents, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: rows without an id sort behind all others
LAST = (1 << 63) - 1
GROUP_BYTES = 6 << 20


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """key (the id, null last) and text, whatever other columns there are; rest holds those to be carried along."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"), *rest)


def text_bytes(frame: DataFrame) -> int:
    """Bytes of all texts: one pass over one column."""
    return int(frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def grouped(frame: DataFrame, groups: int) -> DataFrame:
    """Deal whole documents to groups by a hash of the key; passes over the result share one exchange."""
    return frame.select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("part"), *frame.columns)


def part_of(key, groups: int):
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def named_id(column: str = "key"):
    return F.when(F.col(column) != LAST, F.col(column))
