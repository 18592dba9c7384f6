"""Sharding by sampled splitters.

Records are ordered by a hash of the text, then by id, so equal texts stand side by side. A size-weighted sample of these keys
gives quantile boundaries of many small ranges; records are dealt to the ranges and the ranges are measured exactly. A range
above twice the even size beside its heaviest key (a sample can miss, and one text may have very many copies) is subdivided by a denser sample of its own,
until all fit or hold a single key. Inside a range one ordered running sum places each record at its exact byte
offset, and the shard is the eighth of all bytes in which the record's middle lies. Every shard is thus a span of the order,
and differs from the even size by less than one record at either end; equal texts are cut apart only where a shard ends.

The sample is `SAMPLE` keys for each range on average; ranges hold `RANGE_BYTES` or a sixty-fourth of all bytes. Boundaries, range
sums and offsets are one row for each range.

Defined cases: a null text has size 1 and the checksum of an empty one; null and equal ids are ordered last and by text; rows equal in
all that are counted as one until the end and take neighbouring slots; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .tables import LAST, named_id

U = np.uint64
SAMPLE = 32
RANGE_BYTES = 256 << 20
LEAST_RANGES = 64
CHUNK = 1 << 16


def sample_keys(records: DataFrame, rate: float, salt: int) -> np.ndarray:
    """Keys (hash, id) drawn with a chance of size * rate, the same ones on every run. Sorted; heavier records count more than once."""
    chance = F.col("size") * F.lit(rate)
    chance = chance * F.col("n")
    drawn = F.pmod(F.xxhash64("hash", "key", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30) < chance
    rows = records.filter(drawn).select("hash", "key", F.least(F.ceil(chance), F.lit(1 << 16)).cast("int").alias("weight")).toPandas()
    rows = rows.loc[rows.index.repeat(rows["weight"])].sort_values(["hash", "key"])
    return np.array(list(zip(rows["hash"], rows["key"])), dtype=KEY)


KEY = np.dtype([("hash", "<i8"), ("key", "<i8")])


def quantiles(sample: np.ndarray, parts: int) -> np.ndarray:
    """Boundaries that cut a sorted sample into even parts: a key belongs after all boundaries up to it."""
    if not len(sample) or parts < 2:
        return sample[:0]
    return np.unique(sample[(np.arange(1, parts) * len(sample)) // parts])


def place(hashes: np.ndarray, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Range of each key: the number of boundaries up to it."""
    out = np.searchsorted(bounds["hash"], hashes, "left")
    last = np.searchsorted(bounds["hash"], hashes, "right")
    tied = np.flatnonzero(out < last)
    for h in np.unique(hashes[tied]):
        at = tied[hashes[tied] == h]
        lo, hi = out[at[0]], last[at[0]]
        out[at] = lo + np.searchsorted(bounds["key"][lo:hi], keys[at], "right")
    return out


def dealt(records: DataFrame, bounds: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = place(b.column("hash").to_numpy(), b.column("key").to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.astype(np.int32))], [*b.schema.names, "range"])
    return records.mapInArrow(run, "key long, hash long, size long, crc long, n long, range int")


def split_evenly(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each record: the id, size, text_crc32, shard (0 to shards - 1), slot (0 on, in each shard)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    records = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(text).alias("hash"),
                          (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    records = cut_lineage(records.groupBy("key", "hash", "size", "crc").agg(F.count("*").alias("n")))
    total = records.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    ranges = max(LEAST_RANGES, ceil(total / range_bytes))
    even = max(1, total / ranges)
    bounds = quantiles(sample_keys(records, SAMPLE / even, 0), ranges)
    for turn in range(1, 20):
        each = dealt(records, bounds).groupBy("range", "hash", "key").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"))
        sums = each.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.min(F.struct("hash", "key")).alias("low"), F.max(F.struct("hash", "key")).alias("high")).collect()
        over = [r for r in sums if r["bytes"] - r["largest"] > 2 * even and r["low"] != r["high"]]
        if not over:
            break
        more = []
        inside = dealt(records, bounds).filter(F.col("range").isin([r["range"] for r in over])).drop("range")
        denser = sample_keys(inside, SAMPLE * 4 ** turn / even, turn)
        where = place(denser["hash"], denser["key"], bounds)
        for r in over:
            own = denser[where == r["range"]]
            more.append(quantiles(own, ceil(r["bytes"] / even)))
            more.append(np.array([(r["high"]["hash"], r["high"]["key"])], KEY))  # there is progress even if the sample saw one key
        bounds = np.unique(np.concatenate([bounds, *more]))
    weight = F.col("size") * F.col("n")
    sums = dealt(records, bounds).groupBy("range").agg(F.sum(weight).alias("bytes"), F.sum("n").alias("rows"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ahead = sums.select(F.col("range"), F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_ahead"))
    before = Window.partitionBy("range").orderBy("hash", "key", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt(records, bounds).withColumn("row", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("start", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    out = out.join(F.broadcast(ahead), "range")
    # equal rows were one so far
    out = out.withColumn("c", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})"))).withColumn("i", F.explode(F.expr(f"sequence(c * {CHUNK}, least(n, (c + 1) * {CHUNK}) - 1)")))
    out = out.withColumn("row", F.col("row") + F.col("rows_ahead") + F.col("i"))
    middle = 2 * (F.col("bytes_ahead") + F.col("start") + F.col("i") * F.col("size")) + F.col("size")
    out = cut_lineage(out.withColumn("shard", F.least(F.floor(middle.cast("decimal(38,0)") * shards / (2 * max(total, 1))), F.lit(shards - 1)).cast("int")).select("key", "size", "crc", "shard", "row"))
    first = out.groupBy("shard").agg(F.min("row").alias("first"))  # at most one row for each shard
    out = out.join(F.broadcast(first), "shard")
    return out.select(named_id().alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def op6_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    out = split_evenly(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
