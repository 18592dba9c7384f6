"""Fitted steps, hourly counts and drift checks on Structured Streaming."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from ..core import get_operator, q
from ..profiling.drift import drift_report


def transform_stream(stream: DataFrame, artifacts: list[dict]) -> DataFrame:
    """Replay fitted row-wise steps on a stream; steps that need the whole table are refused."""
    for art in artifacts:
        op = get_operator(art["op"])
        if not op.stateless:
            raise ValueError(f"{art['op']} needs the whole table and cannot run on a stream")
        stream = op.apply(stream, art)
    return stream


def hourly_counts(stream: DataFrame, ts: str, lateness: str = "1 hour") -> DataFrame:
    """(hour, count) per event hour; hours close once the watermark passes them."""
    d = stream.withColumn("__ts", q(ts).cast("timestamp")).withWatermark("__ts", lateness)
    return (d.groupBy(F.window("__ts", "1 hour").alias("w")).agg(F.count("*").alias("count"))
            .select(F.col("w.start").alias("hour"), "count"))


def drift_batches(stream: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None],
                  thresholds: dict | None = None, columns: list[str] | None = None):
    """Writer that reports every micro-batch against a stored reference."""
    def each(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            if not kept.isEmpty():
                report = drift_report(reference, kept, thresholds, columns)
                sink(report.metrics.withColumn("batch_id", F.lit(batch_id)), batch_id)
        finally:
            kept.unpersist()
    return stream.writeStream.foreachBatch(each)
