"""Event monitoring: grouped errors, hourly timelines, slow steps, drift triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import q
from ..plans.lookup import size_checked_join
from ..plans.quantiles import grouped_quantiles


def grouped_events(df: DataFrame, keys: list[str], ts: str, event_id: str, resolved: str | None = None) -> DataFrame:
    d = df.where(q(resolved).isNull()) if resolved else df
    return (d.groupBy(*[q(k) for k in keys]).agg(
        F.count("*").alias("count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.min(event_id).alias("sample_id")).orderBy(F.desc("count"), *[q(k) for k in keys]))


def hourly_timeline(df: DataFrame, ts: str, hours: int = 24, now=None) -> DataFrame:
    """(hour, count) for the last n hours before ``now`` (latest event by default), empty hours as 0."""
    spark = df.sparkSession
    end = now or df.agg(F.max(ts)).first()[0]
    cut = F.lit(end).cast("timestamp_ntz") - F.expr(f"interval {int(hours)} hours")
    counts = (df.where(q(ts) >= cut).groupBy(F.date_trunc("hour", q(ts).cast("timestamp")).cast("timestamp_ntz").alias("hour"))
              .agg(F.count("*").alias("n")))
    start = F.date_trunc("hour", cut.cast("timestamp")).cast("timestamp_ntz")
    slots = spark.range(hours).select((start + F.make_dt_interval(F.lit(0), F.col("id").cast("int"), F.lit(0), F.lit(0))).alias("hour"))
    return (slots.join(F.broadcast(counts), "hour", "left")  # at most hours + 1 rows
            .select(F.date_format("hour", "yyyy-MM-dd'T'HH:00").alias("hour"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("count")).orderBy("hour"))


def slow_steps(df: DataFrame, step: str, seconds: str, run_id: str, limit: int = 20) -> DataFrame:
    """(step, runs, total, avg, p95, max, outliers): slowest steps in total first."""
    d = df.where(q(seconds) > 0).select(q(step).alias("step"), q(seconds).cast("double").alias("s"), q(run_id).alias("run"))
    agg = d.groupBy("step").agg(F.count("*").alias("runs"), F.sum("s").alias("total"), F.avg("s").alias("avg"), F.max("s").alias("max"))
    p95 = grouped_quantiles(d, "step", ["s"], [0.95], method="half_even").select("step", F.col("s_q")[0].alias("p95"))
    times = d.groupBy("step", "s").agg(F.count("*").alias("n"))  # a hot step meets its mean as counts
    flagged = (size_checked_join(times, agg.select("step", "avg"), "step", "inner").where(F.col("s") > 1.5 * F.col("avg"))
               .groupBy("step").agg(F.sum("n").alias("outliers")))
    return (agg.join(p95, "step").join(flagged, "step", "left")
            .select("step", "runs", "total", "avg", "p95", "max", F.coalesce("outliers", F.lit(0)).cast("bigint").alias("outliers"))
            .orderBy(F.desc("total"), "step").limit(limit))


def longest_runs(df: DataFrame, step: str, seconds: str, run_id: str, k: int = 5) -> DataFrame:
    """(step, run, seconds, rank): top k runs per step, cut inside hash salts first."""
    d = df.where(q(seconds) > 0).select(q(step).alias("step"), q(run_id).alias("run"), q(seconds).cast("double").alias("seconds"))
    order = [F.desc("seconds"), F.col("run")]
    salted = d.withColumn("__s", F.pmod(F.xxhash64("run"), F.lit(256)))
    part = salted.withColumn("rank", F.row_number().over(W.partitionBy("step", "__s").orderBy(*order))).where(F.col("rank") <= k)
    return (part.drop("__s", "rank").withColumn("rank", F.row_number().over(W.partitionBy("step").orderBy(*order)))
            .where(F.col("rank") <= k))


def drift_severity(report: DataFrame, missing: list[str], new: list[str]) -> DataFrame:
    """(severity, drifted, columns): schema change or more than 30 % drifted is critical."""
    per = report.groupBy("column").agg(F.bool_or("has_drift").alias("d"))
    a = per.agg(F.count("*").alias("columns"), F.count_if("d").alias("drifted"))
    if missing or new:
        sev = F.lit("critical")
    else:
        share = F.col("drifted") / F.col("columns")
        sev = (F.when((F.col("columns") == 0) | (F.col("drifted") == 0), "none")
               .when(share > 0.3, "critical").otherwise("warning"))
    return a.select(sev.alias("severity"), "drifted", "columns")


def drift_importance(report: DataFrame, importances: DataFrame) -> DataFrame:
    """(column, drifted, psi, importance): drift joined with model importances, most important first."""
    per = report.groupBy("column").agg(F.bool_or("has_drift").alias("drifted"),
                                       F.max(F.when(F.col("metric").startswith("psi"), F.col("value"))).alias("psi"))
    return (per.join(F.broadcast(importances), "column", "left")  # one row per model feature
            .select("column", "drifted", "psi", F.coalesce("importance", F.lit(0.0)).alias("importance"))
            .orderBy(F.desc("importance"), "column"))
