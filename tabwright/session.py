"""Session defaults and lineage cutting."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tabwright", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names, or the one the caller has set on the Spark context."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows live in the shared folder, so lost executors do not matter."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table_path(spark: SparkSession, name: str) -> str:
    import uuid
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


SMALL_INPUT_SPLITS = 32


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that arrives in a few splits; larger tables are left as they are."""
    want = min(df.sparkSession.sparkContext.defaultParallelism, SMALL_INPUT_SPLITS)
    return df if df.isStreaming or df.rdd.getNumPartitions() >= want else df.repartition(want)
