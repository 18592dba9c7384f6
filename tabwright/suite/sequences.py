"""Fitted sequences, graphs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import apply, artifact_from_json, artifact_to_json, fit, fit_apply, q
from ..plans.sequence import Pipeline, run_graph, step_metrics
from ..profiling.aggregates import decompose
from ..session import shared_table_path
from .base import HOLES, LINE_HOLES, holes, line_holes, query, r6, rounded, table

STEPS = [("SimpleImputer", {"columns": ["l_discount"], "strategy": "median"}), ("StandardScaler", {"columns": ["l_quantity", "l_extendedprice"]}),
         ("OneHotEncoder", {"columns": ["l_returnflag"]})]


@query("R1 G2 H1 I1 E2", f"""WITH m AS (SELECT quantile_cont(l_discount, 0.5) AS d, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM {LINE_HOLES}),
  t AS (SELECT l_linestatus AS name, sum(l_extendedprice * (1 - coalesce(l_discount, d))) AS value, count(*)::BIGINT AS count FROM {LINE_HOLES}, m GROUP BY 1)
  SELECT name, round(value, 2) AS value, count, round(value / sum(value) OVER (), 6) AS ratio FROM t""")
def revenue_share_prepared(spark, sf):
    """The flagship: impute, scale, encode, then a revenue decomposition."""
    d = line_holes(spark, sf).withColumn("price", F.col("l_extendedprice"))
    p = Pipeline(STEPS).fit(d)
    out = p.transform(d).withColumn("revenue", F.col("price") * (1 - F.col("l_discount")))
    return rounded(rounded(decompose(out, "revenue", "sum", "l_linestatus"), "value", digits=2), "ratio")


@query("R1 R2", f"""WITH m AS (SELECT quantile_cont(l_discount, 0.5) AS d, avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM {LINE_HOLES})
  SELECT l_orderkey, l_partkey, l_linenumber, coalesce(l_discount, d) AS l_discount, round((l_quantity - mq) / sq, 6) + 0.0::DOUBLE AS l_quantity, (l_returnflag = 'A')::INT::TINYINT AS l_returnflag_A, (l_returnflag = 'R')::INT::TINYINT AS l_returnflag_R FROM {LINE_HOLES}, m""")
def replay_fitted_steps(spark, sf):
    d = line_holes(spark, sf)
    p = Pipeline(STEPS).fit(d)
    return rounded(p.transform(d).select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_quantity", "l_returnflag_A", "l_returnflag_R"), "l_quantity")


@query("R4", f"""SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {HOLES})) AS o_totalprice FROM {HOLES}""")
def reload_saved_steps(spark, sf):
    d = holes(spark, sf)
    path = shared_table_path(spark, "steps")
    Pipeline([("SimpleImputer", {"columns": ["o_totalprice"], "strategy": "median"})]).fit(d).save(path)
    return Pipeline.load(path).transform(d).select("o_orderkey", "o_totalprice")


@query("R3 R10")
def batch_predictions(spark, sf):
    d = holes(spark, sf).withColumn("y", (F.col("o_totalprice") > 150000).cast("int")).where("y is not null")
    p = Pipeline([("TrainTestSplitter", {}), ("SimpleImputer", {"columns": ["o_totalprice"]}), ("OneHotEncoder", {"columns": ["o_orderpriority"]})],
                 {"type": "decision_tree_classifier", "params": {"max_depth": 3, "features": ["o_totalprice", "o_custkey"]}}, "y", ["o_orderkey"]).fit(d)
    p.thresholds = 0.4
    return p.batch_predict(d, required=["o_totalprice"]).select("o_orderkey", "prediction")


@query("R6", f"""SELECT count(*)::BIGINT AS rows_in, sum((o_totalprice IS NOT NULL)::INT)::BIGINT AS rows_out, (2 * count(*) - count(o_totalprice) - count(o_orderpriority))::BIGINT AS missing_in,
  sum((o_totalprice IS NOT NULL AND o_orderpriority IS NULL)::INT)::BIGINT AS missing_out FROM {HOLES}""")
def observe_step(spark, sf):
    d = holes(spark, sf)
    art = fit("DropMissingRows", d, subset=["o_totalprice"])
    m = step_metrics(d, lambda watched: apply(watched, art))
    return spark.createDataFrame([(m["rows_in"], m["rows_out"], m["missing_in"], m["missing_out"])], "rows_in long, rows_out long, missing_in long, missing_out long")


@query("R7", f"""SELECT o_orderkey, round((coalesce(o_totalprice, a) - avg(coalesce(o_totalprice, a)) OVER ()) / stddev_pop(coalesce(o_totalprice, a)) OVER (), 6) + 0.0::DOUBLE AS o_totalprice, coalesce(o_orderpriority, 'none') AS o_orderpriority
  FROM {HOLES}, (SELECT avg(o_totalprice) AS a FROM {HOLES})""")
def graph_with_fan_in(spark, sf):
    g = run_graph({"src": holes(spark, sf)}, [
        {"id": "num", "inputs": ["src"], "operator": "SimpleImputer", "params": {"columns": ["o_totalprice"]}},
        {"id": "scaled", "inputs": ["num"], "operator": "StandardScaler", "params": {"columns": ["o_totalprice"]}},
        {"id": "cat", "inputs": ["src"], "operator": "SimpleImputer", "params": {"columns": ["o_orderpriority"], "strategy": "constant", "fill_value": "none"}},
        {"id": "cat_only", "inputs": ["cat"], "operator": "DropMissingColumns", "params": {"columns": ["o_totalprice", "o_custkey", "o_orderstatus"]}},
        {"id": "both", "inputs": ["scaled", "cat_only"]}], key=["o_orderkey"])
    return rounded(g["frames"]["both"].select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_totalprice")


# --- streams: the given tables, read as files by a finite stream -----------------------------

def _stream(spark, sf, name, build, mode="append"):
    """Run a bounded stream over one table to its end and give what it wrote."""
    src = table(spark, sf, name)
    folder = shared_table_path(spark, "stream-in")
    src.repartition(4).write.parquet(folder)
    out, ckpt = shared_table_path(spark, "stream-out"), shared_table_path(spark, "stream-state")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    run = build(stream).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.parquet(out)


@query("U1", """WITH m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, round((value - m) / s, 6) + 0.0::DOUBLE AS value, ('0x' || substr(md5(event_type), 1, 8))::BIGINT % 10 AS event_type FROM events, m""")
def stream_replay(spark, sf):
    from ..streaming import transform_stream
    e = table(spark, sf, "events")
    arts = [fit("StandardScaler", e, columns=["value"]), fit("HashEncoder", e, columns=["event_type"], hash="md5")]
    arts = [artifact_from_json(artifact_to_json(a)) for a in arts]
    return rounded(_stream(spark, sf, "events", lambda s: transform_stream(s, arts)).select("event_id", "value", "event_type"), "value")


@query("U2", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*)::BIGINT AS count FROM events GROUP BY 1""")
def stream_hourly_counts(spark, sf):
    """Rows arrive in random order, so lateness covers the whole month; the last open hours are
    closed by sentinel rows far in the future."""
    from ..streaming import hourly_counts
    src = table(spark, sf, "events").select("ts")
    folder = shared_table_path(spark, "stream-in")
    src.repartition(4).write.parquet(folder)
    for d in ("2030-01-01", "2031-01-01"):
        src.limit(1).select(F.lit(d).cast("timestamp_ntz").alias("ts")).write.mode("append").parquet(folder)
    out, ckpt = shared_table_path(spark, "stream-out"), shared_table_path(spark, "stream-state")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    run = hourly_counts(stream, "ts", "60 days").writeStream.format("parquet").outputMode("append").option("checkpointLocation", ckpt).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.parquet(out).where("hour < '2030-01-01'").select(F.date_format("hour", "yyyy-MM-dd HH:00").alias("hour"), "count")


@query("U3", """SELECT 'value' AS "column", count(*)::BIGINT AS metrics, FALSE AS drifted FROM (SELECT unnest(range(4)) FROM (SELECT count(*) AS n FROM events) WHERE n > 0)""")
def stream_drift(spark, sf):
    """Every micro-batch is the whole table here, so nothing may drift."""
    from ..streaming import drift_batches
    e = table(spark, sf, "events").select("value")
    folder, out = shared_table_path(spark, "stream-in"), shared_table_path(spark, "stream-out")
    e.write.parquet(folder)
    stream = spark.readStream.schema(e.schema).parquet(folder)
    run = drift_batches(stream, e, lambda m, i: m.write.mode("append").parquet(out)).option("checkpointLocation", shared_table_path(spark, "stream-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).groupBy("column").agg(F.count("*").alias("metrics"), F.bool_or("has_drift").alias("drifted"))
