"""Time series, group statistics, splits, folds, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import apply, fit, fit_apply, q
from ..operators.splitting import TrainTestSplitter, exact_folds, hash_folds, time_blocks
from ..profiling import monitoring as MON, temporal as TM
from .base import query, r6, rounded, table


@query("F1", """SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3 FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_per_user(spark, sf):
    d = fit_apply("LagFeatures", table(spark, sf, "events"), columns=["value"], lags=[3, 1, 0], group_by=["user_id"], sort_by=["ts", "event_id"])
    return d.select("event_id", "value_lag_1", "value_lag_3")


@query("F1", """SELECT event_id, value_lag_2 FROM (SELECT event_id, lag(value, 2) OVER (ORDER BY ts, event_id) AS value_lag_2 FROM events) WHERE value_lag_2 IS NOT NULL""")
def lag_whole_table_sliced(spark, sf):
    """The whole table is one group, cut into slices by a small row limit."""
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    d = fit_apply("LagFeatures", e, columns=["value"], lags=[2], sort_by=["ts", "event_id"], drop_na=True, hot_rows=2000)
    return d.select("event_id", "value_lag_2")


@query("F1", """SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 4) OVER w AS value_lag_4 FROM events WINDOW w AS (ORDER BY event_type, props, event_id)""")
def lag_by_text_sliced(spark, sf):
    """The whole table is one group, sorted by texts that many rows share; slices are cut in the middle of them."""
    e = table(spark, sf, "events").select("event_id", "event_type", "props", "value")
    d = fit_apply("LagFeatures", e, columns=["value"], lags=[1, 4], sort_by=["event_type", "props", "event_id"], hot_rows=1500)
    return d.select("event_id", "value_lag_1", "value_lag_4")


@query("F2", """SELECT event_id, round(avg(value) OVER w, 6) AS value_roll_mean_40, max(value) OVER w AS value_roll_max_40 FROM events
  WINDOW w AS (PARTITION BY user_id % 2 ORDER BY event_type, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""")
def rolling_tied_lead_sliced(spark, sf):
    """Two large groups whose first sort column has five values; a slice holds fewer rows than a frame reaches over."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value", (F.col("user_id") % 2).alias("half"))
    d = fit_apply("RollingAggregate", e, columns=["value"], window=40, aggregations=["mean", "max"], group_by=["half"], sort_by=["event_type", "event_id"], hot_rows=60)
    return d.select("event_id", r6("value_roll_mean_40").alias("value_roll_mean_40"), "value_roll_max_40")


ROLL = "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"


@query("F2", f"""SELECT event_id, {', '.join(f"CASE WHEN count(value) OVER w >= 2 THEN round({fn}, 6) END AS value_roll_{a}_5" for a, fn in
  [('mean', 'avg(value) OVER w'), ('sum', 'sum(value) OVER w'), ('min', 'min(value) OVER w'), ('max', 'max(value) OVER w'), ('std', 'stddev_samp(value) OVER w'),
   ('median', 'quantile_cont(value, 0.5) OVER w')])} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id {ROLL})""")
def rolling_per_user(spark, sf):
    aggs = ["mean", "sum", "min", "max", "std", "median"]
    d = fit_apply("RollingAggregate", table(spark, sf, "events"), columns=["value"], window=5, aggregations=aggs, min_periods=2,
                  group_by=["user_id"], sort_by=["ts", "event_id"])
    names = [f"value_roll_{a}_5" for a in aggs]
    return rounded(d.select("event_id", *names), *names)


@query("F2", """SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS value_roll_mean_10 FROM events""")
def rolling_whole_table_sliced(spark, sf):
    d = fit_apply("RollingAggregate", table(spark, sf, "events"), columns=["value"], window=10, sort_by=["ts", "event_id"], hot_rows=1500)
    return rounded(d.select("event_id", "value_roll_mean_10"), "value_roll_mean_10")


@query("F3", """SELECT o_orderkey, year(d)::INTEGER AS o_orderdate_year, month(d)::INTEGER AS o_orderdate_month, day(d)::INTEGER AS o_orderdate_day, (isodow(d) - 1)::INTEGER AS o_orderdate_dayofweek,
  dayofyear(d)::INTEGER AS o_orderdate_dayofyear, quarter(d)::INTEGER AS o_orderdate_quarter, week(d)::INTEGER AS o_orderdate_weekofyear, (isodow(d) >= 6)::INTEGER AS o_orderdate_is_weekend,
  (day(d) = 1)::INTEGER AS o_orderdate_is_month_start, (d::DATE = last_day(d))::INTEGER AS o_orderdate_is_month_end, year(d)::INTEGER AS text_year FROM (SELECT *, o_orderdate AS d FROM orders)""")
def date_features(spark, sf):
    feats = ["year", "month", "day", "dayofweek", "dayofyear", "quarter", "weekofyear", "is_weekend", "is_month_start", "is_month_end"]
    o = table(spark, sf, "orders").withColumn("text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = fit_apply("DateFeatures", o, columns=["o_orderdate"], features=feats)
    d = fit_apply("DateFeatures", d, columns=["text"], features=["year"])
    return d.select("o_orderkey", *[f"o_orderdate_{f}" for f in feats], "text_year")


@query("F4", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS "date", round(avg(value), 6) AS value FROM events GROUP BY 1""")
def trend_resampled(spark, sf):
    d = TM.resample_trend(table(spark, sf, "events"), "ts", ["value"])
    return d.select(F.date_format("date", "yyyy-MM-dd HH:00").alias("date"), r6("value").alias("value"))


@query("F4", """SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS "date", count(*)::BIGINT AS count FROM orders GROUP BY 1""")
def trend_weekly_count(spark, sf):
    d = TM.resample_trend(table(spark, sf, "orders").select("o_orderdate"), "o_orderdate", [])
    return d.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "count")


@query("F5", """SELECT 'weekday' AS kind, isodow(ts)::INTEGER AS position, strftime(ts, '%a') AS name, round(avg(value), 6) AS value FROM events GROUP BY ALL
  UNION ALL SELECT 'month', month(ts)::INTEGER, strftime(ts, '%b'), round(avg(value), 6) FROM events GROUP BY ALL""")
def seasonality_events(spark, sf):
    return rounded(TM.seasonality(table(spark, sf, "events"), "ts", "value"), "value")


@query("F6", """WITH t AS (SELECT date_trunc('hour', ts) AS d, avg(value) AS y FROM events GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY d) AS t, y FROM t),
  m AS (SELECT avg(y) AS m, var_pop(y) AS v, count(*) AS n FROM s)
  SELECT lag, round(sum((a.y - m) * (b.y - m)) / n / v, 6) + 0.0::DOUBLE AS corr FROM (SELECT unnest(range(1, 31))::INTEGER AS lag), s a, s b, m
  WHERE b.t = a.t + lag AND lag < n // 2 GROUP BY lag, n, v""")
def autocorrelation_events(spark, sf):
    return rounded(TM.autocorrelation(TM.resample_trend(table(spark, sf, "events"), "ts", ["value"]), "value"), "corr")


@query("F7")
def stationarity_events(spark, sf):
    s = TM.stationarity(TM.resample_trend(table(spark, sf, "events"), "ts", ["value"]), "value")
    return spark.createDataFrame([(round(s["test_statistic"], 6), s["is_stationary"], s["lags"])], "test_statistic double, is_stationary boolean, lags int")


@query("F8", """SELECT CASE WHEN count(DISTINCT ts) >= count(DISTINCT day) THEN 'ts' ELSE 'day' END AS date_column, greatest(count(DISTINCT ts), count(DISTINCT day))::BIGINT AS distinct_values
  FROM (SELECT ts, date_trunc('day', ts) AS day FROM events)""")
def pick_date_column(spark, sf):
    e = table(spark, sf, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"), "ts", "value")
    c = TM.pick_date_column(e)
    return e.agg(F.lit(c).alias("date_column"), F.count_distinct(q(c)).alias("distinct_values"))


@query("F9", """SELECT value, avg(r) AS rank FROM (SELECT value, row_number() OVER (ORDER BY value) AS r FROM events) GROUP BY value""")
def average_rank(spark, sf):
    from ..profiling.correlations import average_ranks
    return average_ranks(table(spark, sf, "events"), "value")


GROUPS = ", ".join(f"round({fn}, 6) AS {n}" for n, fn in [("mean", "avg(l_extendedprice) OVER w"), ("sum", "sum(l_extendedprice) OVER w"), ("min", "min(l_extendedprice) OVER w"),
                                                          ("max", "max(l_extendedprice) OVER w"), ("std", "stddev_samp(l_extendedprice) OVER w"), ("median", "quantile_cont(l_extendedprice, 0.5) OVER w")])


@query("E3 M14", f"""SELECT l_orderkey, l_partkey, l_linenumber, count(l_extendedprice) OVER w AS count, {GROUPS} FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def group_statistics_back(spark, sf):
    names = ["mean", "sum", "min", "max", "std", "median"]
    ops = [{"operation_type": "group_agg", "method": m, "input_columns": ["l_suppkey"], "secondary_columns": ["l_extendedprice"], "output_column": m} for m in [*names, "count"]]
    d = fit_apply("FeatureGeneration", table(spark, sf, "lineitem"), operations=ops)
    return rounded(d.select("l_orderkey", "l_partkey", "l_linenumber", "count", *names), *names)


# --- splits ----------------------------------------------------------------------------------

HASHED = """SELECT *, row_number() OVER (ORDER BY substr(md5(o_orderkey::VARCHAR || ':42'), 1, 13)) AS r, count(*) OVER () AS n FROM orders"""


def _labelled(s):
    out = s.train.withColumn("part", F.lit("train")).unionByName(s.test.withColumn("part", F.lit("test")))
    return out if s.validation is None else out.unionByName(s.validation.withColumn("part", F.lit("validation")))


def _split(df, **cfg):
    art = fit("TrainTestSplitter", df, **cfg)
    return _labelled(TrainTestSplitter().split(df, art))


@query("P1", f"""SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.2) THEN 'test' WHEN r <= ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.125) THEN 'validation' ELSE 'train' END AS part FROM ({HASHED})""")
def split_random(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return _split(o, test_size=0.2, validation_size=0.1, key_columns=["o_orderkey"])


@query("P2", """WITH h AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY substr(md5(o_orderkey::VARCHAR || ':42'), 1, 13)) AS r FROM orders),
  c AS (SELECT o_orderstatus, count(*) AS m, (SELECT count(*) FROM orders) AS n FROM orders GROUP BY 1),
  a AS (SELECT *, floor(ceil(n * 0.25) * m / n) AS base, ceil(n * 0.25) * m / n - floor(ceil(n * 0.25) * m / n) AS rest FROM c),
  b AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, o_orderstatus) <= ceil(n * 0.25) - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM a)
  SELECT o_orderkey, CASE WHEN r <= take THEN 'test' ELSE 'train' END AS part FROM h JOIN b USING (o_orderstatus)""")
def split_stratified(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return _split(o, test_size=0.25, stratify=True, target_column="o_orderstatus", key_columns=["o_orderkey"]).select("o_orderkey", "part")


@query("P3", """SELECT event_id, CASE WHEN r > n - ceil(n * 0.3) THEN 'test' ELSE 'train' END AS part FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)""")
def split_ordered(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return _split(e, test_size=0.3, shuffle=False, order_by=["ts", "event_id"]).select("event_id", "part")


@query("P4", """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 <> 0)) GROUP BY 1)
  SELECT o_orderstatus, (SELECT max(n) FROM c)::BIGINT AS rows, n::BIGINT AS different FROM c""")
def oversample_random(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").where(~((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 != 0)))
    d = fit_apply("Oversampling", o, method="random_over", target_column="o_orderstatus", key_columns=["o_orderkey"])
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("different"))


@query("P8", """SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY substr(md5(o_orderkey::VARCHAR || ':42'), 1, 13)) AS r FROM orders)
  WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))""")
def undersample_random(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    d = fit_apply("Undersampling", o, method="random_under", target_column="o_orderstatus", key_columns=["o_orderkey"])
    return d.select("o_orderkey", "o_orderstatus")


@query("P8", """SELECT o_orderstatus, (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))::BIGINT AS rows FROM orders GROUP BY 1""")
def undersample_replacement(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    d = fit_apply("Undersampling", o, method="random_under", replacement=True, target_column="o_orderstatus", key_columns=["o_orderkey"])
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("rows"))


@query("P12", """SELECT 'rejected' AS outcome, count(*)::BIGINT AS rows FROM orders""")
def resampling_guard(spark, sf):
    o = table(spark, sf, "orders")
    try:
        fit("Oversampling", o, method="random_over", target_column="o_orderstatus", key_columns=["o_orderkey"])
        outcome = "accepted"
    except ValueError:
        outcome = "rejected"  # text features
    return o.agg(F.lit(outcome).alias("outcome"), F.count("*").alias("rows"))


@query("T12", f"""SELECT CASE WHEN r <= 3 * (n // 4) THEN (r - 1) // (n // 4) ELSE 3 END::INTEGER AS fold, count(*)::BIGINT AS rows FROM ({HASHED}) GROUP BY 1""")
def folds_exact(spark, sf):
    return exact_folds(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 4).groupBy("fold").agg(F.count("*").alias("rows"))


@query("T12", """SELECT o_orderkey, (('0x' || substr(md5(concat(o_orderkey, '#', o_orderstatus, ':42')), 1, 13))::BIGINT % 5)::INTEGER AS fold FROM orders""")
def folds_hashed_stratified(spark, sf):
    return hash_folds(table(spark, sf, "orders"), ["o_orderkey"], 5, stratify="o_orderstatus").select("o_orderkey", "fold")


@query("T13", """WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts) - 1 AS r, count(*) OVER () AS n FROM events)
  SELECT event_id, greatest(0, 5 - ((n - 1 - r) // (n // 6)))::INTEGER AS block FROM r""")
def time_series_blocks(spark, sf):
    return time_blocks(table(spark, sf, "events"), "ts", 5).select("event_id", "block")


# --- monitoring ------------------------------------------------------------------------------

@query("E21", """SELECT event_type, user_id, count(*)::BIGINT AS count, strftime(min(ts), '%Y-%m-%d %H:%M') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_seen, min(event_id) AS sample_id
  FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2""")
def grouped_errors(spark, sf):
    e = table(spark, sf, "events").withColumn("resolved", F.when(F.col("event_id") % 4 == 0, F.col("ts")))
    g = MON.grouped_events(e, ["event_type", "user_id"], "ts", "event_id", "resolved")
    return g.select("event_type", "user_id", "count", *[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("first_seen", "last_seen")], "sample_id")


@query("E22", """WITH m AS (SELECT max(ts) - INTERVAL 200 HOUR AS c FROM events WHERE event_type = 'error'), s AS (SELECT date_trunc('hour', c) + to_hours(i) AS h FROM m, range(200) t(i))
  SELECT strftime(h, '%Y-%m-%dT%H:00') AS hour, count(e.event_id)::BIGINT AS count FROM s LEFT JOIN (SELECT events.* FROM events, m WHERE event_type = 'error' AND ts >= c) e
  ON date_trunc('hour', e.ts) = h GROUP BY 1""")
def hourly_timeline(spark, sf):
    return MON.hourly_timeline(table(spark, sf, "events").where("event_type = 'error'"), "ts", 200)


@query("E23", """WITH d AS (SELECT event_type AS step, value AS s FROM events WHERE value > 0), r AS (SELECT step, s, row_number() OVER (PARTITION BY step ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY step) AS n,
  avg(s) OVER (PARTITION BY step) AS m FROM d)
  SELECT step, count(*)::BIGINT AS runs, round(sum(s), 6) AS total, round(avg(s), 6) AS avg, round(max(CASE WHEN k = round_even(0.95 * (n - 1), 0) THEN s END), 6) AS p95, round(max(s), 6) AS max,
   sum((s > 1.5 * m)::INT)::BIGINT AS outliers FROM r GROUP BY step""")
def slow_steps(spark, sf):
    return rounded(MON.slow_steps(table(spark, sf, "events"), "event_type", "value", "event_id"), "total", "avg", "p95", "max")


@query("E23", """SELECT event_type AS step, event_id AS run, value AS seconds, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events WHERE value > 0) WHERE rn <= 5""")
def longest_runs(spark, sf):
    return MON.longest_runs(table(spark, sf, "events"), "event_type", "value", "event_id")
