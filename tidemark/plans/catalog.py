"""The registered queries over the event table, and the SQL that each equals."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import dedup, kpi, late, metrics, parse
from tidemark.sources import store
from tidemark.sources.trades import delayed, last_event_ms, read_events, stream_events
from tidemark.streaming import jobs

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
SYMBOL = "PURCHASE"
EXPECTED = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW", "REFUND", "LOGOUT"]
LE = [50.0, 100.0, 200.0, 400.0]


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _bars(spark: SparkSession, sf: str, *widths: int) -> DataFrame:
    return B.bars(read_events(spark, sf), *widths)


def _arrived(spark: SparkSession, sf: str) -> DataFrame:
    """Trades with a made-up delay of up to twenty minutes."""
    return delayed(read_events(spark, sf), F.pmod(F.col("agg_trade_id") * 7919, F.lit(1200)))


def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Trades with every tenth one sent again a second later."""
    t = read_events(spark, sf).withColumn("arrival_ms", F.col("event_time_ms"))
    return t.union(t.where("agg_trade_id % 10 = 0").withColumn("arrival_ms", F.col("arrival_ms") + 1000))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars in three versions: at first with half the volume, then whole, then some corrected."""
    b = _bars(spark, sf, HOUR)
    return (
        b.withColumn("volume", F.col("volume") / 2).withColumn("result_version", F.lit(1).cast("long"))
        .union(b.withColumn("result_version", F.lit(2).cast("long")))
        .union(b.where("pmod(window_start_ms div 3600000, 3) = 0").withColumn("volume", F.col("volume") + 1).withColumn("result_version", F.lit(3).cast("long")))
    )


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Raw messages made from events: with and without envelope, and some broken in several ways."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    body = F.struct(
        ms.cast("string").alias("E"), F.col("event_type").alias("s"), F.col("event_id").alias("a"),
        F.when(F.col("event_id") % 17 == 0, "abc").otherwise(F.col("value").cast("string")).alias("p"),
        F.when(F.col("event_id") % 19 != 0, F.get_json_object("props", "$.k")).alias("q"), (F.col("event_id") % 2 == 0).alias("m"),
    )
    wrapped = F.to_json(F.struct(F.concat(F.lower("event_type"), F.lit("@aggTrade")).alias("stream"), body.alias("data")))
    text = F.when(F.col("event_id") % 23 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 0, F.to_json(body)).otherwise(wrapped)
    return e.select(text.alias("value"))


def _counter(spark: SparkSession, sf: str) -> DataFrame:
    """A counter of trades by symbol and hour that starts anew at every five hundred."""
    b = _bars(spark, sf, HOUR).select(F.col("symbol").alias("series"), F.expr("window_end_ms div 1000").alias("ts_s"), "trade_count")
    w = Window.partitionBy("series").orderBy("ts_s")
    return b.select("series", "ts_s", F.pmod(F.sum("trade_count").over(w), F.lit(500)).cast("double").alias("value"))


def _gauge(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(spark, sf, HOUR).select(F.col("symbol").alias("series"), F.expr("window_end_ms div 1000").alias("ts_s"), F.col("trade_count").cast("double").alias("value"))


# --- queries -----------------------------------------------------------------------------------


def _recent(spark: SparkSession, sf: str, width: int, back: int) -> tuple[DataFrame, Column]:
    """Bars whose windows begin in the time asked for or shortly before, from the events of that time only, and the time of the last event."""
    now = last_event_ms(spark, sf)
    return B.bars(read_events(spark, sf, now - back), width), now


def volatility_topn(spark: SparkSession, sf: str) -> DataFrame:
    bars, now = _recent(spark, sf, HOUR, 7 * DAY)
    return _rounded(kpi.volatility_topn(bars, now, 7 * DAY), "avg_volatility", "max_volatility", "total_volume")


def volatility_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    bars, now = _recent(spark, sf, HOUR, 7 * DAY)
    return _rounded(kpi.volatility_timeseries(bars, SYMBOL, now, 7 * DAY), "volatility")


def ohlcv_symbol(spark: SparkSession, sf: str) -> DataFrame:
    bars, now = _recent(spark, sf, HOUR, 7 * DAY)
    return _rounded(kpi.ohlcv(bars, SYMBOL, now, 7 * DAY), "vwap")


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    bars, now = _recent(spark, sf, HOUR, DAY)
    return kpi.freshness(B.finalized(bars, now - 10_000), now, DAY)


def missing_symbols(spark: SparkSession, sf: str) -> DataFrame:
    bars, now = _recent(spark, sf, MINUTE, HOUR)
    return kpi.missing_symbols(bars, EXPECTED, now, HOUR)


def recent_count(spark: SparkSession, sf: str) -> DataFrame:
    bars, now = _recent(spark, sf, MINUTE, DAY)
    return kpi.recent_count(bars, now, DAY)


def late_events(spark: SparkSession, sf: str) -> DataFrame:
    return late.flagged(_arrived(spark, sf), "arrival_ms", 10_000, HOUR).select("agg_trade_id", "event_time_ms", "watermark_ms", "is_late", "is_dropped")


def late_event_trend(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.late_trend(late.flagged(_arrived(spark, sf), "arrival_ms", 10_000, HOUR), last_event_ms(spark, sf), 7 * DAY)


def dedup_trades(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_trades(_repeated(spark, sf), "arrival_ms")


def dedup_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return dedup.first_trades(rows, None, ("l_orderkey", "l_linenumber"))


def latest_version_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(store.latest_bars(_versions(spark, sf)).select("symbol", "window_start_ms", "volume", "result_version"), "volume")


def finalized_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.finalized(_bars(spark, sf, HOUR), last_event_ms(spark, sf) - 10_000), "vwap")


def rollup_1d(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(B.rollup(_bars(spark, sf, HOUR), DAY), "vwap")


def log_return_stddev(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(kpi.log_return_stddev(_bars(spark, sf, HOUR)), "stddev_log_return", "mean_log_return")


def normalize_trades(spark: SparkSession, sf: str) -> DataFrame:
    trades, _ = parse.split(_messages(spark, sf), ingest_ms=F.lit(0))
    return trades.select("event_time_ms", "symbol", "agg_trade_id", "price", "quantity", "is_buyer_maker", "stream")


def dlq_trades(spark: SparkSession, sf: str) -> DataFrame:
    _, dead = parse.split(_messages(spark, sf), ingest_ms=F.lit(0))
    return dead.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def metric_quantile(spark: SparkSession, sf: str) -> DataFrame:
    h = metrics.bucket_counts(read_events(spark, sf), "price", LE, "symbol")
    return _rounded(metrics.histogram_quantile(h, 0.95, "symbol"), "quantile")


def metric_quantile_total(spark: SparkSession, sf: str) -> DataFrame:
    h = metrics.bucket_counts(read_events(spark, sf), "price", LE, "symbol").groupBy("le").agg(F.sum("count").alias("count"))
    one = h.withColumn("series", F.lit("all"))
    return _rounded(metrics.histogram_quantile(one, 0.95, "series"), "quantile")


def alert_for(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.alert(_gauge(spark, sf), F.col("value") < 3, 7200).select("series", "ts_s", "value", "pending", "firing")


#: The rules of metrics.RULES with windows and durations sixty times as long, for samples an hour apart.
SLOW_RULES = [metrics.Rule(r.name, r.metric, r.kind, r.limit, 60 * r.window_s, 60 * r.for_s, r.job, r.quantile, r.scale) for r in metrics.RULES]


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics made from hourly bars, one processor a symbol: whether it is up, how far behind it is, and how long its emissions took (cumulative buckets)."""
    b = _bars(spark, sf, HOUR).select("symbol", F.expr("window_end_ms div 1000").alias("ts_s"), "trade_count", "volume")
    n = F.col("trade_count")
    job = F.when(F.col("symbol") == "VIEW", "ingest").otherwise("processor").alias("job")
    none = F.lit(None).cast("double").alias("le")

    def gauge(metric: str, value: Column) -> DataFrame:
        return b.select(F.lit(metric).alias("metric"), job, F.col("symbol").alias("series"), none, "ts_s", value.cast("double").alias("value"))

    les = F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.5, 5.0)], F.lit(float("inf")))).alias("le")
    buckets = b.select("symbol", job, "ts_s", n.alias("n"), les)
    # of the n emissions of an hour, n modulo 5 took over a second and the rest under half of one
    own = F.when(F.col("le") >= 2.5, F.col("n")).otherwise(F.col("n") - F.pmod("n", F.lit(5)))
    total = F.sum(own).over(Window.partitionBy("symbol", "le").orderBy("ts_s"))
    counted = buckets.select(F.lit("window_emission_latency_seconds_bucket").alias("metric"), "job", F.col("symbol").alias("series"), "le", "ts_s", total.cast("double").alias("value"))
    return (
        gauge("up", F.when(n < 2, 0).otherwise(1))
        .unionByName(gauge("processor_lag_seconds", n * 30))
        .unionByName(gauge("processor_pipeline_freshness_seconds", n * 20))
        .unionByName(counted)
    )


def alert_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule's value, and whether it is pending and firing, at every sample."""
    return _rounded(metrics.evaluate_rules(_samples(spark, sf), SLOW_RULES), "value")


def dlq_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Dead letters with the head of what came in."""
    _, dead = parse.split(_messages(spark, sf).withColumn("value", F.concat(F.repeat(F.lit(" "), 1990), "value")), ingest_ms=F.lit(0))
    return dead.select("error", F.length("raw").alias("raw_chars"), F.trim("raw").alias("raw")).groupBy("error", "raw_chars", "raw").agg(F.count(F.lit(1)).alias("n"))


def pipeline_health(spark: SparkSession, sf: str) -> DataFrame:
    """Per day: trades, distance between event and arrival (lag), its 95th percentile and late trades."""
    f = late.flagged(_arrived(spark, sf), "arrival_ms", 10_000, HOUR).withColumn("lag", F.col("arrival_ms") - F.col("event_time_ms"))
    day = (F.col("event_time_ms") - F.pmod("event_time_ms", F.lit(DAY).cast("long"))).alias("window_start_ms")
    # rounded: the two engines interpolate in a different order of operations
    return f.groupBy(day).agg(F.count(F.lit(1)).alias("throughput"), F.max("lag").alias("consumer_lag_ms"), F.round(F.percentile("lag", F.lit(0.95)), 3).alias("p95_latency_ms"), F.count_if("is_late").alias("late_event_count"))


def mart_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars with their late counts."""
    f = late.flagged(_arrived(spark, sf), "arrival_ms", 10_000, HOUR)
    start = (F.col("event_time_ms") - F.pmod("event_time_ms", F.lit(HOUR).cast("long"))).alias("window_start_ms")
    counts = f.groupBy("symbol", F.lit(HOUR).cast("long").alias("window_ms"), start).agg(F.count_if("is_late").alias("late_event_count"))
    out = store.to_mart(_bars(spark, sf, HOUR), F.lit("2024-02-01 00:00:00").cast("timestamp"), late=counts)
    return _rounded(out.select("symbol", "window_start_ms", "close", "vwap", "trade_count", "late_event_count", "result_version"), "vwap")


def archive_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return store.with_partitions(_bars(spark, sf, HOUR)).groupBy("dt", "hour", "win").agg(F.count(F.lit(1)).alias("bars"))


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names for checkpoints; a temporary one on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named}/tidemark/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, own, True)
    return own


def archive_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars written as an archive, and read back as messages."""
    path = f"{_folder(spark)}/archive"
    store.write_bars(_bars(spark, sf, DAY), path)
    rows = store.replay(spark, path)
    field = lambda n, t: F.get_json_object("value", f"$.{n}").cast(t).alias(n)
    return rows.select(field("symbol", "string"), field("window_start_ms", "bigint"), field("open", "double"), field("close", "double"), field("trade_count", "bigint"))


def stream_ohlcv_1h(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(jobs.run_bars(spark, stream_events(spark, sf), _folder(spark), HOUR), "vwap")


def stream_ohlcv_multi(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(jobs.run_bars(spark, stream_events(spark, sf), _folder(spark), HOUR, DAY), "vwap")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ohlcv_1m": lambda s, d: _rounded(_bars(s, d, MINUTE), "vwap"),
    "ohlcv_1h": lambda s, d: _rounded(_bars(s, d, HOUR), "vwap"),
    "ohlcv_1d": lambda s, d: _rounded(_bars(s, d, DAY), "vwap"),
    "ohlcv_multi": lambda s, d: _rounded(_bars(s, d, MINUTE, 5 * MINUTE, HOUR), "vwap"),
    "rollup_1d": rollup_1d,
    "volatility_topn": volatility_topn,
    "volatility_timeseries": volatility_timeseries,
    "volatility_open": lambda s, d: _rounded(kpi.volatility_by_open(_bars(s, d, HOUR)), "volatility_open"),
    "symbol_kpi": lambda s, d: _rounded(kpi.symbol_kpi(_bars(s, d, HOUR)), "volatility", "volatility_open", "bar_return"),
    "ohlcv_symbol": ohlcv_symbol,
    "log_return_stddev": log_return_stddev,
    "freshness": freshness,
    "missing_symbols": missing_symbols,
    "late_events": late_events,
    "late_event_trend": late_event_trend,
    "dedup_trades": dedup_trades,
    "dedup_lineitem": dedup_lineitem,
    "latest_version_bars": latest_version_bars,
    "latest_bars": lambda s, d: _rounded(kpi.latest(_bars(s, d, HOUR)).select("symbol", "window_start_ms", "close", "vwap"), "vwap"),
    "recent_count": recent_count,
    "latest_checkpoint": lambda s, d: dedup.latest_row(read_events(s, d).select("agg_trade_id", "event_time_ms", "symbol"), "agg_trade_id"),
    "normalize_trades": normalize_trades,
    "dlq_trades": dlq_trades,
    "finalized_bars": finalized_bars,
    "mart_ohlcv": mart_ohlcv,
    "pipeline_health": pipeline_health,
    "archive_partitions": archive_partitions,
    "archive_replay": archive_replay,
    "metric_rate": lambda s, d: _rounded(metrics.rate(_counter(s, d), 6 * 3600), "rate", digits=9),
    "metric_increase": lambda s, d: metrics.increase(_counter(s, d), 6 * 3600),
    "metric_max_over_time": lambda s, d: metrics.max_over_time(_gauge(s, d), 6 * 3600),
    "metric_instant": lambda s, d: metrics.instant(_gauge(s, d)),
    "metric_quantile": metric_quantile,
    "metric_quantile_total": metric_quantile_total,
    "alert_for": alert_for,
    "alert_rules": alert_rules,
    "dlq_raw": dlq_raw,
    "stream_ohlcv_1h": stream_ohlcv_1h,
    "stream_ohlcv_multi": stream_ohlcv_multi,
}

# --- SQL ---------------------------------------------------------------------------------------

_T = """t AS (SELECT epoch_us(ts) // 1000 AS ms, upper(event_type) AS symbol, event_id AS id, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty FROM events),
now AS (SELECT max(ms) AS ms FROM t)"""


def _b(name: str, width: int) -> str:
    return f"""{name} AS (SELECT symbol, CAST({width} AS BIGINT) AS window_ms, ms - ms % {width} AS window_start_ms, ms - ms % {width} + {width} AS window_end_ms,
  arg_min(price, row(ms, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ms, id)) AS close, sum(qty) AS volume,
  count(*) AS trade_count, CASE WHEN sum(qty) > 0 THEN sum(price * qty) / sum(qty) ELSE 0.0 END AS vwap FROM t GROUP BY ALL)"""


_BAR = "symbol, window_ms, window_start_ms, window_end_ms, open, high, low, close, volume, trade_count, round(vwap, 9) AS vwap"
_H = f"WITH {_T}, {_b('b', HOUR)}"
_WEEK = f"window_start_ms >= (SELECT ms FROM now) - {7 * DAY}"
_VOL = "CASE WHEN low = 0 THEN 0.0 ELSE (high - low) / low END"
_VOL_OPEN = "CASE WHEN open = 0 THEN 0.0 ELSE (high - low) / open END"
_FLAG = f"""a AS (SELECT *, ms + (id * 7919 % 1200) * 1000 AS arrival FROM t),
r AS (SELECT *, greatest(0, max(ms) OVER (ORDER BY arrival, id ROWS UNBOUNDED PRECEDING) - 10000) AS wm FROM a),
f AS (SELECT *, wm > 0 AND ms < wm AS is_late, wm > 0 AND ms < wm AND ms - ms % {HOUR} + {HOUR} <= wm AS is_dropped FROM r)"""
_COUNTER = f"{_H}, s AS (SELECT symbol AS series, window_end_ms // 1000 AS ts_s, CAST(sum(trade_count) OVER (PARTITION BY symbol ORDER BY window_end_ms) % 500 AS DOUBLE) AS value FROM b)"
_GAUGE = f"{_H}, s AS (SELECT symbol AS series, window_end_ms // 1000 AS ts_s, CAST(trade_count AS DOUBLE) AS value FROM b)"
_INCREASE = f"""{_COUNTER}, p AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts_s) AS before FROM s),
d AS (SELECT series, ts_s, value, CASE WHEN before IS NULL THEN 0.0 WHEN value < before THEN value ELSE value - before END AS step FROM p),
i AS (SELECT series, ts_s, value, sum(step) OVER w - first_value(step) OVER w AS increase FROM d
  WINDOW w AS (PARTITION BY series ORDER BY ts_s RANGE BETWEEN {6 * 3600 - 1} PRECEDING AND CURRENT ROW))"""
_MSG = """m AS (SELECT *, CASE WHEN id % 23 = 0 THEN 'bad event_time_ms' WHEN id % 17 = 0 THEN 'bad price' WHEN id % 19 = 0 THEN 'bad quantity' END AS error FROM t)"""


def _quantile(source: str, key: str) -> str:
    les = ", ".join(f"({x})" for x in LE)
    return f"""WITH {_T}, les AS (SELECT * FROM (VALUES {les}, (CAST('inf' AS DOUBLE))) AS x(le)),
h AS (SELECT {key} AS k, le, count(*) FILTER (WHERE price <= le) AS n FROM t, les GROUP BY ALL),
w AS (SELECT k, le, n, coalesce(lag(n) OVER (PARTITION BY k ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY k ORDER BY le), 0.0) AS low,
  max(n) OVER (PARTITION BY k) * 0.95 AS rank FROM h)
SELECT k AS {source}, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, 9) AS quantile FROM w WHERE n >= rank AND below < rank"""


def _rules() -> str:
    """The slow rules in SQL: window functions over the made samples, unnested runs and all."""
    w = lambda r: f"OVER (PARTITION BY series ORDER BY ts_s RANGE BETWEEN {r.window_s - 1} PRECEDING AND CURRENT ROW)"
    up, lag, fresh, slow = SLOW_RULES
    return f"""{_H}, g AS (SELECT symbol AS series, CASE WHEN symbol = 'VIEW' THEN 'ingest' ELSE 'processor' END AS job, window_end_ms // 1000 AS ts_s, trade_count AS n FROM b),
les AS (SELECT * FROM (VALUES (0.5), (1.0), (2.5), (5.0), (CAST('inf' AS DOUBLE))) AS x(le)),
c AS (SELECT series, le, ts_s, CAST(sum(CASE WHEN le >= 2.5 THEN n ELSE n - n % 5 END) OVER (PARTITION BY series, le ORDER BY ts_s) AS DOUBLE) AS v FROM g, les),
d AS (SELECT series, le, ts_s, CASE WHEN lag(v) OVER s IS NULL THEN 0.0 WHEN v < lag(v) OVER s THEN v ELSE v - lag(v) OVER s END AS step FROM c WINDOW s AS (PARTITION BY series, le ORDER BY ts_s)),
i AS (SELECT series, le, ts_s, (sum(step) OVER w - first_value(step) OVER w) / {slow.window_s} AS rate FROM d WINDOW w AS (PARTITION BY series, le ORDER BY ts_s RANGE BETWEEN {slow.window_s - 1} PRECEDING AND CURRENT ROW)),
q AS (SELECT series, ts_s, le, rate, coalesce(lag(rate) OVER o, 0) AS below, coalesce(lag(le) OVER o, 0.0) AS low, {slow.quantile} * max(rate) OVER (PARTITION BY series, ts_s) AS rank FROM i WINDOW o AS (PARTITION BY series, ts_s ORDER BY le)),
v AS (
  SELECT '{up.name}' AS alertname, series, ts_s, CAST(CASE WHEN n < 2 THEN 0 ELSE 1 END AS DOUBLE) AS value, n < 2 AS pending, {up.for_s} AS need FROM g WHERE job = 'processor'
  UNION ALL SELECT '{lag.name}', series, ts_s, max(n * 30.0) {w(lag)} AS value, max(n * 30.0) {w(lag)} > {lag.limit}, {lag.for_s} FROM g
  UNION ALL SELECT '{fresh.name}', series, ts_s, max(n * 20.0) {w(fresh)} AS value, max(n * 20.0) {w(fresh)} > {fresh.limit}, {fresh.for_s} FROM g
  UNION ALL SELECT '{slow.name}', series, ts_s, {slow.scale} * x AS value, {slow.scale} * x > {slow.limit}, {slow.for_s}
    FROM (SELECT series, ts_s, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (rate - below) END AS x FROM q WHERE rate >= rank AND below < rank)),
r AS (SELECT *, sum(CASE WHEN pending THEN 0 ELSE 1 END) OVER (PARTITION BY alertname, series ORDER BY ts_s) AS run FROM v)
SELECT alertname, series, ts_s, round(CAST(value AS DOUBLE), 9) AS value, pending, pending AND ts_s - min(ts_s) FILTER (WHERE pending) OVER (PARTITION BY alertname, series, run) >= need AS firing FROM r"""


SQL: dict[str, str] = {
    "ohlcv_1m": f"WITH {_T}, {_b('b', MINUTE)} SELECT {_BAR} FROM b",
    "ohlcv_1h": f"{_H} SELECT {_BAR} FROM b",
    "ohlcv_1d": f"WITH {_T}, {_b('b', DAY)} SELECT {_BAR} FROM b",
    "ohlcv_multi": f"WITH {_T}, {_b('b1', MINUTE)}, {_b('b2', 5 * MINUTE)}, {_b('b3', HOUR)} SELECT {_BAR} FROM (FROM b1 UNION ALL FROM b2 UNION ALL FROM b3)",
    "rollup_1d": f"WITH {_T}, {_b('b', DAY)} SELECT {_BAR} FROM b",
    "volatility_topn": f"{_H} SELECT symbol, round(avg({_VOL}), 9) AS avg_volatility, round(max({_VOL}), 9) AS max_volatility, round(sum(volume), 9) AS total_volume, CAST(sum(trade_count) AS BIGINT) AS total_trades FROM b WHERE {_WEEK} GROUP BY symbol ORDER BY avg({_VOL}) DESC, symbol LIMIT 10",
    "volatility_timeseries": f"{_H} SELECT window_start_ms, symbol, round({_VOL}, 9) AS volatility FROM b WHERE {_WEEK} AND symbol = '{SYMBOL}' ORDER BY 1",
    "volatility_open": f"{_H} SELECT symbol, window_start_ms, round({_VOL_OPEN}, 9) AS volatility_open FROM b",
    "symbol_kpi": f"{_H} SELECT symbol, window_start_ms, round({_VOL}, 9) AS volatility, round({_VOL_OPEN}, 9) AS volatility_open, round(CASE WHEN open = 0 THEN 0.0 ELSE (close - open) / open END, 9) AS bar_return, volume, trade_count FROM b",
    "ohlcv_symbol": f"{_H} SELECT window_start_ms, open, high, low, close, volume, trade_count, round(vwap, 9) AS vwap FROM b WHERE {_WEEK} AND symbol = '{SYMBOL}' ORDER BY 1",
    "log_return_stddev": f"{_H}, l AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY window_start_ms) AS before FROM b), r AS (SELECT symbol, CASE WHEN close > 0 AND before > 0 THEN ln(close / before) END AS r FROM l) SELECT symbol, round(stddev_samp(r), 9) AS stddev_log_return, round(avg(r), 9) AS mean_log_return, count(r) AS n_returns FROM r GROUP BY symbol",
    "freshness": f"{_H}, o AS (SELECT max(window_end_ms) AS e FROM b, now WHERE window_end_ms <= now.ms - 10000 AND window_start_ms >= now.ms - {DAY}) SELECT e AS last_window_end_ms, (now.ms - e) // 1000 AS freshness_seconds FROM o, now",
    "missing_symbols": f"WITH {_T}, {_b('b', MINUTE)}, x AS (SELECT unnest({EXPECTED!r}) AS symbol), g AS (SELECT symbol FROM x WHERE symbol NOT IN (SELECT symbol FROM b, now WHERE window_start_ms >= now.ms - {HOUR})) SELECT count(*) AS missing_count, coalesce(string_agg(symbol, ',' ORDER BY symbol), '') AS missing FROM g",
    "late_events": f"WITH {_T}, {_FLAG} SELECT id AS agg_trade_id, ms AS event_time_ms, wm AS watermark_ms, is_late, is_dropped FROM f",
    "late_event_trend": f"WITH {_T}, {_FLAG} SELECT ms - ms % {HOUR} AS window_start_ms, count(*) FILTER (WHERE is_late) AS late_event_count, count(*) FILTER (WHERE is_dropped) AS dropped_event_count, count(*) AS trade_count FROM f GROUP BY 1 HAVING ms - ms % {HOUR} >= (SELECT ms FROM now) - {7 * DAY} ORDER BY 1",
    "dedup_trades": f"WITH {_T} SELECT ms AS event_time_ms, symbol, id AS agg_trade_id, price, qty AS quantity, ms AS arrival_ms FROM t",
    "dedup_lineitem": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1",
    "latest_version_bars": f"{_H} SELECT symbol, window_start_ms, round(CASE WHEN window_start_ms // 3600000 % 3 = 0 THEN volume + 1 ELSE volume END, 9) AS volume, CAST(CASE WHEN window_start_ms // 3600000 % 3 = 0 THEN 3 ELSE 2 END AS BIGINT) AS result_version FROM b",
    "latest_bars": f"{_H} SELECT symbol, window_start_ms, close, round(vwap, 9) AS vwap FROM b ORDER BY window_start_ms DESC, symbol LIMIT 20",
    "recent_count": f"WITH {_T}, {_b('b', MINUTE)} SELECT count(*) AS recent_bars FROM b, now WHERE window_start_ms >= now.ms - {DAY}",
    "latest_checkpoint": f"WITH {_T} SELECT id AS agg_trade_id, ms AS event_time_ms, symbol FROM t ORDER BY id DESC LIMIT 1",
    "normalize_trades": f"WITH {_T}, {_MSG} SELECT ms AS event_time_ms, symbol, id AS agg_trade_id, price, qty AS quantity, CAST(CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS is_buyer_maker, CASE WHEN id % 3 = 0 THEN '' ELSE lower(symbol) || '@aggTrade' END AS stream FROM m WHERE error IS NULL",
    "dlq_trades": f"WITH {_T}, {_MSG} SELECT error, count(*) AS n FROM m WHERE error IS NOT NULL GROUP BY error",
    "finalized_bars": f"{_H} SELECT {_BAR} FROM b WHERE window_end_ms <= (SELECT ms FROM now) - 10000",
    "mart_ohlcv": f"WITH {_T}, {_b('b', HOUR)}, {_FLAG}, c AS (SELECT symbol, ms - ms % {HOUR} AS window_start_ms, count(*) FILTER (WHERE is_late) AS late_event_count FROM f GROUP BY ALL) SELECT symbol, window_start_ms, close, round(vwap, 9) AS vwap, trade_count, late_event_count, CAST(1706745600000000 AS BIGINT) AS result_version FROM b JOIN c USING (symbol, window_start_ms)",
    "pipeline_health": f"WITH {_T}, {_FLAG} SELECT ms - ms % {DAY} AS window_start_ms, count(*) AS throughput, max(arrival - ms) AS consumer_lag_ms, round(CAST(quantile_cont(arrival - ms, 0.95) AS DOUBLE), 3) AS p95_latency_ms, count(*) FILTER (WHERE is_late) AS late_event_count FROM f GROUP BY 1",
    "archive_partitions": f"{_H} SELECT strftime(make_timestamp(window_start_ms * 1000), '%Y-%m-%d') AS dt, strftime(make_timestamp(window_start_ms * 1000), '%H') AS hour, window_ms AS win, count(*) AS bars FROM b GROUP BY ALL",
    "archive_replay": f"WITH {_T}, {_b('b', DAY)} SELECT symbol, window_start_ms, open, close, trade_count FROM b",
    "metric_rate": f"{_INCREASE} SELECT series, ts_s, value, round(increase / {6 * 3600}, 9) AS rate FROM i",
    "metric_increase": f"{_INCREASE} SELECT series, ts_s, value, increase FROM i",
    "metric_max_over_time": f"{_GAUGE} SELECT series, ts_s, value, max(value) OVER (PARTITION BY series ORDER BY ts_s RANGE BETWEEN {6 * 3600 - 1} PRECEDING AND CURRENT ROW) AS max_over_time FROM s",
    "metric_instant": f"{_GAUGE} SELECT series, max(ts_s) AS ts_s, arg_max(value, ts_s) AS value FROM s GROUP BY series",
    "metric_quantile": _quantile("symbol", "symbol"),
    "metric_quantile_total": _quantile("series", "'all'"),
    "alert_for": f"{_GAUGE}, r AS (SELECT *, value < 3 AS pending, sum(CASE WHEN value < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY ts_s) AS run FROM s) SELECT series, ts_s, value, pending, pending AND ts_s - min(ts_s) FILTER (WHERE pending) OVER (PARTITION BY series, run) >= 7200 AS firing FROM r",
    "alert_rules": _rules(),
    "dlq_raw": f"""WITH {_T}, {_MSG}
SELECT error, CAST(1990 + length(head) AS INTEGER) AS raw_chars, head AS raw, count(*) AS n FROM (
  SELECT m.error, CASE WHEN id % 23 = 0 THEN substr('broken ' || id, 1, 10) WHEN id % 3 = 0 THEN substr('{{"E":"' || ms, 1, 10) ELSE '{{"stream":' END AS head FROM m WHERE error IS NOT NULL) GROUP BY ALL""",
    "stream_ohlcv_1h": f"{_H} SELECT {_BAR} FROM b WHERE window_end_ms <= (SELECT ms FROM now) - 10000",
    "stream_ohlcv_multi": f"WITH {_T}, {_b('b1', HOUR)}, {_b('b2', DAY)} SELECT {_BAR} FROM (FROM b1 UNION ALL FROM b2) WHERE window_end_ms <= (SELECT ms FROM now) - 10000",
}
