"""Plans and streams: what must be read, parsed or written once."""

import json
import signal
import threading

from pyspark.sql import functions as F

from tidemark.operators import metrics, parse
from tidemark.plans import catalog
from tidemark.schemas import HEALTH
from tidemark.sources import store
from tidemark.streaming import jobs

TRADES = "symbol string, event_time_ms long, agg_trade_id long, price double, quantity double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_messages_are_parsed_once(spark, sf_dir):
    raw = spark.createDataFrame([("{}",)], "value string")
    for part in parse.split(raw, ingest_ms=F.lit(0)):
        assert plan(part).count("from_json") == 1
    text = plan(catalog.normalize_trades(spark, sf_dir))
    assert text.count("from_json") == 1
    assert text.count("get_json_object") <= 4


def test_recent_queries_read_recent_events(spark, sf_dir):
    for query in (catalog.volatility_topn, catalog.freshness, catalog.missing_symbols, catalog.recent_count):
        df = query(spark, sf_dir)
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert "ts#" in physical
        assert "scalar-subquery" in physical or "Subquery" in physical
    # building a query runs nothing
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    catalog.ohlcv_symbol(spark, sf_dir)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) <= 2  # footers of the two reads


def test_rules_with_their_own_windows(spark):
    """Down for a minute, and a p95 over two seconds for two minutes; other jobs do not count."""
    up = [("up", job, job, None, t, float(v)) for job in ("processor", "ingest") for t, v in ((0, 1), (60, 0), (120, 0), (180, 1))]
    slow = [("window_emission_latency_seconds_bucket", "processor", "p", le, t, n * t / 60) for t in range(0, 600, 60) for le, n in ((1.0, 1.0), (2.5, 5.0), (float("inf"), 20.0))]
    rows = spark.createDataFrame(up + slow, "metric string, job string, series string, le double, ts_s long, value double")
    got = {(r.alertname, r.series, r.ts_s): r for r in metrics.evaluate_rules(rows).collect()}
    assert [(k[1], k[2]) for k, r in got.items() if k[0] == "ProcessorDown" and r.firing] == [("processor", 120)]
    late = [r for k, r in got.items() if k[0] == "LatencyHighP95"]
    assert late
    assert all(r.value == 2500.0 and r.pending for r in late)
    assert {r.ts_s for r in late if r.firing} == {r.ts_s for r in late if r.ts_s >= min(x.ts_s for x in late) + 120}
    alerts = metrics.grouped_alerts(metrics.evaluate_rules(rows), "alertname").collect()
    assert {r.alertname: r.firing for r in alerts}["ProcessorDown"] == 1


def test_valid_and_dead_messages_part_in_a_stream(spark, tmp_path):
    body = {"E": "1", "s": "btcusdt", "a": "7", "p": "1.5", "q": "2", "m": True}
    spark.createDataFrame([(json.dumps(body),), ("broken",), (json.dumps({**body, "p": "x"}),)], "value string").coalesce(1).write.text(f"{tmp_path}/in")
    raw = spark.readStream.schema("value string").text(f"{tmp_path}/in")
    jobs.split_sinks(raw, f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/check").awaitTermination()
    assert [r.symbol for r in spark.read.parquet(f"{tmp_path}/good").collect()] == ["BTCUSDT"]
    assert sorted(r.error for r in spark.read.parquet(f"{tmp_path}/dead").collect()) == ["bad event_time_ms", "bad price"]
    back = parse.to_messages(spark.read.parquet(f"{tmp_path}/good").drop("batch")).first()
    assert back.key == "BTCUSDT"
    assert json.loads(back.value)["agg_trade_id"] == 7


def test_flush_writes_health_and_gauges(spark, tmp_path):
    df = spark.createDataFrame([("A", 1_000, 1, 10.0, 1.0), ("A", 2_000, 2, 12.0, 1.0), ("B", 500_000, 3, 1.0, 1.0)], TRADES)
    df.coalesce(1).write.parquet(f"{tmp_path}/in/n1")
    listener = jobs.Health()
    spark.streams.addListener(listener)
    read = lambda: spark.readStream.schema(TRADES).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withColumn("et", F.timestamp_millis("event_time_ms"))
    assert jobs.saved_progress(spark, f"{tmp_path}/check") is None
    jobs.to_store(jobs.windowed(read(), 60_000), f"{tmp_path}/out", f"{tmp_path}/check", "flush1").awaitTermination()
    health = spark.read.parquet(f"{tmp_path}/out/health")
    row = health.collect()
    assert [f.strip().split(" ")[0] for f in HEALTH.split(",")] == health.columns[:-1]
    assert sum(r.throughput for r in row) == 1
    assert row[0].freshness_seconds == row[0].consumer_lag_ms / 1000 > 0
    gauges = spark.read.parquet(f"{tmp_path}/out/metrics").collect()
    assert [(g.labels["symbol"], round(g.value, 6)) for g in gauges] == [("A", 0.2)]
    saved = jobs.saved_progress(spark, f"{tmp_path}/check")
    assert saved["committed"]
    assert saved["offsets"]
    # started again with one more file: what was there is not read again
    spark.createDataFrame([("B", 900_000, 4, 2.0, 1.0)], TRADES).coalesce(1).write.parquet(f"{tmp_path}/in/n2")
    jobs.to_store(jobs.windowed(read(), 60_000), f"{tmp_path}/out", f"{tmp_path}/check", "flush2").awaitTermination()
    assert jobs.saved_progress(spark, f"{tmp_path}/check")["batch"] > saved["batch"]
    assert sorted((r.symbol, r.trade_count) for r in spark.read.parquet(f"{tmp_path}/out/bars").collect()) == [("A", 2), ("B", 1)]
    spark.streams.removeListener(listener)
    assert not jobs.flush(spark.createDataFrame([], "symbol string, window_start_ms long, window_end_ms long, high double, low double"), 0, f"{tmp_path}/none")


def test_a_query_stops_when_asked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(TRADES).parquet(f"{tmp_path}/in").withColumn("et", F.timestamp_millis("event_time_ms"))
    query = jobs.to_folder(stream, f"{tmp_path}/out", f"{tmp_path}/check", "stops", every="1 second")
    stop = threading.Event()
    held = signal.getsignal(signal.SIGUSR1)
    jobs.on_signals(stop, signal.SIGUSR1)
    signal.raise_signal(signal.SIGUSR1)
    signal.signal(signal.SIGUSR1, held)
    assert stop.is_set()
    jobs.run_until(query, stop)
    assert not query.isActive


def test_bars_table_has_dates(spark):
    spark.sql("DROP DATABASE IF EXISTS tide_test CASCADE")
    store.ensure_tables(spark, "tide_test")
    store.ensure_tables(spark, "tide_test")
    bars = spark.createDataFrame([("A", 60_000, 86_400_000, 86_460_000, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1.0)], "symbol string, window_ms long, window_start_ms long, window_end_ms long, open double, high double, low double, close double, volume double, trade_count long, vwap double")
    store.append_bars(spark, bars, "tide_test")
    assert [str(r.dt) for r in spark.table("tide_test.bars").collect()] == ["1970-01-02"]
    spark.sql("DROP DATABASE tide_test CASCADE")


def test_bars_as_csv(spark, tmp_path):
    store.export_csv(spark.createDataFrame([("A", 1.5)], "symbol string, close double"), f"{tmp_path}/csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()] == [("A", "1.5")]
