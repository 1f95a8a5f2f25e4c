import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import metrics, parse
from tidemark.sources import store
from tidemark.sources.trades import backoff, stream_url
from tidemark.streaming import jobs


def test_messages_with_and_without_envelope(spark):
    body = {"E": "1", "s": "btcusdt", "a": "7", "p": "1.5", "q": "2", "m": True}
    raw = [json.dumps({"stream": "x@aggTrade", "data": body}), json.dumps(body), "no json", json.dumps({**body, "p": "abc"}), json.dumps({k: v for k, v in body.items() if k != "p"}), json.dumps({**body, "q": "NaN"}), "z" * 5000, None]
    df = spark.createDataFrame([(r,) for r in raw], "value string")
    good, dead = parse.split(df, ingest_ms=F.lit(5))
    got = [tuple(r) for r in good.orderBy(F.desc("stream")).collect()]
    assert got == [(1, 5, "BTCUSDT", 7, 1.5, 2.0, 1, "x@aggTrade"), (1, 5, "BTCUSDT", 7, 1.5, 2.0, 1, "")]
    rows = dead.collect()
    assert len(rows) == 6
    assert max(len(r.raw or "") for r in rows) == 2000


def test_archive_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("A", 3_600_000 * i, i, float(i), 1.0) for i in range(50)], "symbol string, event_time_ms long, agg_trade_id long, price double, quantity double")
    b = B.bars(t, 3_600_000)
    path = f"{tmp_path}/bars"
    store.write_bars(b, path)
    assert store.read_bars(spark, path).count() == 50
    assert store.read_bars(spark, path, "1970-01-03").count() == 2
    files = store.parquet_files(spark, path)
    assert len(files) == 50
    assert "dt=1970-01-01/hour=00/win=3600000" in files[0]
    assert store.replay(spark, path, limit_files=3).count() == 3
    assert json.loads(store.replay(spark, path, 1).first().value)["symbol"] == "A"


def test_folder_is_made_once(spark, tmp_path):
    assert store.ensure_folder(spark, f"{tmp_path}/x")
    assert not store.ensure_folder(spark, f"{tmp_path}/x")


def test_corrections_replace(spark):
    b = B.bars(spark.createDataFrame([("A", 1, 1, 1.0, 1.0)], "symbol string, event_time_ms long, agg_trade_id long, price double, quantity double"), 60_000)
    ts = lambda s: F.lit(s).cast("timestamp")
    both = store.to_mart(b, ts("2024-01-01 00:00:00")).union(store.to_mart(b.withColumn("close", F.lit(9.0)), ts("2024-01-01 00:00:01")))
    assert [r.close for r in store.latest_bars(both).collect()] == [9.0]


def test_connecting_is_retried():
    tries = []

    def fails():
        tries.append(1)
        raise OSError

    with pytest.raises(RuntimeError):
        store.retried(fails, attempts=3, sleep=lambda s: None)
    assert len(tries) == 3
    assert store.retried(lambda: 5) == 5


def test_backoff_doubles_and_url():
    it = backoff()
    assert [next(it) for _ in range(7)] == [1, 2, 4, 8, 16, 30, 30]
    assert stream_url("wss://host/", ["BTCUSDT", " ethusdt"]) == "wss://host/stream?streams=btcusdt@aggTrade/ethusdt@aggTrade"


def test_counter_reset(spark):
    s = spark.createDataFrame([("a", 0, 10.0), ("a", 60, 15.0), ("a", 120, 3.0), ("a", 180, 4.0)], "series string, ts_s long, value double")
    got = {r.ts_s: r.increase for r in metrics.increase(s, 300).collect()}
    assert got == {0: 0.0, 60: 5.0, 120: 8.0, 180: 9.0}
    assert {r.ts_s: r.rate for r in metrics.rate(s, 100).collect()}[120] == pytest.approx(0.03)
    assert {r.ts_s: r.max_over_time for r in metrics.max_over_time(s, 100).collect()}[180] == 4.0


def test_alert_must_hold(spark):
    s = spark.createDataFrame([("a", t, v) for t, v in [(0, 0.0), (60, 0.0), (120, 1.0), (180, 0.0), (240, 0.0), (300, 0.0)]], "series string, ts_s long, value double")
    got = {r.ts_s: r.firing for r in metrics.alert(s, F.col("value") == 0, 120).collect()}
    assert got == {0: False, 60: False, 120: False, 180: False, 240: False, 300: True}


def test_exposition(spark):
    s = spark.createDataFrame([("up", {"job": "x"}, 1.0, 1000)], "metric string, labels map<string,string>, value double, ms long").withColumn("ts", F.timestamp_millis("ms"))
    assert metrics.exposition(s).first().value == 'up{job="x"} 1.0 1000'


def _drop(spark, folder, number, rows):
    df = spark.createDataFrame([("A", ms, i, 1.0, 1.0) for ms, i in rows], "symbol string, event_time_ms long, agg_trade_id long, price double, quantity double")
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/n{number}")


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    schema = "symbol string, event_time_ms long, agg_trade_id long, price double, quantity double"
    src = f"{tmp_path}/in"
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src).withColumn("et", F.timestamp_millis("event_time_ms"))
    _drop(spark, src, 1, [(10_000, 1), (50_000, 2), (65_000, 3)])
    first = jobs.run_bars(spark, read(), f"{tmp_path}/job", 60_000, name="t1")
    assert first.count() == 0  # the watermark, 55 000, has not reached 60 000
    _drop(spark, src, 2, [(58_000, 4), (200_000, 5)])
    got = {r.window_start_ms: r.trade_count for r in jobs.run_bars(spark, read(), f"{tmp_path}/job", 60_000, name="t2").collect()}
    assert got == {0: 3, 60_000: 1}


def test_two_stage_dedup_keeps_late_but_open(spark, tmp_path):
    schema = "symbol string, event_time_ms long, agg_trade_id long, price double, quantity double"
    src = f"{tmp_path}/in"
    read = lambda p: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(p).withColumn("et", F.timestamp_millis("event_time_ms"))
    for n, rows in enumerate([[(10_000, 1), (10_000, 1), (45_000, 2)], [(30_000, 3), (10_000, 1)], [(500_000, 9)]]):
        _drop(spark, src, n, rows)
        jobs.to_folder(jobs.deduplicated(read(src)).drop("et"), f"{tmp_path}/clean", f"{tmp_path}/c1", f"dedup{n}").awaitTermination()
    got = {r.window_start_ms: r.trade_count for r in jobs.run_bars(spark, read(f"{tmp_path}/clean"), f"{tmp_path}/b", 60_000, name="bars3").collect()}
    assert got[0] == 3
