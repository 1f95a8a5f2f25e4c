"""Structured Streaming queries over the same expressions as the batch jobs.

Duplicates are dropped in a query of its own, with a watermark as long as duplicates may be apart.
In one query the dropper's watermark would also drop trades that are late but whose window is open.
"""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.functions.exprs import volatility
from tidemark.operators.bars import COLUMNS, aggregates, union
from tidemark.operators.parse import split


def deduplicated(trades: DataFrame, ttl: str = "600 seconds") -> DataFrame:
    """The first of each (symbol, trade id) within the time; `et` is the event time."""
    return trades.withWatermark("et", ttl).dropDuplicatesWithinWatermark(["symbol", "agg_trade_id"])


def windowed(trades: DataFrame, *widths_ms: int, lateness: str = "10 seconds") -> DataFrame:
    """Bars of each width, emitted once when the watermark reaches their end. Durations must be literals, hence a branch each."""
    marked = trades.withWatermark("et", lateness)
    parts = []
    for width in sorted(set(widths_ms)):
        out = marked.groupBy(F.window("et", f"{width} milliseconds").alias("w"), "symbol").agg(*aggregates())
        parts.append(
            out.select(
                "symbol", F.lit(width).cast("long").alias("window_ms"), F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), *COLUMNS[4:]
            )
        )
    return union(parts)


def to_folder(stream: DataFrame, path: str, checkpoint: str, name: str, every: str | None = None) -> StreamingQuery:
    """Write each batch to a folder of its own number, overwriting it: a batch that runs again leaves the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def split_sinks(raw: DataFrame, trades_path: str, dead_path: str, checkpoint: str, value: str = "value") -> StreamingQuery:
    """One query that routes valid messages and dead letters to two folders."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        trades, dead = split(batch, value)
        trades.write.mode("overwrite").parquet(f"{trades_path}/batch={number}")
        dead.write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        batch.unpersist()

    return raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def run_bars(spark: SparkSession, trades: DataFrame, folder: str, *widths_ms: int, lateness: str = "10 seconds", name: str = "bars") -> DataFrame:
    """Run a windowed query over all that is there, and read its bars."""
    to_folder(windowed(trades, *widths_ms, lateness=lateness), f"{folder}/out", f"{folder}/checkpoint", name).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*COLUMNS)


def flush(batch: DataFrame, number: int, path: str, now_ms: Callable[[], int] = lambda: int(time.time() * 1000)) -> bool:
    """Write one batch of bars, one row of pipeline health, and each symbol's volatility as a gauge; False and nothing written if there is no bar.

    Every folder bears the batch's number and is overwritten, so a batch that runs again leaves the same rows.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        began = time.perf_counter()
        n, start, end = batch.agg(F.count(F.lit(1)), F.max("window_start_ms"), F.max("window_end_ms")).first()
        if not n:
            return False
        batch.write.mode("overwrite").parquet(f"{path}/bars/batch={number}")
        took, now = (time.perf_counter() - began) * 1000, now_ms()
        lag = max(0, now - end)
        health = spark.range(1).select(
            F.timestamp_millis(F.lit(start)).alias("window_start"), F.lit(n).cast("long").alias("throughput"), F.lit(took).alias("p95_latency_ms"), F.lit(lag).cast("long").alias("consumer_lag_ms"),
            F.lit(lag / 1000).alias("freshness_seconds"), F.lit(0).cast("long").alias("late_event_count"), F.timestamp_millis(F.lit(now)).alias("created_at"),
        )
        health.write.mode("overwrite").parquet(f"{path}/health/batch={number}")
        last = batch.groupBy("symbol").agg(F.max_by(volatility(F.col("high"), F.col("low")), "window_start_ms").alias("value"))
        gauge = last.select(F.timestamp_millis(F.lit(now)).alias("ts"), F.lit("symbol_volatility_ratio").alias("metric"), F.create_map(F.lit("symbol"), F.col("symbol")).alias("labels"), "value")
        gauge.write.mode("overwrite").parquet(f"{path}/metrics/batch={number}")
        return True
    finally:
        batch.unpersist()


def to_store(bars: DataFrame, path: str, checkpoint: str, name: str, every: str | None = None) -> StreamingQuery:
    """A query that flushes every batch of bars with its health and gauges."""
    writer = bars.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: flush(batch, number, path) and None)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def saved_progress(spark: SparkSession, checkpoint: str) -> dict | None:
    """What a query would start from again: the last batch whose offsets are written, whether it was finished, and the offsets; None before any."""
    root = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(folder: str) -> list[int]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{folder}")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []

    begun, done = numbers("offsets"), numbers("commits")
    if not begun:
        return None
    lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{begun[-1]}", wholetext=True).collect()][0].split("\n")
    return {"batch": begun[-1], "committed": begun[-1] in done, "offsets": lines[2:]}


def run_until(query: StreamingQuery, stop: threading.Event, poll_s: float = 0.5) -> None:
    """Let a query run until the event is set, and then stop it; offsets and state of finished batches stay in its checkpoint."""
    while query.isActive and not stop.wait(poll_s):
        pass
    query.stop()
    query.awaitTermination()


def on_signals(stop: threading.Event, *signals: int) -> None:
    """Set the event when the process is asked to end."""
    for s in signals or (signal.SIGTERM, signal.SIGINT):
        signal.signal(s, lambda *_: stop.set())


class Health(StreamingQueryListener):
    """Keeps a bounded list of health rows, one per micro-batch that read something."""

    def __init__(self, most: int = 10_000):
        self.rows: list[dict] = []
        self.most = most

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            state = p.stateOperators
            self.rows.append(
                {
                    "batch": p.batchId, "throughput": p.numInputRows, "latency_ms": float(p.durationMs.get("triggerExecution", 0)), "watermark": p.eventTime.get("watermark"),
                    "max_event_time": p.eventTime.get("max"), "state_rows": sum(s.numRowsTotal for s in state), "late_event_count": sum(s.numRowsDroppedByWatermark for s in state),
                }
            )
            del self.rows[: -self.most]
