"""Open, high, low, close, volume, count and average price of trades in event-time windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import trade_order, window_start

COLUMNS = ["symbol", "window_ms", "window_start_ms", "window_end_ms", "open", "high", "low", "close", "volume", "trade_count", "vwap"]


def aggregates() -> list[Column]:
    """The aggregate list that batch and stream share. Every part merges, so Spark combines before it shuffles."""
    order = trade_order(F.col("event_time_ms"), F.col("agg_trade_id"))
    volume = F.sum("quantity")
    return [
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        volume.alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.when(volume > 0, F.sum(F.col("price") * F.col("quantity")) / volume).otherwise(F.lit(0.0)).alias("vwap"),
    ]


def window_list(text: str, default: int = 60_000) -> tuple[int, ...]:
    """Window widths from a comma list: sorted, each once; the default if none is given."""
    return tuple(sorted({int(x) for x in text.split(",") if x.strip()})) or (default,)


def bars(trades: DataFrame, *widths_ms: int) -> DataFrame:
    """Bars of each width, from one read of the trades.

    With several widths every trade is put into a window of each by one explode, and all are
    aggregated in one shuffle after partial aggregation.
    """
    widths = sorted(set(widths_ms)) or [60_000]
    slim = trades.select("symbol", "event_time_ms", "agg_trade_id", "price", "quantity")
    if len(widths) == 1:
        wide = slim.withColumn("window_ms", F.lit(widths[0]).cast("long"))
    else:
        wide = slim.withColumn("window_ms", F.explode(F.array(*[F.lit(w).cast("long") for w in widths])))
    start = F.col("event_time_ms") - F.pmod("event_time_ms", "window_ms")
    out = wide.withColumn("window_start_ms", start).groupBy("symbol", "window_ms", "window_start_ms").agg(*aggregates())
    return out.withColumn("window_end_ms", F.col("window_start_ms") + F.col("window_ms")).select(*COLUMNS)


def rollup(bars_: DataFrame, width_ms: int) -> DataFrame:
    """Wider bars out of finer ones, without the trades. The width must be a multiple of theirs."""
    parent = window_start(F.col("window_start_ms"), width_ms)
    volume = F.sum("volume")
    out = bars_.groupBy("symbol", parent.alias("start")).agg(
        F.min_by("open", "window_start_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "window_start_ms").alias("close"),
        volume.alias("volume"), F.sum("trade_count").alias("trade_count"), F.when(volume > 0, F.sum(F.col("vwap") * F.col("volume")) / volume).otherwise(F.lit(0.0)).alias("vwap"),
    )
    return out.select(
        "symbol", F.lit(width_ms).cast("long").alias("window_ms"), F.col("start").alias("window_start_ms"), (F.col("start") + width_ms).alias("window_end_ms"), *COLUMNS[4:]
    )


def finalized(bars_: DataFrame, watermark_ms: Column | int) -> DataFrame:
    """Bars whose window the watermark has reached; its end counts as reached."""
    return bars_.where(F.col("window_end_ms") <= watermark_ms)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
