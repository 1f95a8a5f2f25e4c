"""Questions over bars. Every one that asks about now takes `as_of_ms`, a number or a scalar column that is found as the query runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import volatility

HOUR = 3_600_000


def since(rows: DataFrame, as_of_ms: int | Column, back_ms: int, column: str = "window_start_ms") -> DataFrame:
    return rows.where(F.col(column) >= as_of_ms - back_ms)


def volatility_topn(bars: DataFrame, as_of_ms: int | Column, back_ms: int = HOUR, n: int = 10) -> DataFrame:
    """Symbols by mean volatility; the symbol breaks ties."""
    v = volatility(F.col("high"), F.col("low"))
    return (
        since(bars, as_of_ms, back_ms)
        .groupBy("symbol")
        .agg(F.avg(v).alias("avg_volatility"), F.max(v).alias("max_volatility"), F.sum("volume").alias("total_volume"), F.sum("trade_count").alias("total_trades"))
        .orderBy(F.desc("avg_volatility"), "symbol")
        .limit(n)
    )


def volatility_timeseries(bars: DataFrame, symbol: str, as_of_ms: int | Column, back_ms: int = 24 * HOUR) -> DataFrame:
    own = since(bars, as_of_ms, back_ms).where(F.col("symbol") == symbol)
    return own.select("window_start_ms", "symbol", volatility(F.col("high"), F.col("low")).alias("volatility")).orderBy("window_start_ms")


def ohlcv(bars: DataFrame, symbol: str, as_of_ms: int | Column, back_ms: int = 24 * HOUR) -> DataFrame:
    own = since(bars, as_of_ms, back_ms).where(F.col("symbol") == symbol)
    return own.select("window_start_ms", "open", "high", "low", "close", "volume", "trade_count", "vwap").orderBy("window_start_ms")


def volatility_by_open(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "window_start_ms", volatility(F.col("high"), F.col("low"), F.col("open")).alias("volatility_open"))


def log_return_stddev(bars: DataFrame) -> DataFrame:
    """Sample deviation of the logarithm of close over the close before, by symbol; closes that are not positive give no return."""
    w = Window.partitionBy("symbol").orderBy("window_start_ms")
    before = F.lag("close").over(w)
    step = bars.select("symbol", F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before)).alias("r"))
    return step.groupBy("symbol").agg(F.stddev_samp("r").alias("stddev_log_return"), F.avg("r").alias("mean_log_return"), F.count("r").alias("n_returns"))


def freshness(bars: DataFrame, as_of_ms: int | Column, back_ms: int = 6 * HOUR) -> DataFrame:
    """Seconds since the last window end; null where there is no recent bar."""
    top = since(bars, as_of_ms, back_ms).agg(F.max("window_end_ms").alias("last_window_end_ms"))
    return top.select("last_window_end_ms", F.floor(((F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms) - F.col("last_window_end_ms")) / 1000).alias("freshness_seconds"))


def missing_symbols(bars: DataFrame, expected: list[str], as_of_ms: int | Column, back_ms: int = 300_000) -> DataFrame:
    """How many of the expected symbols have no recent bar, and which; names sorted and comma-joined."""
    wanted = bars.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in expected])).alias("symbol"))
    recent = since(bars, as_of_ms, back_ms).select("symbol").distinct().withColumn("seen", F.lit(True))
    both = wanted.join(recent, "symbol", "left")
    gone = F.col("seen").isNull()
    return both.agg(F.count_if(gone).alias("missing_count"), F.array_join(F.array_sort(F.collect_list(F.when(gone, F.col("symbol")))), ",").alias("missing"))


def latest(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.orderBy(F.desc("window_start_ms"), "symbol", "window_ms").limit(n)


def recent_count(bars: DataFrame, as_of_ms: int | Column, back_ms: int = 600_000) -> DataFrame:
    return since(bars, as_of_ms, back_ms).agg(F.count(F.lit(1)).alias("recent_bars"))


def late_trend(flagged: DataFrame, as_of_ms: int | Column, back_ms: int = 24 * HOUR, width_ms: int = HOUR) -> DataFrame:
    """Late and dropped trades by window."""
    start = F.col("event_time_ms") - F.pmod("event_time_ms", F.lit(width_ms).cast("long"))
    own = flagged.select(start.alias("window_start_ms"), "is_late", "is_dropped")
    out = own.groupBy("window_start_ms").agg(F.count_if("is_late").alias("late_event_count"), F.count_if("is_dropped").alias("dropped_event_count"), F.count(F.lit(1)).alias("trade_count"))
    return since(out, as_of_ms, back_ms).orderBy("window_start_ms")


def symbol_kpi(bars: DataFrame) -> DataFrame:
    """Per symbol and window: volatility by either base, and the return over the bar."""
    ret = F.when(F.col("open") == 0, F.lit(0.0)).otherwise((F.col("close") - F.col("open")) / F.col("open"))
    return bars.select(
        "symbol", "window_start_ms", volatility(F.col("high"), F.col("low")).alias("volatility"), volatility(F.col("high"), F.col("low"), F.col("open")).alias("volatility_open"), ret.alias("bar_return"), "volume", "trade_count"
    )
