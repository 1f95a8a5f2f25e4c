"""Late events in batch, by a running watermark over arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import window_start


def watermark(max_event_ms: Column, lateness_ms: int) -> Column:
    """Max event time less the lateness, never below zero."""
    return F.greatest(F.lit(0).cast("long"), max_event_ms - lateness_ms)


def is_late(event_ms: Column, watermark_ms: Column) -> Column:
    """Strictly before a watermark that has left zero."""
    return (watermark_ms > 0) & (event_ms < watermark_ms)


def running_max(rows: DataFrame, value: str, arrival_ms: str, tie: str, bucket_ms: int = 3_600_000) -> DataFrame:
    """Adds `running_max`: the greatest `value` among rows that arrived up to this one.

    A window over all rows would put them in one task. Rows are cut into arrival buckets
    instead: a running maximum within each, and of the buckets' maxima, of which there are few.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col(arrival_ms) / bucket_ms))
    tops = bucketed.groupBy("_bucket").agg(F.max(value).alias("_top"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_bucket", F.max("_top").over(before).alias("_before"))
    own = Window.partitionBy("_bucket").orderBy(arrival_ms, tie).rowsBetween(Window.unboundedPreceding, 0)
    within = bucketed.withColumn("_own", F.max(value).over(own))
    return within.join(tops, "_bucket").withColumn("running_max", F.greatest("_own", "_before")).drop("_bucket", "_own", "_before")


def flagged(trades: DataFrame, arrival_ms: str, lateness_ms: int = 10_000, width_ms: int = 60_000) -> DataFrame:
    """Adds `watermark_ms`, `is_late` and `is_dropped`.

    Late: before the watermark. Dropped: the window was closed already. A late trade whose window is
    still open counts in its bar, so the two differ.
    """
    out = running_max(trades, "event_time_ms", arrival_ms, "agg_trade_id")
    out = out.withColumn("watermark_ms", watermark(F.col("running_max"), lateness_ms)).drop("running_max")
    end = window_start(F.col("event_time_ms"), width_ms) + width_ms
    late = is_late(F.col("event_time_ms"), F.col("watermark_ms"))
    return out.withColumn("is_late", late).withColumn("is_dropped", late & (end <= F.col("watermark_ms")))
