"""Where trades come from."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import EVENTS


def from_events(events: DataFrame) -> DataFrame:
    """The event table read as trades: type is symbol, value is price, `k` of the properties is quantity."""
    return events.select(
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("event_time_ms"),
        F.upper("event_type").alias("symbol"),
        F.col("event_id").alias("agg_trade_id"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("quantity"),
    )


def read_events(spark: SparkSession, sf_dir: str, first_ms: Column | int | None = None) -> DataFrame:
    """All trades, or those from a time on: that filter is on the stored column, so the scan can skip row groups."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if first_ms is not None:
        first = F.lit(first_ms) if isinstance(first_ms, int) else first_ms
        events = events.where(F.col("ts") >= F.timestamp_millis(first).cast(events.schema["ts"].dataType))
    return from_events(events)


def last_event_ms(spark: SparkSession, sf_dir: str) -> Column:
    """The time of the last event, as a scalar column: it is found when the query that uses it runs."""
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.expr("unix_micros(cast(max(ts) as timestamp)) div 1000").alias("ms"))
    return F.coalesce(last.scalar(), F.lit(0).cast("long"))


def stream_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream of files, with the event time as a timestamp `et`, which watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return from_events(raw).withColumn("et", F.timestamp_millis("event_time_ms"))


def kafka_options(servers: str, topic: str, start: str = "latest", per_trigger: int | None = None) -> dict[str, str]:
    """Options of the Kafka source; the connector has to be on the class path."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "failOnDataLoss": "false", "kafka.fetch.min.bytes": str(1 << 20)}
    return out | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def stream_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options)).load().select(F.col("value").cast("string"))


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    """Options of the Kafka sink: idempotent, acknowledged by all replicas, compressed, small linger."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "lz4", "kafka.linger.ms": "10"}


def stream_url(base: str, symbols: list[str]) -> str:
    """Address of a multiplexed feed of aggregate trades."""
    return f"{base.rstrip('/')}/stream?streams=" + "/".join(f"{s.strip().lower()}@aggTrade" for s in symbols if s.strip())


def backoff(first: float = 1.0, most: float = 30.0, jitter: float = 0.0) -> Iterator[float]:
    """Seconds to wait before each new connection: doubling up to a bound."""
    wait = first
    while True:
        yield wait * (1 + jitter * random.random())
        wait = min(most, wait * 2)


def delayed(trades: DataFrame, seconds: Column) -> DataFrame:
    """Adds `arrival_ms`, for replaying a table as if rows came late."""
    return trades.withColumn("arrival_ms", F.col("event_time_ms") + seconds.cast("long") * 1000)
