"""Table schemas, each stated once."""

from pyspark.sql import types as T

#: The short field names of the exchange's aggregate-trade messages.
PAYLOAD = T.StructType([T.StructField(n, T.StringType()) for n in ("E", "s", "a", "p", "q", "m")])
MESSAGE = T.StructType([T.StructField("stream", T.StringType()), T.StructField("data", PAYLOAD), *PAYLOAD.fields])

TRADE = "event_time_ms bigint, ingest_time_ms bigint, symbol string, agg_trade_id bigint, price double, quantity double, is_buyer_maker int, stream string"
DEAD_LETTER = "error string, raw string, ingest_time_ms bigint"
BAR = (
    "symbol string, window_ms bigint, window_start_ms bigint, window_end_ms bigint, open double, high double, low double, close double, "
    "volume double, trade_count bigint, vwap double"
)
MART = BAR + ", late_event_count bigint, emitted_at timestamp, result_version bigint"
HEALTH = "window_start timestamp, throughput bigint, p95_latency_ms double, consumer_lag_ms bigint, freshness_seconds double, late_event_count bigint, created_at timestamp"
SAMPLE = "ts timestamp, metric string, labels map<string,string>, value double"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
