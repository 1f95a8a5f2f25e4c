"""Raw exchange messages to trades and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import finite
from tidemark.schemas import MESSAGE

RAW_KEPT = 2000
TRADE_COLUMNS = ["event_time_ms", "ingest_time_ms", "symbol", "agg_trade_id", "price", "quantity", "is_buyer_maker", "stream"]
_REQUIRED = {"event_time_ms": "E", "symbol": "s", "agg_trade_id": "a", "price": "p", "quantity": "q"}


def _normalised(raw: DataFrame, value: str, ingest_ms: Column | None) -> DataFrame:
    """The fields of each message, parsed once: an outer generator of one row keeps filters on them from copying the parser into themselves."""
    ingest = F.unix_millis(F.current_timestamp()) if ingest_ms is None else ingest_ms

    def fields(x: Column) -> Column:
        field = lambda n: F.coalesce(x["j"]["data"][n], x["j"][n])  # noqa: E731  with or without the envelope
        maker = F.lower(field("m"))
        return F.struct(
            x["raw"].alias("raw"),
            field("E").try_cast("bigint").alias("event_time_ms"),
            F.upper(field("s")).alias("symbol"),
            field("a").try_cast("bigint").alias("agg_trade_id"),
            field("p").try_cast("double").alias("price"),
            field("q").try_cast("double").alias("quantity"),
            F.when(maker.isNull() | maker.isin("false", "0", ""), 0).otherwise(1).alias("is_buyer_maker"),
            F.coalesce(x["j"]["stream"], F.lit("")).alias("stream"),
        )

    read = F.transform(F.array(F.col(value).cast("string")), lambda v: F.struct(v.alias("raw"), F.from_json(v, MESSAGE, {"mode": "PERMISSIVE"}).alias("j")))
    # a message that is no JSON object gives a null struct, whose fields are null
    return raw.select(ingest.cast("bigint").alias("ingest_time_ms"), F.inline_outer(F.transform(read, fields)))


def _fault() -> Column:
    """Name of the first thing wrong with a normalised message, null if nothing is."""
    out = F.lit(None).cast("string")
    for name in reversed(list(_REQUIRED)):
        bad = ~finite(F.col(name)) if name in ("price", "quantity") else F.col(name).isNull()
        out = F.when(bad, F.lit(f"bad {name}")).otherwise(out)
    return out


def split(raw: DataFrame, value: str = "value", ingest_ms: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(trades, dead letters). A message is dead if it is no JSON object, or a required field is missing, does not convert or is not finite."""
    both = _normalised(raw, value, ingest_ms).withColumn("error", _fault())
    trades = both.where(F.col("error").isNull()).select(*TRADE_COLUMNS)
    dead = both.where(F.col("error").isNotNull()).select("error", F.substring("raw", 1, RAW_KEPT).alias("raw"), "ingest_time_ms")
    return trades, dead


def to_messages(rows: DataFrame) -> DataFrame:
    """Rows as JSON with the symbol as key, as a log sink takes them."""
    return rows.select(F.upper("symbol").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))
