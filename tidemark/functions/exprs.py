"""Column expressions that operators share."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_start(ms: Column, width_ms: int) -> Column:
    """Start of the epoch-aligned window [start, start + width); negative times fall to the window before zero."""
    return ms - F.pmod(ms, F.lit(width_ms).cast("long"))


def trade_order(ms: Column, trade_id: Column) -> Column:
    """Orders by time and then id, in one number: two times ten to the nineteenth is more than ids of 64 bits span.

    A struct would order alike, but its aggregation buffer cannot be changed in place, which
    costs a sort; a decimal keeps min_by and max_by in a hash aggregate.
    """
    return ms.cast("decimal(17,0)") * F.lit(Decimal(2 * 10**19)).cast("decimal(20,0)") + trade_id.cast("decimal(19,0)")


def volatility(high: Column, low: Column, base: Column | None = None) -> Column:
    """Range over the low, or over another base; zero where the base is."""
    base = low if base is None else base
    return F.when(base == 0, F.lit(0.0)).otherwise((high - low) / base)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
