"""Exact duplicates of trades, and the latest version of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_trades(trades: DataFrame, arrival: str | None = None, keys: tuple[str, ...] = ("symbol", "agg_trade_id")) -> DataFrame:
    """One row per key: the first to arrive; without an arrival column, the least row.

    min_by over the whole row keeps one row a key before the shuffle, so a key that repeats a great
    deal reaches its reducer as one row per task, which a ranking window would not do.
    """
    rest = [c for c in trades.columns if c not in keys]
    row = F.struct(*rest)
    order = F.struct(F.col(arrival), row) if arrival else row
    out = trades.groupBy(*keys).agg(F.min_by(row, order).alias("row"))
    return out.select(*[F.col(f"row.{c}").alias(c) if c in rest else F.col(c) for c in trades.columns])


def latest_version(rows: DataFrame, keys: tuple[str, ...], version: str, *more: str) -> DataFrame:
    """One row per key, of the greatest version; ties by `more` and then by the row itself."""
    rest = [c for c in rows.columns if c not in keys]
    row = F.struct(*rest)
    out = rows.groupBy(*keys).agg(F.max_by(row, F.struct(version, *more, row)).alias("row"))
    return out.select(*[F.col(f"row.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])


def latest_row(rows: DataFrame, by: str) -> DataFrame:
    """The row of the greatest `by`, as ORDER BY ... LIMIT 1."""
    return rows.orderBy(F.desc(by)).limit(1)
