import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.exprs import window_start
from tidemark.operators import bars as B
from tidemark.operators import dedup, kpi, late

TRADE = "symbol string, event_time_ms long, agg_trade_id long, price double, quantity double"


def trades(spark, *rows):
    return spark.createDataFrame([("BTCUSDT", *r) for r in rows], TRADE)


def test_open_and_close_follow_event_time_not_arrival(spark):
    bar = B.bars(trades(spark, (10_000, 1, 40000.0, 0.1), (5_000, 2, 41000.0, 0.2)), 60_000).first()
    assert (bar.open, bar.close, bar.high, bar.low, bar.trade_count) == (41000.0, 40000.0, 41000.0, 40000.0, 2)
    assert bar.volume == pytest.approx(0.3)
    assert bar.vwap == pytest.approx(40666.6666667)


def test_equal_times_are_ordered_by_id(spark):
    bar = B.bars(trades(spark, (1, 5, 10.0, 1.0), (1, 3, 20.0, 1.0), (1, -2, 30.0, 1.0)), 60_000).first()
    assert (bar.open, bar.close) == (30.0, 10.0)


def test_no_volume_gives_no_average(spark):
    bar = B.bars(trades(spark, (1, 1, 10.0, 0.0)), 60_000).first()
    assert (bar.volume, bar.vwap) == (0.0, 0.0)


@pytest.mark.parametrize(("ms", "start"), [(59_999, 0), (60_000, 60_000), (-1, -60_000), (0, 0)])
def test_window_bounds(spark, ms, start):
    assert spark.range(1).select(window_start(F.lit(ms).cast("long"), 60_000).alias("s")).first().s == start


def test_widths_do_not_collide(spark):
    got = B.bars(trades(spark, (1, 1, 10.0, 1.0)), 60_000, 300_000).select("window_ms", "window_start_ms").collect()
    assert sorted(map(tuple, got)) == [(60_000, 0), (300_000, 0)]


def test_window_list():
    assert B.window_list("300000, 60000,60000,") == (60_000, 300_000)
    assert B.window_list("") == (60_000,)


def test_close_boundary_is_inclusive(spark):
    b = B.bars(trades(spark, (1, 1, 10.0, 1.0)), 60_000)
    assert B.finalized(b, 59_999).count() == 0
    assert B.finalized(b, 60_000).count() == 1


def test_watermark_and_lateness(spark):
    row = spark.range(1).select(
        late.watermark(F.lit(20_000), 5_000).alias("w"), late.watermark(F.lit(3_000), 5_000).alias("z"),
        late.is_late(F.lit(16_000), F.lit(15_000)).alias("a"), late.is_late(F.lit(14_000), F.lit(15_000)).alias("b"),
        late.is_late(F.lit(15_000), F.lit(15_000)).alias("c"), late.is_late(F.lit(-5), F.lit(0)).alias("d"),
    ).first()
    assert tuple(row) == (15_000, 0, False, True, False, False)


def test_running_max_equals_a_loop(spark):
    rows = [(i, (i * 7919) % 10_007, i * 997) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long, at long")
    got = {r.id: r.running_max for r in late.running_max(df, "v", "at", "id", bucket_ms=20_000).collect()}
    top = 0
    for i, v, _ in rows:
        top = max(top, v)
        assert got[i] == top


def test_late_but_open_is_not_dropped(spark):
    df = spark.createDataFrame([("A", 0, 1, 1.0, 1.0, 0), ("A", 100_000, 2, 1.0, 1.0, 1), ("A", 85_000, 3, 1.0, 1.0, 2), ("A", 1_000, 4, 1.0, 1.0, 3)], TRADE + ", arrival_ms long")
    got = {r.agg_trade_id: (r.is_late, r.is_dropped) for r in late.flagged(df, "arrival_ms").collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, False), 4: (True, True)}


def test_dedup_keeps_first_arrival(spark):
    df = spark.createDataFrame([("A", 1, 5.0, 20), ("A", 1, 4.0, 10), ("B", 1, 3.0, 5)], "symbol string, agg_trade_id long, price double, arrival long")
    got = sorted((r.symbol, r.price) for r in dedup.first_trades(df, "arrival").collect())
    assert got == [("A", 4.0), ("B", 3.0)]


def test_latest_version_breaks_ties(spark):
    df = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 1.0), ("A", 2, 9.0)], "symbol string, v long, x double")
    assert dedup.latest_version(df, ("symbol",), "v").first().x == 9.0


def test_missing_symbols_and_empty_freshness(spark):
    b = B.bars(trades(spark, (1_000, 1, 10.0, 1.0)), 60_000)
    row = kpi.missing_symbols(b, ["BTCUSDT", "SOLUSDT", "ETHUSDT"], 60_000).first()
    assert (row.missing_count, row.missing) == (2, "ETHUSDT,SOLUSDT")
    assert kpi.freshness(b.where("false"), 60_000).first().freshness_seconds is None


def test_volatility_of_a_zero_low(spark):
    b = B.bars(trades(spark, (1, 1, 0.0, 1.0), (2, 2, 5.0, 1.0)), 60_000)
    assert kpi.volatility_topn(b, 0).first().avg_volatility == 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-200_000, 200_000), st.integers(-5, 5), st.integers(1, 9), st.integers(0, 4)), min_size=1, max_size=30, unique_by=lambda r: r[:2]))
def test_bars_equal_a_loop(spark, rows):
    got = {r.window_start_ms: r for r in B.bars(trades(spark, *[(a, b, float(c), float(d)) for a, b, c, d in rows]), 60_000).collect()}
    want: dict = {}
    for r in sorted(rows):
        want.setdefault(r[0] // 60_000 * 60_000, []).append(r)
    assert set(got) == set(want)
    for start, own in want.items():
        g = got[start]
        assert (g.open, g.close, g.high, g.low) == (own[0][2], own[-1][2], max(r[2] for r in own), min(r[2] for r in own))


def test_no_sort_aggregate_in_the_bar_plan(spark):
    plan = B.bars(trades(spark, (1, 1, 1.0, 1.0)), 60_000)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
