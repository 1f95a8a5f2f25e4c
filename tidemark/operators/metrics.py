"""Counters, gauges and histograms over a long table of samples: `series, ts_s, value` and, for histograms, `le`."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _frame(window_s: int):
    """Samples of a series in (t - window, t]."""
    return Window.partitionBy("series").orderBy("ts_s").rangeBetween(-window_s + 1, 0)


def increase(samples: DataFrame, window_s: int) -> DataFrame:
    """Adds `increase`: growth of a counter between the first and last sample in the window, resets included.

    A value below the one before is a reset, and counts whole. Growth is not extrapolated to the
    window's bounds. With a single sample in the window it is zero.
    """
    before = F.lag("value").over(Window.partitionBy("series").orderBy("ts_s"))
    step = samples.withColumn("_step", F.when(before.isNull(), F.lit(0.0)).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))
    frame = _frame(window_s)
    return step.withColumn("increase", F.sum("_step").over(frame) - F.first("_step").over(frame)).drop("_step")


def rate(samples: DataFrame, window_s: int) -> DataFrame:
    return increase(samples, window_s).withColumn("rate", F.col("increase") / window_s).drop("increase")


def max_over_time(samples: DataFrame, window_s: int) -> DataFrame:
    return samples.withColumn("max_over_time", F.max("value").over(_frame(window_s)))


def instant(samples: DataFrame) -> DataFrame:
    """The last value of every series."""
    return samples.groupBy("series").agg(F.max("ts_s").alias("ts_s"), F.max_by("value", "ts_s").alias("value"))


def bucket_counts(values: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """`le, count` of a cumulative histogram; counted once per value and then summed upwards."""
    place = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        place = F.when(F.col(value) <= bounds[i], i).otherwise(place)
    own = values.groupBy(*by, place.alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    every = own.select(*by).distinct().select(*by, F.posexplode(F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))).alias("_i", "le"))
    up = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(own, [*by, "_i"], "left").select(*by, "le", F.sum(F.coalesce("_n", F.lit(0))).over(up).alias("count"))


def histogram_quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """`quantile` by linear interpolation in the bucket that the rank falls in; the last finite bound if that is the open one."""
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("count").over(Window.partitionBy(*by))
    marked = buckets.select(*by, "le", "count", F.coalesce(F.lag("count").over(w), F.lit(0)).alias("_below"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("_low"), (total * q).alias("_rank"))
    inf = F.col("le") == F.lit(float("inf"))
    at = F.when(inf, F.col("_low")).otherwise(F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_rank") - F.col("_below")) / (F.col("count") - F.col("_below")))
    hit = marked.where((F.col("count") >= F.col("_rank")) & (F.col("_below") < F.col("_rank")))
    return hit.select(*by, at.alias("quantile"))


def alert(samples: DataFrame, condition: Column, for_s: int | Column) -> DataFrame:
    """Adds `pending` and `firing`: the condition holds, and has held at every sample for `for_s` seconds or more."""
    w = Window.partitionBy("series").orderBy("ts_s")
    on = F.coalesce(condition, F.lit(False))
    marked = samples.withColumn("pending", on).withColumn("_run", F.sum(F.when(on, 0).otherwise(1)).over(w))
    begin = F.min(F.when(F.col("pending"), F.col("ts_s"))).over(Window.partitionBy("series", "_run"))
    return marked.withColumn("firing", F.col("pending") & (F.col("ts_s") - begin >= for_s)).drop("_run")


def grouped_alerts(alerts: DataFrame, *by: str) -> DataFrame:
    """Firing alerts by group, as a notifier batches them."""
    return alerts.where("firing").groupBy(*by).agg(F.count(F.lit(1)).alias("firing"), F.min("ts_s").alias("since_s"))


class Rule(NamedTuple):
    """kind: `instant` compares a sample with the limit for equality, `max` the maximum over the window, `quantile` the quantile of a histogram's rates, times scale."""

    name: str
    metric: str
    kind: str
    limit: float
    window_s: int
    for_s: int
    job: str | None = None
    quantile: float = 0.95
    scale: float = 1.0


#: Metrics, limits, windows and durations of the alert rules.
RULES = [
    Rule("ProcessorDown", "up", "instant", 0, 0, 60, job="processor"),
    Rule("ConsumerLagHigh", "processor_lag_seconds", "max", 120, 300, 120),
    Rule("FreshnessHigh", "processor_pipeline_freshness_seconds", "max", 120, 300, 120),
    Rule("LatencyHighP95", "window_emission_latency_seconds_bucket", "quantile", 2000, 300, 120, scale=1000.0),
]


def quantile_of_rate(buckets: DataFrame, q: float, window_s: int) -> DataFrame:
    """`series, ts_s, quantile` from the rates of a histogram's cumulative counters, `series, le, ts_s, value`. No rate gives no row."""
    each = rate(buckets.select(F.struct("series", "le").alias("series"), "ts_s", "value"), window_s)
    return histogram_quantile(each.select("series.series", "series.le", "ts_s", F.col("rate").alias("count")), q, "series", "ts_s")


def evaluate_rules(samples: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """`alertname, series, ts_s, value, pending, firing` of every rule at every sample.

    Samples are `metric, job, series, le, ts_s, value`. Each rule's value is made from the samples of
    its own metric; pending and firing of all rules then come from one pass.
    """
    parts = []
    for r in RULES if rules is None else rules:
        own = samples.where((F.col("metric") == r.metric) & (F.col("job") == r.job if r.job else F.lit(True)))
        if r.kind == "quantile":
            got = quantile_of_rate(own, r.quantile, r.window_s).select("series", "ts_s", (F.col("quantile") * r.scale).alias("value"))
        elif r.kind == "max":
            got = max_over_time(own.select("series", "ts_s", "value"), r.window_s).select("series", "ts_s", F.col("max_over_time").alias("value"))
        else:
            got = own.select("series", "ts_s", "value")
        on = F.col("value") == r.limit if r.kind == "instant" else F.col("value") > r.limit
        parts.append(got.select(F.struct(F.lit(r.name).alias("alertname"), "series").alias("series"), "ts_s", "value", on.alias("_on"), F.lit(r.for_s).alias("_for")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    marked = alert(every, F.col("_on"), F.col("_for"))
    return marked.select("series.alertname", "series.series", "ts_s", "value", "pending", "firing")


def exposition(samples: DataFrame) -> DataFrame:
    """Lines in the text format that metric scrapers read, from SAMPLE rows."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    label = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return samples.select(F.concat("metric", label, F.lit(" "), F.col("value").cast("string"), F.lit(" "), F.unix_millis("ts").cast("string")).alias("value"))
