"""Tables on disk: bars by date, hour and width, the mart, health rows, replay and export."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import latest_version
from tidemark.schemas import BAR, HEALTH, MART

BAR_KEY = ("symbol", "window_ms", "window_start_ms")


def ensure_folder(spark: SparkSession, path: str) -> bool:
    """Make a folder in any store that Spark knows; True if it was not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return False
    fs.mkdirs(at)
    return True


def append_bars(spark: SparkSession, bars: DataFrame, database: str = "tidemark") -> None:
    """Add bars to the table of ensure_tables(), each under the date of its window."""
    bars.select(*[f.name for f in spark.table(f"{database}.bars").schema if f.name != "dt"], F.timestamp_millis("window_start_ms").cast("date").alias("dt")).write.mode("append").insertInto(f"{database}.bars")


def ensure_tables(spark: SparkSession, database: str = "tidemark") -> None:
    """Create the database and its tables where they are missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in (("bars", BAR), ("mart_ohlcv", MART), ("mart_pipeline_health", HEALTH)):
        part = "" if name == "mart_pipeline_health" else ", dt date"
        by = "" if name == "mart_pipeline_health" else " PARTITIONED BY (dt)"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}{part}) USING parquet{by}")


def with_partitions(bars: DataFrame) -> DataFrame:
    ts = F.timestamp_millis("window_start_ms")
    return bars.select("*", F.date_format(ts, "yyyy-MM-dd").alias("dt"), F.date_format(ts, "HH").alias("hour"), F.col("window_ms").alias("win"))


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Zstandard Parquet under dt=/hour=/win=, sorted so that row groups can be skipped by symbol.

    Rows of a partition meet in one task by a rebalance, which splits large ones, so files are neither tiny nor huge.
    """
    out = with_partitions(bars).hint("rebalance", F.col("dt"), F.col("hour"), F.col("win"))
    out.sortWithinPartitions("dt", "hour", "win", "symbol", "window_start_ms").write.mode(mode).partitionBy("dt", "hour", "win").option("compression", "zstd").parquet(path)


def read_bars(spark: SparkSession, path: str, first_day: str | None = None) -> DataFrame:
    """Bars, with the date partition pruned if a first day is given: Spark does not infer it from window_start."""
    out = spark.read.parquet(path)
    return out.where(F.col("dt") >= first_day) if first_day else out


def to_mart(bars: DataFrame, emitted_at: Column, batch: int = 0, late: DataFrame | None = None) -> DataFrame:
    """Bars with late counts and a version that grows with emission, so that a correction replaces what it corrects.

    `batch` tells emissions of one millisecond apart, up to the 999th.
    """
    out = bars.join(late, list(BAR_KEY), "left") if late is not None else bars.withColumn("late_event_count", F.lit(None).cast("long"))
    return out.withColumn("late_event_count", F.coalesce("late_event_count", F.lit(0)).cast("long")).withColumn("emitted_at", emitted_at).withColumn(
        "result_version", F.unix_millis("emitted_at") * 1000 + F.lit(min(batch, 999))
    )


def latest_bars(rows: DataFrame, version: str = "result_version") -> DataFrame:
    """What a table of versions holds now: one row per symbol, width and start."""
    return latest_version(rows, BAR_KEY, version)


def parquet_files(spark: SparkSession, path: str, limit: int | None = None) -> list[str]:
    """Names of the Parquet files under a path, sorted, the first `limit`; a listing, not a read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    it = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while it.hasNext():
        name = it.next().getPath().toString()
        if name.endswith(".parquet"):
            found.append(name)
    return sorted(found)[:limit]


def replay(spark: SparkSession, path: str, limit_files: int | None = None) -> DataFrame:
    """Rows of an archive as JSON messages, from all files or the first few."""
    if limit_files is None:
        rows = spark.read.parquet(path)
    else:
        rows = spark.read.option("basePath", path).parquet(*parquet_files(spark, path, limit_files))
    return rows.select(F.lit(None).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def retried(connect: Callable, attempts: int = 90, wait_s: float = 2.0, sleep: Callable = time.sleep):
    """The result of connect(), tried again and again; RuntimeError when attempts run out."""
    last: Exception | None = None
    for i in range(attempts):
        try:
            return connect()
        except Exception as e:  # any failure to connect is tried again
            last = e
            if i + 1 < attempts:
                sleep(wait_s)
    raise RuntimeError(f"no connection after {attempts} attempts") from last
