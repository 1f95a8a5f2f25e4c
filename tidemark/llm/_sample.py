"""Bounded samples of rows, spread evenly by a hash of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(rows: DataFrame, columns: list[str], most: int, by: Column | None = None, salt: int = 0) -> DataFrame:
    """The `most` rows of the least hashes of `columns`, for each value of `by`, of which there must be few; all if there are fewer.

    Rows that agree in the columns count as one. The sample does not depend on the order of rows.
    Rows far above the bound are dropped by an estimate of the number of different hashes before the
    exact ranking, so that what is ranked is some multiple of the bound at any size of the input.
    """
    keyed = rows.withColumn("__tm_by", F.lit(0) if by is None else by).withColumn("__tm_h", F.xxhash64(*columns, F.lit(salt)))
    slim = keyed.select("__tm_by", "__tm_h")
    size = slim.groupBy("__tm_by").agg(F.approx_count_distinct("__tm_h").alias("__tm_n"))
    share = F.shiftrightunsigned("__tm_h", 1) / F.lit(2.0**63)
    near = slim.join(F.broadcast(size), "__tm_by").where(share < F.lit(8.0 * most + 64) / F.col("__tm_n")).select("__tm_by", "__tm_h").distinct()
    order = Window.partitionBy("__tm_by").orderBy(F.shiftrightunsigned("__tm_h", 1), "__tm_h")
    picked = near.withColumn("__tm_r", F.row_number().over(order)).where(F.col("__tm_r") <= most).drop("__tm_r")
    return keyed.join(F.broadcast(picked), ["__tm_by", "__tm_h"], "left_semi").dropDuplicates(["__tm_by", "__tm_h"]).drop("__tm_by", "__tm_h")
