"""Session settings that the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that results depend on; everything else is the cluster's business.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}


def local_session(app: str = "tidemark", cores: int | None = None, **extra: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.master": f"local[{n}]",
        "spark.app.name": app,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **REQUIRED,
        **{k.replace("__", "."): v for k, v in extra.items()},
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure(spark: SparkSession) -> SparkSession:
    """Put the required settings on a session that someone else made."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
