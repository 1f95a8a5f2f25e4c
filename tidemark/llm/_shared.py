"""What the operators of this subpackage have in common."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are bound to about so many bytes, and cut so that Python works on no more text at a time.
BLOCK_BYTES = 2 << 20
#: Spark's own bound is 64 MB and 10,000 rows, which the JVM and Python both hold, for each task.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; on one machine, a temporary one if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let go of finished shuffles: Spark deletes their files once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context; bound the session's Arrow batches, unless someone has."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BLOCK_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="tidemark-zip-")
    atexit.register(shutil.rmtree, folder, True)
    out = os.path.join(folder, "tidemark_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    sc._tidemark_shipped = True


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about `limit` bytes in `column`; a longer value comes alone."""
    import numpy as np

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(sizes), 0), dtype=np.int64)
        begin = 0
        total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)


def row_key(id_col: str, text_col: str):
    """Tells rows of one id apart by their text. Rows that agree in both count as one document."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def crc_part(id_col):
    """crc32 of the id as text, mod 4: remainder 2 is held out of training."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4
