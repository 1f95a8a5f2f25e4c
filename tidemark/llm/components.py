"""Connected components by alternating large-star and small-star rounds.

Edges stay in tables all the way. Every round moves each node's edges to the least neighbour
that it knows; the number of rounds grows with the logarithm of the longest chain. Minima are
combined on the map side, and they are stored before they are joined so that both join sides
are plain exchanges, which lets adaptive execution split a hub's edges over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import release, ship, stored

#: Edges that one task contracts at a time.
CHUNK = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars around the least nodes instead of the edges of a chunk: the same components, in fewer steps of the rounds."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        i, j = np.split(at, 2)
        root = np.arange(len(node))
        while True:
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
            np.minimum.at(root, before, root.copy())
            root = root[root]
            if (root == before).all():
                break
        own = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["u", "v"])

    for batch in batches:
        held.append((np.asarray(batch.column("u")), np.asarray(batch.column("v"))))
        rows += batch.num_rows
        if rows >= CHUNK:
            yield stars()
            held, rows = [], 0
    if held:
        yield stars()


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge down at most, to a node that has none: then the edges are stars around the least nodes."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return each.where("down > 1 or (down = 1 and up = 1)").limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, root` for every node that an edge touches; root is the least node of its component.

    Nodes are longs. Loops and repeated edges are allowed; edges with a null end count as absent. No edges give no rows.
    """
    ship(edges.sparkSession)
    first = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = stored(first.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    while not _settled(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(),
            "large",
        )
        floor = stored(large.groupBy("u").agg(F.min("v").alias("m")), "floor")
        small = stored(
            large.join(floor, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .union(floor.select("u", F.col("m").alias("v")))
            .distinct(),
            "small",
        )
        release(e, least, large, floor)
        e = small
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
