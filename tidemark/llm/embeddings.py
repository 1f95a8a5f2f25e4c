"""Near-duplicate embeddings by p-stable hashing for Euclidean distance, with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import release, ship, stored
from tidemark.llm.components import components

COSINE = 0.98
TABLES = 16
#: Projections that make a table's bucket, and the width of a projection's cells. Unit vectors of cosine 0.98
#: are 0.2 apart and share a cell with probability 0.84, so a table finds them with 0.25 and 16 tables with 0.99.
PROJECTIONS = 8
CELL = 1.0
#: Buckets are compared in pairs of blocks of about so many vectors.
BLOCK = 1024
SEED = 12


def _plan(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim))
    return rng.normal(size=(dim, TABLES * PROJECTIONS)), rng.uniform(0, CELL, TABLES * PROJECTIONS)


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of length one."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_size(column: pa.Array) -> Iterator[np.ndarray]:
    size = np.array(pc.list_value_length(column))
    for d in np.unique(size):
        yield np.flatnonzero(size == d)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plans: dict[int, tuple] = {}
    odd = np.random.default_rng(SEED).integers(1, 2**63, PROJECTIONS, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        for rows in _by_size(batch.column("embedding")):
            part = batch.take(pa.array(rows))
            x = _unit(part.column("embedding"))
            a, b = plans.setdefault(x.shape[1], _plan(x.shape[1]))
            cell = np.floor((x @ a + b) / CELL).astype(np.int64).astype(np.uint64).reshape(len(x), TABLES, PROJECTIONS)
            mixed = np.zeros((len(x), TABLES), dtype=np.uint64)
            for k in range(PROJECTIONS):
                mixed = (mixed ^ (cell[:, :, k] * odd[k])) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            flat = pa.array(mixed.reshape(-1).view(np.int64))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * TABLES)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(ends, flat)], ["node", "codes"])


def _pairs(member: tuple, least: float):
    """Links within one group: for each member its partners' copies, and a spanning star of each connected part."""
    node, part, table, x, codes, n, both = member
    side = part == part.min()
    links = np.zeros(len(node), dtype=np.int64)
    root = np.arange(len(node))
    left = np.flatnonzero(side) if both else np.arange(len(node))
    right = np.flatnonzero(~side) if both else left
    cos = x[left] @ x[right].T
    near = cos >= least
    if not both:
        near &= ~np.eye(len(left), dtype=bool)
    if near.any():
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        # counted where the pair meets first
        first = ~(codes[i, :table] == codes[j, :table]).any(axis=1) if table else np.ones(len(i), dtype=bool)
        np.add.at(links, i[first], n[j[first]])
        if both:
            np.add.at(links, j[first], n[i[first]])
        while True:  # least label along the links
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
            root = root[root]
            if (root == before).all():
                break
    used = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
    return node[used], links[used], node[root[used]]


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys = np.stack([np.asarray(rows.column(c), dtype=np.int64) for c in ("bucket", "i", "j")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = np.concatenate(([0], cut, [rows.num_rows]))
            x = _unit(rows.column("embedding")) if len(np.unique(np.array(pc.list_value_length(rows.column("embedding"))))) == 1 else None
            node, part, table, n = (np.asarray(rows.column(c)) for c in ("node", "part", "t", "n"))
            codes = np.asarray(rows.column("codes").flatten()).reshape(rows.num_rows, TABLES)
            found = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a > 1:
                    own = x[a:b] if x is not None else _unit(rows.column("embedding").slice(a, b - a))
                    both = keys[1, a] != keys[2, a]
                    if both and len(np.unique(part[a:b])) < 2:
                        continue
                    found.append(_pairs((node[a:b], part[a:b], int(table[a]), own, codes[a:b], n[a:b], both), least))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["node", "links", "root"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                held.append(batch.slice(at, 2000))
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                keys = np.stack([np.asarray(rows.column(c), dtype=np.int64) for c in ("bucket", "i", "j")])
                last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
                whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
                if whole:
                    yield from work(rows.slice(0, whole))
                held = [rows.slice(whole)]
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per vector: `vec_id, n_links, component_id, kept`.

    Vectors of one label, not null, link if a table brings them together and their cosine in
    double precision is `least` or more; equal vectors always do. Null and zero vectors and
    those with null or non-finite components link with nothing, and are their own component. Vectors of
    different dimension never link. Equal vectors are merged first and counted with their number.
    Buckets of several vectors are cut into blocks and each pair of blocks compared in a
    group of its own, so that no group grows with the data; counts leave it, not pairs. Repeated
    ids give as many rows, each a vector of its own for n_links.
    """
    ship(vectors.sparkSession)
    v = F.col(vector_col)
    fine = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(
        F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("embedding"), fine.alias("fine"))
    good = rows.where("fine")
    node = F.xxhash64("label", "embedding")
    distinct = stored(
        good.select(node.alias("node"), "vec_id", "label", "embedding").groupBy("node", "label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")), "vectors"
    )
    coded = stored(distinct.select("node", "embedding").mapInArrow(_codes, "node long, codes array<long>"), "codes")
    labelled = coded.join(distinct.select("node", "label", F.size("embedding").alias("dim")), "node")
    placed = stored(
        labelled.select("node", "label", "dim", F.posexplode("codes").alias("t", "code")).select("node", "t", F.xxhash64("t", "label", "dim", "code").alias("bucket")), "placed"
    )
    crowded = stored(placed.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "crowded")
    member = placed.join(crowded, "bucket").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = member.select("bucket", "node", "t", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bucket", "node", "t", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    full = dealt.join(distinct.select("node", "embedding", "n").join(coded, "node"), "node")
    grouped = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    found = stored(grouped.select("bucket", "i", "j", "node", "part", "t", "n", "embedding", "codes").mapInArrow(_compare(least), "node long, links long, root long"), "links")
    release(placed, crowded, coded)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = distinct.select("node", "least", "n").join(roots, "node", "left").join(counts, "node", "left")
    named = stored(named.select("node", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.join(smallest, "root").select("node", "n_links", "component_id"), "named-all")
    out = good.select("vec_id", node.alias("node")).join(named, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
