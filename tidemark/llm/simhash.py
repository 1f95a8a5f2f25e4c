"""SimHash near-duplicates of documents, found by deletion-variant signatures."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import blocks, release, row_key, ship, stored
from tidemark.llm.components import components

SEED = 42
WIDTH = 3
#: Long texts are cut into words in pieces of about so many bytes.
PIECE = 4 << 20
#: A half that more distinct fingerprints share is handled by listing the neighbours of each instead of by a join.
HOT_HALF = 2000
#: Runs of up to so many hashes are counted in bit planes, longer ones in lanes of bytes.
FEW = 63

#: The value of a byte's bits in eight lanes of eight bits.
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _few_majority(hashes: np.ndarray, first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """bit_majority() of short runs: counters whose bits lie in planes of one word a run, added to with carries."""
    order = np.argsort(-runs, kind="stable")
    first, runs = first[order], runs[order]
    longest = int(runs[0])
    planes = np.zeros((longest.bit_length(), len(runs)), dtype=np.uint64)
    active = np.searchsorted(-runs, -np.arange(1, longest + 1), side="right")  # runs with more than i hashes
    for i, n in enumerate(active.tolist()):
        carry = hashes[first[:n] + i]
        for p in range((i + 1).bit_length()):
            own = planes[p, :n]
            own_before = own & carry
            own ^= carry
            carry = own_before
    least = (runs // 2 + 1).astype(np.uint64)  # count >= least, from the highest plane down
    above, equal = np.zeros(len(runs), dtype=np.uint64), np.full(len(runs), ~np.uint64(0))
    for p in range(len(planes) - 1, -1, -1):
        asked = np.uint64(0) - ((least >> np.uint64(p)) & np.uint64(1))
        above |= equal & planes[p] & ~asked
        equal &= ~(planes[p] ^ asked)
    out = np.empty(len(runs), dtype=np.uint64)
    out[order] = above | equal
    return out


def bit_majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For consecutive runs of 64-bit hashes: the bits set in over half of a run's hashes. An empty run gives 0."""
    lengths = lengths.astype(np.int64)
    out = np.zeros(len(lengths), dtype=np.uint64)
    begin = np.cumsum(lengths) - lengths
    few = np.flatnonzero((lengths > 0) & (lengths <= FEW))
    if len(few):
        out[few] = _few_majority(hashes, begin[few], lengths[few])
    full = np.flatnonzero(lengths > FEW)
    if not len(full):
        return out
    runs = lengths[full]
    parts = -(-runs // 255)  # lanes of eight bits hold 255 hashes
    first = np.cumsum(parts) - parts
    nth = np.arange(int(parts.sum())) - np.repeat(first, parts)
    starts = np.repeat(begin[full], parts) + 255 * nth
    sizes = np.minimum(255, np.repeat(runs, parts) - 255 * nth)
    counts = np.empty((len(starts), 64), dtype=np.uint8)
    held = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(held, held[at] + (1 << 17))) - 1)
        within = held[at : to + 1] - held[at]
        where = np.arange(within[-1]) + np.repeat(starts[at:to] - within[:-1], sizes[at:to])
        lanes = _LANES[hashes[where].astype("<u8").view(np.uint8)].reshape(-1, 8)
        counts[at:to] = np.add.reduceat(lanes, within[:-1], axis=0).astype("<u8").view(np.uint8).reshape(-1, 64)
        at = to
    total = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > runs[:, None], axis=1, bitorder="little")
    out[full] = bits.reshape(-1).view("<u8")
    return out


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists; each list after the first begins with the last WIDTH - 1 words of the one before."""
    if len(data) <= PIECE:
        yield data.lower().split()
        return
    begin, tail = 0, []
    while begin < len(data):
        cut = _SPACE.search(data, begin + PIECE)
        end = cut.start() if cut else len(data)
        words = tail + data[begin:end].lower().split()
        yield words
        begin, tail = end, words[-(WIDTH - 1) :]


def _shingle_hashes(data: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    found, n, head = [], 0, []
    for words in _words(data):
        m = len(words) - WIDTH + 1
        if m > 0:
            n += m
            found.append(np.fromiter(map(h, map(b" ".join, zip(*(words[i:] for i in range(WIDTH)), strict=False)), repeat(SEED)), np.uint64, m))
        elif not found:
            head = words
    if n:
        return found[0] if len(found) == 1 else np.concatenate(found)
    return np.array([h(b" ".join(head), SEED)] if head else [], dtype=np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        each = [_shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("text")]
        fp = bit_majority(np.concatenate(each), np.array([len(x) for x in each]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, row, fp`: 64-bit SimHash of the 3-word shingles of each whole text, as a signed long.

    A null text has no words; no words give 0. `row` is a hash of id and text.
    """
    ship(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).cast("binary").alias("text")
    ).mapInArrow(_fingerprints, "doc_id long, row long, fp long")


def _bits(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def _half(fp, side: int):
    return F.shiftrightunsigned(fp, 32) if side == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def links(distinct: DataFrame, hot_half: int = HOT_HALF) -> DataFrame:
    """Pairs `a, b` of different fingerprints in column `fp` that differ in one or two bits.

    Of two halves, one differs in at most one bit. Each fingerprint is indexed by either half
    as it is and by the half with each of its 32 bits wiped out in turn. An equality join on
    these variants finds every pair: under the plain half, the other half may differ in two
    bits; under a wiped one, only fingerprints with different values of the wiped bit meet and
    the other half may differ in one. The join's condition tests this, so that only links leave it.
    A half shared by over `hot_half` fingerprints is left out of the join; there the 1584
    fingerprints that would link are listed for each and looked up, which finds the same links.
    Neither join may broadcast: Spark takes exploded rows for as few as they were before, and
    the driver would hold 33 rows a fingerprint.
    """
    fp = F.col("fp")
    halves = [
        distinct.select(_half(fp, s).alias("half")).groupBy("half").count().where(F.col("count") > hot_half).select(F.lit(s).alias("side"), "half")
        for s in (0, 1)
    ]
    hot = stored(halves[0].union(halves[1]), "hot-halves")
    is_hot = hot.limit(1).count() > 0
    found = []
    for s in (0, 1):
        own, other = _half(fp, s), _half(fp, 1 - s)
        base = distinct.select("fp", own.alias("own"))
        if is_hot:
            base = base.join(hot.where(F.col("side") == s).select(F.col("half").alias("own")), "own", "left_anti")
        variant = F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(32)),
                lambda i: F.shiftleft(i.cast("long"), 32).bitwiseOR(
                    F.when(i == 0, F.col("own")).otherwise(F.col("own").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))))
                ),
            )
        )
        rows = base.select("fp", variant.alias("key"))
        left, right = rows.alias("l"), rows.alias("r")
        lf, rf, wild = F.col("l.fp"), F.col("r.fp"), F.shiftrightunsigned(F.col("l.key"), 32) > 0
        same_side = _bits(_half(lf, s), _half(rf, s))
        found.append(
            left.join(
                right.hint("merge"),
                (F.col("l.key") == F.col("r.key")) & (lf < rf) & (_bits(lf, rf) <= 2) & ((wild & (same_side == 1)) | (~wild & (same_side == 0))),
            ).select(lf.alias("a"), rf.alias("b"))
        )
        if is_hot:
            shift = 32 if s == 0 else 0
            near = [1 << i for i in range(32)]
            two = [x | y for i, x in enumerate(near) for y in near[:i]]
            masks = [(0, m) for m in near + two] + [(x, y) for x in near for y in [0, *near]]
            signed = [v - (1 << 64) if (v := (x << shift) | (y << (32 - shift))) >> 63 else v for x, y in masks]
            listed = (
                distinct.select("fp", own.alias("half"))
                .join(hot.where(F.col("side") == s).select("half"), "half")
                .select(fp.alias("a"), F.explode(F.transform(F.lit(signed), lambda m: F.col("fp").bitwiseXOR(m))).alias("b"))
            )
            found.append(listed.join(distinct.select(fp.alias("b")).hint("merge"), "b").select("a", "b"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, hot_half: int) -> tuple[DataFrame, DataFrame]:
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, hot_half))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    group = F.coalesce("root", "fp")
    least = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    joined = named.select("fp", "least", group.alias("root")).join(least, "root", "left")
    return prints, stored(joined.select("fp", "root", F.coalesce("component_id", "least").alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_half: int = HOT_HALF) -> DataFrame:
    """One row per document: `doc_id, fingerprint, component_id`.

    The fingerprint is 16 lowercase hex digits, component_id the least doc_id that links of at
    most two differing bits reach. Texts without words, null texts included, have fingerprint
    zero and link like others. Repeated rows give as many rows. A null doc_id keeps its row but
    names no component; a component of null ids only has a null component_id. An empty table
    gives no rows. Other columns, whatever their names, are not looked at.
    """
    prints, classes = _classes(docs, id_col, text_col, hot_half)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_half: int = HOT_HALF) -> DataFrame:
    """The rows of `docs` without those whose group has a document with a smaller id.

    Among rows of one id, the least hash of the text stays; of wholly equal rows, one.
    """
    prints, classes = _classes(docs, id_col, text_col, hot_half)
    keyed = prints.join(classes, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    winners = stored(keyed.groupBy("root").agg(F.min("row").alias("__tm_row")).select("__tm_row"), "winners")
    repeated = prints.groupBy("row").count().where("count > 1").limit(1).count() > 0
    release(prints)
    out = docs.withColumn("__tm_row", row_key(id_col, text_col)).join(winners, "__tm_row", "left_semi")
    if repeated:
        out = out.dropDuplicates(["__tm_row"])
    return out.drop("__tm_row")
