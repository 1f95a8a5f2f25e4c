"""Quality scores by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import different, flat, owners, range_hashes, runs, table
from tidemark.llm._sample import spread
from tidemark.llm._shared import blocks, crc_part, ship

#: The training sample: at most so many trusted positives, and so many unlabelled documents.
SAMPLE, UNLABELLED = 4096, 4096
THRESHOLD = 0.7

#: Classes of bytes whose pairs are counted: letters, digits, blanks, line ends, single marks, other marks, the two kinds of bytes over 127.
_MARKS = b".,!?*$%&#|-:;\"'()/<>=_@+"
_CLASS = np.full(256, 5, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 6, 7
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = 8 + _i
_N = 8 + len(_MARKS)
WIDTH = _N * _N + _N + 7
_PIECE = 1 << 20
_BLANK = table(b" \t\n\x0b\x0c\r")


def _repetition(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each whole text: words, their mean length, share of different ones, share equal to the one before, share of different lines, lines, and whether it has no word."""
    n = len(offsets) - 1
    data = np.frombuffer(data.tobytes().lower(), dtype=np.uint8)
    start, end = runs(~_BLANK[data], offsets, 1)
    text = owners(start, offsets)
    h = range_hashes(data, start, end - start)
    words = np.bincount(text, minlength=n)
    same = np.bincount(text[1:][(h[1:] == h[:-1]) & (text[1:] == text[:-1])], minlength=n)
    chars = np.bincount(text, weights=end - start, minlength=n)
    full = np.flatnonzero(np.diff(offsets))
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[full], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[full + 1]]))
    line = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offsets)) + (np.diff(offsets) > 0))
    lines = np.bincount(line, minlength=n)
    lines_different = different(line, range_hashes(data, starts, ends - starts), n)
    most = np.maximum(words, 1)
    return np.stack([np.log1p(words), chars / most, different(text, h, n) / most, same / most, lines_different / np.maximum(lines, 1), np.log1p(lines), words == 0], axis=1)


def features(column: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers for each text: shares of byte classes and of pairs of them over the whole text, and its repetition."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), dtype=np.float32)
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b > a:
            pairs = np.zeros(_N * _N)
            single = np.zeros(_N)
            for p in range(a, b, _PIECE):
                c = _CLASS[data[p : min(b, p + _PIECE + 1)]]
                pairs += np.bincount(c[:-1] * _N + c[1:], minlength=_N * _N)
                single += np.bincount(c[:_PIECE], minlength=_N)
            out[i, : _N * _N] = np.sqrt(pairs / (b - a))
            out[i, _N * _N : -7] = np.sqrt(single / (b - a))
    out[:, -7:] = _repetition(data, offsets)
    return out


class Model:
    """A linear scorer of standardised features, fitted to the non-negative unbiased risk."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.02, shrink: float = 1e-3, seed: int = 2):
        if not len(positive) or not len(unlabelled):
            self.mean, self.scale, self.weight, self.bias = np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), float(np.log(prior / (1 - prior)))
            return
        every = np.concatenate([positive, unlabelled]).astype(np.float64)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 0.02
        p, u = self._standard(positive), self._standard(unlabelled)
        w, b = np.zeros(WIDTH), float(np.log(prior / (1 - prior)))
        m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
        rng = np.random.default_rng(seed)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for t in range(1, rounds + 1):
            xp, xu = p[rng.integers(0, len(p), 1024)], u[rng.integers(0, len(u), 1024)]
            sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
            # the risk of calling things negative: of the unlabelled, less the positives among them
            negative = -np.log(1 - su + 1e-12).mean() - prior * -np.log(1 - sp + 1e-12).mean()
            slope_p = prior * (sp - 1) / len(xp)  # positives called positive
            low_u, low_p = su / len(xu), -prior * sp / len(xp)
            if negative < 0:  # below zero the estimate is overfit: that part is stepped back up
                slope_p, low_u, low_p = 0 * slope_p, -low_u, -low_p
            gw = xp.T @ (slope_p + low_p) + xu.T @ low_u + shrink * w
            g = np.append(gw, (slope_p + low_p).sum() + low_u.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - float(step[-1])
        self.weight, self.bias = w, b

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self._standard(x) @ self.weight + self.bias, -30, 30)
        return 1 / (1 + np.exp(-z))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most SAMPLE trusted positives and UNLABELLED unlabelled documents; ids whose crc32 mod 4 is 2, and null ids, are left out.

    The unlabelled are drawn from all documents. The class prior is estimated as the share of
    label 1 among the labels, smoothed; single negatives are used for nothing else. An id that is
    labelled both ways counts for neither. Rows of one id with other texts are documents of their own, rows that
    repeat both count once, and the order of rows does not matter. Without positives or documents every score is the prior.
    """
    ship(docs.sparkSession)
    seen = (
        labels.where(F.col(label_col).isNotNull() & (crc_part(F.col(id_col)) != 2))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
        .where("low = high")
    )
    one, every = seen.agg(F.count(F.when(F.col("low") == 1, 1)), F.count(F.lit(1))).first()
    prior = min(0.98, (one + 1) / (every + 2))
    rows = docs.where(crc_part(F.col(id_col)) != 2).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    good = spread(rows.join(F.broadcast(spread(seen.where("low = 1").select("id"), ["id"], SAMPLE, salt=1)), "id", "left_semi"), ["id", "text"], SAMPLE, salt=1)
    other = spread(rows, ["id", "text"], UNLABELLED, salt=2)
    return Model(*(_collected(x.select("text")) for x in (good, other)), prior)


def _collected(sample: DataFrame) -> np.ndarray:
    got = sorted(bytes(r["x"]) for r in sample.mapInArrow(_measured, "x binary").collect())
    return np.frombuffer(b"".join(got), dtype=np.float32).reshape(-1, WIDTH)


def _scorer(held, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in blocks(batches, "text"):
            score = model.score(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every whole text. Null texts score as empty ones; a null id is not held out. Repeated rows give as many rows; other columns are not looked at."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_part(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(held, threshold), "doc_id long, held_out boolean, score double, predicted int")
