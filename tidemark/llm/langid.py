"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes fall into 128 classes: letters without case, and each byte over 127 that can begin or go on a letter of two bytes. Filters two, three and four bytes wide slide over windows of fixed
length; each filter's greatest response in a window goes through a rectifier to a softmax. A
document's scores are the means over all its windows, weighted by the bytes that they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import flat
from tidemark.llm._sample import spread
from tidemark.llm._shared import blocks, crc_part, ship

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The training sample: at most so many documents of a language, and windows of each.
DOCS_EACH = 256
WINDOWS_EACH = 6
UNKNOWN = "und"

_SPACE = 27
CLASSES = 128
_CLASS = np.full(256, 28, dtype=np.uint8)  # other ASCII marks
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = np.arange(26)
_CLASS[ord("0") : ord("9") + 1] = 26
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[0x80:0xC0] = 29 + np.arange(64)
_CLASS[0xC0:0xE0] = 93 + np.arange(32)
_CLASS[0xE0:0xE3], _CLASS[0xE3:0xEA], _CLASS[0xEA:] = 125, 126, 127


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: their starts, the bytes that each holds and the text that it is of."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + nth * WINDOW
    return start, np.minimum(WINDOW, offsets[owner + 1] - start), owner


def _cut(classes: np.ndarray, start: np.ndarray, held: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    out = classes[np.minimum(at, len(classes) - 1)]
    out[np.arange(WINDOW) >= held[:, None]] = _SPACE
    return out


class Network:
    def __init__(self, labels: list[str], seed: int = 4):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.conv = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(labels)))).astype(np.float32)
        self.shift = np.zeros(max(1, len(labels)), dtype=np.float32)

    def freeze(self) -> None:
        """Tables over pairs of classes: a filter's response is one look-up for two bytes."""
        c2, c3, c4 = self.conv
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
        self.tables = (pair(c2[0], c2[1]), pair(c3[0], c3[1]), c3[2], pair(c4[0], c4[1]), pair(c4[2], c4[3]))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        t2, t3, t3b, t4, t4b = self.tables
        p = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
        peak = [t2[p].max(axis=1)]
        r = t3[p[:, :-1]]
        r += t3b[x[:, 2:]]
        peak.append(r.max(axis=1))
        r = t4[p[:, :-2]]
        r += t4b[p[:, 2:]]
        peak.append(r.max(axis=1))
        return np.concatenate(peak, axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x) + self.bias, 0) @ self.out + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 5, size: int = 128, rate: float = 0.01, seed: int = 4) -> None:
        """Adam on the cross-entropy; only the place of a filter's peak passes a gradient back."""
        rng = np.random.default_rng(seed)
        params = [*self.conv, self.bias, self.out, self.shift]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for cut in range(0, len(order), size):
                some = order[cut : cut + size]
                c, peaks, places = x[some].astype(np.int64), [], []
                for w, filt in zip(WIDTHS, self.conv, strict=True):
                    r = sum(filt[j][c[:, j : WINDOW - w + 1 + j]] for j in range(w))
                    at = r.argmax(axis=1)
                    places.append(at)
                    peaks.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
                a = np.concatenate(peaks, axis=1) + self.bias
                h = np.maximum(a, 0)
                z = h @ self.out + self.shift
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(some)), y[some]] -= 1
                p /= len(some)
                back = (p @ self.out.T) * (a > 0)
                grads = []
                for k, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                    g = np.zeros_like(self.conv[k])
                    own = back[:, k * FILTERS : (k + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(c, at + j, 1), f), own)
                    grads.append(g)
                grads += [back.sum(axis=0), h.T @ p, p.sum(axis=0)]
                t += 1
                for i, (param, g) in enumerate(zip(params, grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.99 * v[i] + 0.01 * g * g
                    param -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        self.freeze()


def _has_letter(data: np.ndarray, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, dtype=bool)
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        out[i] = (classes[a:b] < 26).any() or ((data[a:b] >= 0x80).any() and any(c.isalpha() for c in data[a:b].tobytes().decode("utf-8", "replace")))
    return out


def _predictor(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = held.value
        for batch in blocks(batches, "text", 4 << 20):
            data, offsets = flat(batch.column("text"))
            n = batch.num_rows
            classes = _CLASS[data]
            start, size, owner = _windows(data, offsets)
            total = np.zeros((n, max(1, len(net.labels))))
            if net.labels:
                for cut in range(0, len(start), 512):
                    some = slice(cut, cut + 512)
                    p = net.probabilities(_cut(classes, start[some], size[some])) * size[some, None]
                    np.add.at(total, owner[some], p)
            total /= np.maximum(np.diff(offsets), 1)[:, None]
            best = total.argmax(axis=1)
            known = _has_letter(data, classes, offsets) & bool(net.labels)
            named = [net.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(total[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _picker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text", 4 << 20):
        data, offsets = flat(batch.column("text"))
        classes = _CLASS[data]
        start, size, owner = _windows(data, offsets)
        fit_ = np.flatnonzero(size >= 24)
        at = []
        for low, high in zip(np.searchsorted(owner[fit_], np.arange(batch.num_rows)), np.searchsorted(owner[fit_], np.arange(batch.num_rows), side="right"), strict=True):
            if high > low:
                at.append(fit_[low + np.unique(np.linspace(0, high - low - 1, WINDOWS_EACH).astype(int))])
        if at:
            at = np.concatenate(at)
            cut = _cut(classes, start[at], size[at])
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(owner[at])), pa.array([r.tobytes() for r in cut], pa.binary())], ["lang", "window"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network trained on at most DOCS_EACH documents of each language, WINDOWS_EACH windows of each, spread over the text.

    Only ids whose crc32 mod 4 is not 2 and rows with a language count. Rows that repeat id and text count once, and
    the order of rows does not matter. Without any, the network knows no language. Documents of under 24 bytes train nothing.
    """
    ship(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_part(F.col(id_col)) != 2))
    rows = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    got = spread(rows, ["id", "text"], DOCS_EACH, F.col("lang")).select("lang", "text").mapInArrow(_picker, "lang string, window binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    labels = sorted({r[0] for r in got})
    net = Network(labels)
    if got:
        x = np.frombuffer(b"".join(bytes(r[1]) for r in got), dtype=np.uint8).reshape(-1, WINDOW)
        y = np.array([labels.index(r[0]) for r in got])
        rng = np.random.default_rng(9)
        most = np.bincount(y).max()
        at = np.concatenate([rng.choice(np.flatnonzero(y == k), most) for k in range(len(labels))])  # languages weigh alike
        net.fit(x[at], y[at])
    else:
        net.freeze()
    return net


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every whole text; `und` with score 0 where a text is null or has no letter. A null id is not held out."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(net)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_part(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predictor(held), "doc_id long, held_out boolean, lang_pred string, score double")


def _keeper(held, least: float, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _predictor(held)
        for batch in batches:
            for part in blocks(iter([batch]), text_col, 4 << 20):
                n = part.num_rows
                asked = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array([False] * n), part.column(text_col)], ["doc_id", "held_out", "text"])
                keep: list[bool] = []
                for found in score(iter([asked])):
                    keep += [a != UNKNOWN and b >= least for a, b in zip(found.column("lang_pred").to_pylist(), found.column("score").to_pylist(), strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return run


def accepted(docs: DataFrame, net: Network, least: float = 0.35, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text is in a language that the network knows, with a score of `least` or more; all columns stay."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(net)
    return docs.mapInArrow(_keeper(held, least, docs.columns, text_col), docs.schema)
