"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges of a merge-type (BPE) vocabulary run by the vocabulary's order, leftmost first. Each
candidate merge is skipped by a hash keyed by seed, document, place in the text and result, so
that every occurrence of a word has a segmentation of its own and a seed gives the same ones again;
all decode to the same text. With no dropout the ids equal the library's own. A chunk is a run of
spaces and the letters after it; no piece of such a vocabulary reaches over a chunk's end, which the
vocabulary is tested for. Chunks of up to LONG characters take their merges off the agenda in
lockstep, many chunks at a time; longer ones are first cut where no piece holds the two
characters, and what is still longer is merged from a heap.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import blocks, row_key, ship

DROPOUT = 0.1
SEED = 7
#: Longer chunks are cut, and merged by an agenda one by one if they stay longer; shorter ones in lockstep.
LONG = 64
#: Bytes of text that are encoded at a time; the arrays over their chunks take up to forty times as much memory.
BLOCK = 1 << 20
_SPACE = "▁"
_NONE = np.int32(2**31 - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and merges as arrays, made once on the driver from the model's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        of = {pieces[i]: i for i in plain}
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in of):
            raise ValueError("a piece of this vocabulary reaches over the end of a chunk")
        by_byte = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(by_byte) != 256:
            raise ValueError("decoding without loss needs byte pieces")
        self.byte_id = np.array([by_byte[b] for b in range(256)], dtype=np.int32)
        self.char_id = np.arange(n, n + 0x110000, dtype=np.int32)  # unknown characters: size + code point
        for p, i in of.items():
            if len(p) == 1:
                self.char_id[32 if p == _SPACE else ord(p)] = i
        self.char_id[ord(_SPACE)] = n + ord(_SPACE)
        order = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        pairs = sorted((of[p[:k]] * n + of[p[k:]], order[i], i) for p, i in of.items() for k in range(1, len(p)) if p[:k] in of and p[k:] in of)
        self.keys = np.array([x[0] for x in pairs], dtype=np.int64)
        self.rank = np.array([x[1] for x in pairs], dtype=np.int32)
        self.at_rank = np.zeros(len(order), dtype=np.int32)
        for i, k in order.items():
            self.at_rank[k] = i
        data = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(_SPACE, " ").encode() if i in set_ else b"" for set_ in [set(plain)] for i, p in enumerate(pieces)]
        self.piece_size = np.array([len(x) for x in data], dtype=np.int64)
        self.piece_at = np.concatenate(([0], np.cumsum(self.piece_size)[:-1]))
        self.piece_bytes = np.frombuffer(b"".join(data), dtype=np.uint8)
        code = lambda c: 32 if c == _SPACE else ord(c)
        self.inside = np.unique(np.array([code(a) << 32 | code(b) for p in of for a, b in zip(p, p[1:], strict=False)], dtype=np.uint64))
        self._by_pair: dict[int, int] | None = None

    @property
    def by_pair(self) -> dict[int, int]:
        if self._by_pair is None:
            self._by_pair = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True))
        return self._by_pair

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Order of the merge of each pair, _NONE if there is none."""
        key = left.astype(np.int64) * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _skipped(key: np.ndarray, start: np.ndarray, split: np.ndarray, rank: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate merges are skipped: by chunk key, first character, character where the right part begins, and result."""
    x = key + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = _mix(x) + split.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x = _mix(x) + rank.astype(np.uint64)
    return (_mix(x) >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


def _ranks(v: Vocabulary, left, right, key, start, split, dropout: float) -> np.ndarray:
    rank = v.pair_rank(left, right)
    if dropout > 0:
        real = np.flatnonzero(rank != _NONE)
        if len(real):
            rank[real[_skipped(key[real], start[real], split[real], rank[real], dropout)]] = _NONE
    return rank


def _lockstep(v: Vocabulary, sym: np.ndarray, keys: np.ndarray, offset: np.ndarray, dropout: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merge chunks of one length, given as rows, that begin at an offset of what their keys count from. Returns (row numbers, symbols) by the number of symbols left."""
    n, width = sym.shape
    row = np.arange(n)
    out = []
    start = offset[:, None] + np.arange(width)
    rank = np.full((n, width), _NONE, dtype=np.int32)  # of the pair of a symbol and the next one
    if width > 1:
        flat = lambda x: np.ascontiguousarray(x).reshape(-1)
        rank[:, :-1] = _ranks(v, flat(sym[:, :-1]), flat(sym[:, 1:]), np.repeat(keys, width - 1), flat(start[:, :-1]), flat(start[:, 1:]), dropout).reshape(n, width - 1)
    while len(row):
        at = rank.argmin(axis=1)
        best = rank[np.arange(len(row)), at]
        done = best == _NONE
        if done.any():
            out.append((row[done], sym[done]))
            go = ~done
            row, sym, start, rank, at, best, keys = row[go], sym[go], start[go], rank[go], at[go], best[go], keys[go]
            if not len(row):
                break
        every = np.arange(len(row))
        sym[every, at] = v.at_rank[best]
        keep = np.ones(sym.shape, dtype=bool)
        keep[every, at + 1] = False
        width = sym.shape[1] - 1
        sym, start, rank = (x[keep].reshape(-1, width) for x in (sym, start, rank))
        for shift in (-1, 0):  # the pairs that the merged symbol now ends and begins
            p = at + shift
            ok = np.flatnonzero((p >= 0) & (p + 1 < width))
            q = p[ok]
            rank[ok, q] = _ranks(v, sym[ok, q], sym[ok, q + 1], keys[ok], start[ok, q], start[ok, q + 1], dropout)
        last = np.flatnonzero(at == width - 1)
        rank[last, width - 1] = _NONE
    return out


_M64 = (1 << 64) - 1


def _skips(key: int, start: int, split: int, rank: int, limit: float) -> bool:
    """_skipped() of one candidate, in Python's integers; limit is the dropout times 2^53."""
    x = key + start * 0x9E3779B97F4A7C15 & _M64
    for more in (split * 0xD1B54A32D192ED03, rank, 0):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M64
        x = (x ^ (x >> 31)) + more & _M64
    return x >> 11 < limit


def _agenda(v: Vocabulary, symbols: np.ndarray, key: int, offset: int, dropout: float) -> np.ndarray:
    """The same merges for one chunk of any length, by a heap of candidates."""
    n, size, limit, by_pair = len(symbols), v.size, dropout * 2.0**53, v.by_pair
    sym, nxt, prev = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    place = np.arange(offset, offset + n)
    first = _ranks(v, symbols[:-1], symbols[1:], np.full(n - 1, key, dtype=np.uint64), place[:-1], place[1:], dropout)
    some = np.flatnonzero(first != _NONE)
    heap = [(r, p, p + 1, sym[p], sym[p + 1]) for r, p in zip(first[some].tolist(), some.tolist(), strict=True)]
    heapq.heapify(heap)
    while heap:
        r, p, q, left, right = heapq.heappop(heap)
        if sym[p] != left or sym[q] != right or nxt[p] != q:
            continue
        sym[p] = int(v.at_rank[r])
        sym[q] = -1
        nxt[p] = after = nxt[q]
        if after < n:
            prev[after] = p
        for i, j in ((prev[p], p), (p, after)):
            if i >= 0 and j < n and sym[i] < size and sym[j] < size:
                r = by_pair.get(sym[i] * size + sym[j])
                if r is not None and not (limit and _skips(key, offset + i, offset + j, r, limit)):
                    heapq.heappush(heap, (r, i, j, sym[i], sym[j]))
    return np.array([s for s in sym if s >= 0], dtype=np.int32)


def _to_bytes(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Unknown characters become their UTF-8 bytes' pieces."""
    if (ids < v.size).all():
        return ids
    return np.concatenate([v.byte_id[np.frombuffer(chr(x - v.size).encode("utf-8", "surrogatepass"), np.uint8)] if x >= v.size else np.array([x], np.int32) for x in ids.tolist()])


def _encode_chunks(v: Vocabulary, codes: np.ndarray, begin: np.ndarray, keys: np.ndarray, offset: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the chunks that begin there: all in one array, where each begins, and how many each has."""
    size = np.diff(np.append(begin, len(codes)))
    parts: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    count = np.zeros(len(begin), dtype=np.int64)
    order = np.argsort(size, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
        length = int(size[same[0]])
        if length > LONG:
            found = [(np.array([i]), _agenda(v, v.char_id[codes[begin[i] : begin[i] + length]], int(keys[i]), int(offset[i]), dropout)[None, :]) for i in same]
        else:
            found = []
            for cut in range(0, len(same), 1 << 15):
                some = same[cut : cut + (1 << 15)]
                found += [(some[r], s) for r, s in _lockstep(v, v.char_id[codes[begin[some][:, None] + np.arange(length)]], keys[some], offset[some], dropout)]
        for rows, symbols in found:
            odd = (symbols >= v.size).any(axis=1)
            for r, s in zip(rows[odd], symbols[odd], strict=True):
                ids = _to_bytes(v, s)
                parts.append(ids)
                owner.append(np.array([r]))
                count[r] = len(ids)
            rows, symbols = rows[~odd], symbols[~odd]
            parts.append(symbols.reshape(-1))
            owner.append(rows)
            count[rows] = symbols.shape[1]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(begin), np.int64), count
    rows = np.concatenate(owner)
    at = np.zeros(len(begin), dtype=np.int64)
    at[rows] = np.concatenate(([0], np.cumsum(count[rows])[:-1]))
    return np.concatenate(parts).astype(np.int32), at, count


def _gather(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of consecutive runs: at[0], at[0] + 1, ... count[0] of them, then those of the next."""
    total = int(count.sum())
    shift = at - np.concatenate(([0], np.cumsum(count)[:-1]))
    return np.repeat(shift, count) + np.arange(total)


def encode_texts(v: Vocabulary, texts: list[str], seed: int = SEED, dropout: float = DROPOUT, documents: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and how many each text has. An empty text has none.

    `documents` are the keys of the texts' documents; without them, the places in the list.
    """
    each = [" " + t if t else "" for t in texts]
    codes = np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate(([0], np.cumsum([len(t) for t in each]))).astype(np.int64)
    first = codes == 32
    first[1:] &= codes[:-1] != 32
    first[ends[:-1][np.diff(ends) > 0]] = True
    begin = np.flatnonzero(first)
    per_text = np.diff(np.searchsorted(begin, ends))
    text = np.repeat(np.arange(len(texts)), per_text)
    keys = np.zeros(len(begin), dtype=np.uint64)
    if dropout > 0 and len(begin):
        document = np.arange(len(texts), dtype=np.uint64) if documents is None else documents
        nth = np.arange(len(begin)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        keys = _mix(_mix(document[text] + np.uint64(seed)) + nth.astype(np.uint64))
    # long chunks are cut where no piece holds the two characters: no merge ever reaches over such a place
    size = np.diff(np.append(begin, len(codes)))
    long_ = np.repeat(size > LONG, size)
    at = np.flatnonzero(long_[1:] & ~first[1:] & long_[:-1]) + 1
    pair = codes[at - 1].astype(np.uint64) << np.uint64(32) | codes[at]
    cut = at[v.inside[np.minimum(np.searchsorted(v.inside, pair), len(v.inside) - 1)] != pair]
    starts = np.sort(np.concatenate([begin, cut]))
    chunk = np.searchsorted(begin, starts, side="right") - 1
    ids, place, count = _encode_chunks(v, codes, starts, keys[chunk], starts - begin[chunk], dropout)
    return ids[_gather(place, count)], np.bincount(text[chunk], weights=count, minlength=len(texts)).astype(np.int64)


def decode_ids(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """UTF-8 of each run of ids, without the space that encoding puts before a text."""
    width = v.piece_size[ids]
    data = v.piece_bytes[_gather(v.piece_at[ids], width)].tobytes()
    ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)].tolist()
    return [data[a + 1 if data[a : a + 1] == b" " else a : b] for a, b in zip(ends, ends[1:], strict=False)]


def _encoder(held, seed: int, dropout: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in blocks(batches, "text", BLOCK):
            texts = batch.column("text").to_pylist()
            documents = np.asarray(batch.column("row"), dtype=np.int64).view(np.uint64)
            ids, sizes = encode_texts(v, [t or "" for t in texts], seed, dropout, documents)
            back = decode_ids(v, ids, sizes)
            whole = [t is not None and b == t.encode("utf-8", "surrogatepass") for t, b in zip(texts, back, strict=True)]
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(whole, pa.bool_())], ["doc_id", "ids", "lossless"])

    return run


def encode(docs: DataFrame, model: str | None = None, seed: int = SEED, dropout: float = DROPOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, ids, lossless` for every row: the ids of the whole text, and whether they decode to it.

    A document is told from others by id and text. A null text has null ids and is not lossless;
    an empty one has no ids; a null id is an id like others. Rows that repeat both id and text give equal ids; an empty table gives no rows. Other
    columns are not looked at. `model` is the path of a merge-type SentencePiece model that the driver can read.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model or default_model(), "rb") as f:
        held = spark.sparkContext.broadcast(Vocabulary(f.read()))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoder(held, seed, dropout), "doc_id long, ids array<int>, lossless boolean")


def _decoder(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in batches:
            column = batch.column("ids")
            for cut in range(0, batch.num_rows, 256):
                part = column.slice(cut, 256)
                sizes = np.array([len(x.values) if x.is_valid else 0 for x in part], dtype=np.int64)
                text = decode_ids(v, np.asarray(part.flatten(), dtype=np.int64), sizes)
                text = [t.decode("utf-8", "replace") if x.is_valid else None for t, x in zip(text, part, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(cut, 256), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """`doc_id, text` from the columns doc_id and ids of encode(); null ids give a null text."""
    spark = encoded.sparkSession
    ship(spark)
    with open(model or default_model(), "rb") as f:
        held = spark.sparkContext.broadcast(Vocabulary(f.read()))
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(held), "doc_id long, text string")
