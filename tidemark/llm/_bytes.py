"""Work on the bytes of a whole Arrow batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and the offsets of each; null texts are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    column = pa.concat_arrays([column])  # its buffers begin with the first text
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(member: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of true values, cut at text bounds, that have `least` or more."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(member) + 1, dtype=bool)
    edge[1:-1] = member[1:] != member[:-1]
    edge[0] = edge[-1] = True
    inner = offsets[(offsets > 0) & (offsets < len(member))]
    edge[inner] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    ok = member[start] & (end - start >= least)
    return start[ok], end[ok]


def owners(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which text each byte place is in."""
    return np.searchsorted(offsets, places, side="right") - 1


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    return out


def code_points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The code points before each byte place of one text."""
    return np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), places)


def outside(spans: np.ndarray, others: list[tuple[int, int]]) -> np.ndarray:
    """The spans that none of the others overlaps, in one pass over their bounds."""
    if not len(others):
        return spans
    start, end = np.array(sorted(others)).T
    reach = np.maximum.accumulate(end)
    before = np.searchsorted(start, spans[:, 1]) - 1  # the last that begins before a span's end
    return spans[(before < 0) | (reach[np.maximum(before, 0)] <= spans[:, 0])]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_PART = 1 << 16
_POWER = np.cumprod(np.full(_PART, _ODD, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes: sums over its parts of up to 64 kB of polynomials in their bytes, modulo 2^64."""
    parts = -(-size // _PART)
    whose = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(whose)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = start[whose] + nth * _PART
    own = np.minimum(_PART, size[whose] - nth * _PART)
    out = size.astype(np.uint64)
    end = np.cumsum(own)
    at = 0
    while at < len(own):
        low = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, low + (1 << 20), side="right")))
        first = end[at:to] - own[at:to] - low
        within = np.arange(end[to - 1] - low) - np.repeat(first, own[at:to])
        byte = data[within + np.repeat(begin[at:to], own[at:to])].astype(np.uint64)
        h = np.add.reduceat((byte + np.uint64(1)) * _POWER[within], first)
        np.add.at(out, whose[at:to], mix(h + nth[at:to].astype(np.uint64) * _ODD))
        at = to
    return mix(out)


def different(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of n owners has."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(owner[new], minlength=n)
