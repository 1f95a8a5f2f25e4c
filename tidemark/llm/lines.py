"""Fuzzy line deduplication: SimHash in blocks of word pairs, equality joins on the blocks, edit similarity, one occurrence per group."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import flat, runs, table
from tidemark.llm._bytes import mix as _mix
from tidemark.llm._shared import blocks, release, row_key, ship, stored, sweep
from tidemark.llm.components import CHUNK, components
from tidemark.llm.simhash import bit_majority

SIMILARITY = 0.8
#: A line of up to STEEP characters has about two blocks for every CHARS of them; beyond, the number of blocks grows with this power of the length.
CHARS, STEEP, GROWTH = 28, 400, 0.7
#: Lines under so many characters are also cut into twice as many blocks.
BRIEF = 160
#: Blocks of fewer votes are not keys, unless they are whole lines: too many lines share them.
VOTES = 2
#: Candidates of at least SHORT words each are not tested if the SimHashes of their words or of their pairs of words differ in more bits; unrelated lines differ in 32 or so.
SHORT, FAR_BITS, FAR_PAIRS = 12, 18, 23
#: Rounds of tests between the labels of a block go on while each takes away a quarter of the pairs left, and these are more than so many a line.
PAIRS_A_LINE = 0.25
#: Lines under one block are paired in parts of about so many.
PART = 2000
#: So many line keys are broadcast at most when texts of candidate lines are fetched; more go by shuffle.
BROADCAST_KEYS = 1_000_000
#: Texts from this length on are first tried by an upper bound of their distance: the exact one is not taken if the bound is over so many times what is allowed.
LONG, SLACK = 30, 1.25
#: Long texts that have few words once are also bounded by their runs of so many words.
RUN = 3

_HASH_BITS = 42
_BLANK = table(b" \t\n\x0b\x0c\r")
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- edit similarity ---------------------------------------------------------------------------


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their common prefix and suffix, which are found by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]:
            low = mid
        else:
            high = mid - 1
    return a[: len(a) - low], b[: len(b) - low]


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance by Myers' bit vectors; Python's integers hold a whole column.

    With `most`, any distance above it may come back as most + 1, and sooner.
    """
    if a == b:
        return 0
    a, b = sorted(_trimmed(a, b), key=len, reverse=True)  # a step for each character of the shorter
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for left, ch in zip(range(len(b) - 1, -1, -1), b, strict=True):
        if most is not None and score - left - 1 > most:
            return most + 1
        same = at.get(ch, 0)
        vertical = same | down
        flat_ = (((same & up) + up) ^ up) | same
        rise = down | (full & ~(flat_ | up))
        fall = up & flat_
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up = fall | (full & ~(vertical | rise))
        down = rise & vertical
    return score


#: Texts of up to so many characters are measured many pairs at a time, in arrays of up to so many words of bits.
WIDE, WORDS = 1024, 1 << 18
#: So many pairs repay the arrays; pairs of so many words of bits, or fewer, are taken together.
FEW, DEEP = 24, np.array([1, 2, 3, 4, 6, 8, 12, 16])
#: After every so many columns, pairs are left out that can no longer come to what is allowed.
LOOK = 32


def _distances(xs: list[str], ys: list[str], most: list[int] | None = None) -> np.ndarray:
    """edit_distance() of many pairs: Myers' bit vectors in blocks of 64 rows, all pairs at a time; each block is a column behind the one above it.

    With `most`, any distance above a pair's may come back as that plus 1, and sooner.
    """
    out = np.zeros(len(xs), dtype=np.int64)
    tall, flat_ = zip(*((x, y) if len(x) >= len(y) else (y, x) for x, y in zip(xs, ys, strict=True)), strict=True) if xs else ((), ())
    m, n = (np.fromiter(map(len, side), dtype=np.int64, count=len(xs)) for side in (tall, flat_))
    deep = -(-m // 64)
    group = np.where(deep <= DEEP[-1], DEEP[np.minimum(np.searchsorted(DEEP, deep), len(DEEP) - 1)], deep)
    for words in np.unique(group[m > 0]).tolist():
        order = np.flatnonzero((group == words) & (m > 0))
        order = order[np.argsort(-(n + deep)[order], kind="stable")]
        if len(order) < FEW:
            out[order] = [edit_distance(tall[i], flat_[i], most and most[i]) for i in order.tolist()]
            continue
        at = 0
        while at < len(order):
            some = order[at : at + max(1, WORDS // (64 * words))]
            at += len(some)
            out[some] = _columns([tall[i] for i in some], [flat_[i] for i in some], words, None if most is None else np.array([most[i] for i in some]))
    return out


def _columns(tall: list[str], flat_: list[str], words: int, most: np.ndarray | None) -> np.ndarray:
    """The distances of pairs of texts, in order of falling steps."""
    m, n = (np.fromiter(map(len, side), dtype=np.int64, count=len(side)) for side in (tall, flat_))
    code = np.frombuffer("".join([*tall, *flat_]).encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(int(code.max()) + 1, dtype=bool)
    there[code] = True
    place = (np.cumsum(there) - 1)[code]
    letters, one, pairs = int(place.max()) + 1, np.uint64(1), np.arange(len(m))
    if letters > 256 and len(m) > 1:  # fewer pairs have fewer letters
        half = len(m) // 2
        return np.concatenate([_columns(tall[k], flat_[k], words, None if most is None else most[k]) for k in (slice(half), slice(half, None))])
    pair, row = np.repeat(pairs, m), _runs_at(np.zeros(len(m), np.int64), m)
    match = np.zeros(words * len(m) * letters, dtype=np.uint64)
    np.add.at(match, ((row >> 6) * len(m) + pair) * letters + place[: len(row)], one << (row & 63).astype(np.uint64))
    base = (np.arange(words)[:, None] * len(m) + pairs) * letters
    low, top = (m - 1) >> 6, ((m - 1) & 63).astype(np.uint64)  # where a pair's last row is
    column = np.zeros((int((n + low).max()) + words, len(m)), dtype=np.int64)
    column[words - 1 + _runs_at(np.zeros(len(m), np.int64), n), np.repeat(pairs, n)] = place[len(row) :]
    up, down = np.full((words, len(m)), ~np.uint64(0)), np.zeros((words, len(m)), dtype=np.uint64)
    rise, fall = np.zeros((words + 1, len(m)), dtype=np.uint64), np.zeros((words + 1, len(m)), dtype=np.uint64)  # into each block
    rise[0] = one
    out, score, who = m.copy(), m.copy(), pairs
    steps = n + low
    for s in range(int(steps[0])):
        k, h = int(np.searchsorted(-steps, -s)), min(words, s + 1)
        if not k:
            break
        same = match[base[:h, :k] + column[s + words - h : s + words][::-1, :k]]
        u, d, r, f = up[:h, :k], down[:h, :k], rise[:h, :k], fall[:h, :k]
        vertical = same | d
        same |= f
        across = (((same & u) + u) ^ u) | same
        plus, minus = d | ~(across | u), u & across
        low_plus, low_minus = plus << one | r, minus << one | f
        u[...] = low_minus | ~(vertical | low_plus)
        d[...] = low_plus & vertical
        rise[1 : h + 1, :k], fall[1 : h + 1, :k] = plus >> np.uint64(63), minus >> np.uint64(63)
        last = np.minimum(low[:k], h - 1)
        change = ((plus[last, pairs[:k]] >> top[:k]) & one).astype(np.int64) - ((minus[last, pairs[:k]] >> top[:k]) & one).astype(np.int64)
        score[:k] += np.where((s >= low[:k]) & (s < steps[:k]), change, 0)
        if most is None or h < words or s % LOOK != LOOK - 1:
            continue
        # a path goes through a cell where a block is now, or passes one by; what is above and below a block's 64 rows bounds all of them
        own = np.bitwise_count(u).astype(np.int64) - np.bitwise_count(d)
        below = s + 1 + np.cumsum(own, axis=0)
        below[1:] -= np.cumsum(rise[1:words, :k].astype(np.int64) - fall[1:words, :k].astype(np.int64), axis=0)
        least = ((2 * below - own - 64) // 2).min(axis=0) - 1
        over = (least > most[:k]) & (n[:k] > s)
        if over.sum() * 8 >= k:
            out[who[k:]], out[who[:k][over]] = score[k:], most[:k][over] + 1
            left = np.flatnonzero(~over)
            up, down, rise, fall, base, column = (each[:, left] for each in (up, down, rise, fall, base, column))
            n, low, top, steps, score, most, who = (each[left] for each in (n, low, top, steps, score, most, who))
    out[who] = score
    return out


def _gaps(a: str, b: str, run: int = 1) -> list[tuple[str, str]]:
    """What differs between words that either side has once, held in order where most of them agree; with `run`, words that begin a run of so many that either side has once."""

    def once(t: str) -> dict[str, tuple[int, int]]:
        out: dict[str, tuple[int, int]] = {}
        place = 0
        words = t.split(" ")
        for w, key in zip(words, words if run == 1 else map(" ".join, zip(*(words[k:] for k in range(run)), strict=False)), strict=False):
            out[key] = (-1, 0) if key in out else (place, len(w))
            place += len(w) + 1
        return out

    there = once(b)
    both = [(i, there[w][0], n) for w, (i, n) in once(a).items() if n and there.get(w, (-1, 0))[1]]
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = [-1] * len(both)
    for k, (_, j, _) in enumerate(both):  # the longest rising run of places in b
        p = bisect_left(tails, j)
        before[k] = ends[p - 1] if p else -1
        tails[p : p + 1], ends[p : p + 1] = [j], [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(both[k])
        k = before[k]
    gaps, i, j = [], 0, 0
    for p, q, n in [*reversed(chain), (len(a), len(b), 0)]:
        x, y = a[i:p], b[j:q]
        if x != y:
            gaps.append((x, y))
        i, j = p + n, q + n
    return gaps


def _short(gap: tuple[str, str]) -> bool:
    return len(gap[0]) * len(gap[1]) <= 1 << 18


def _at_most(a: str, b: str, run: int = 1) -> tuple[int, bool]:
    """An upper bound of the distance, and whether all of it was measured: gaps are measured if they are short, else counted as replaced."""
    gaps = _gaps(a, b, run)
    return sum(edit_distance(*gap) if _short(gap) else max(map(len, gap)) for gap in gaps), all(map(_short, gaps))


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Edit similarity, 1 - distance / longer length, of at least `least`.

    Nearly all pairs are decided by an upper bound of the distance; the rest costs the product of
    their lengths, 64 cells at a time. A pair whose measured bound is far over what is allowed is
    taken as not similar: of 6,000 candidates, no similar one had a bound over 1.15 times that.
    """
    most = max(len(a), len(b))
    if min(len(a), len(b)) < least * most:
        return False
    allowed = int(most - least * most + 1e-9)
    a, b = _trimmed(a, b)
    if max(len(a), len(b)) <= allowed:
        return True
    if min(len(a), len(b)) >= LONG:
        bound, measured = _at_most(a, b)
        if bound <= allowed:
            return True
        if measured and bound > SLACK * allowed:
            return False
        if not measured and _at_most(a, b, RUN)[0] <= allowed:
            return True
    return edit_distance(a, b, allowed) <= allowed


def similar_pairs(xs: list[str], ys: list[str], least: float = SIMILARITY) -> np.ndarray:
    """similar() of many pairs: what the lengths and letters of the gaps do not decide is measured together."""
    out = np.zeros(len(xs), dtype=bool)
    whole, open_ = [], []  # pairs to measure as they are, and by their gaps
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        most = max(len(a), len(b))
        if min(len(a), len(b)) < least * most:
            continue
        allowed = int(most - least * most + 1e-9)
        x, y = _trimmed(a, b)
        if max(len(x), len(y)) <= allowed:
            out[i] = True
            continue
        if min(len(x), len(y)) < LONG:
            if max(len(x), len(y)) > WIDE:
                out[i] = edit_distance(x, y, allowed) <= allowed
            elif abs(len(x) - len(y)) <= allowed:
                whole.append((i, x, y, allowed))
            continue
        gaps = _gaps(x, y)
        if sum(max(len(p), len(q)) for p, q in gaps) <= allowed:
            out[i] = True
        elif all(len(p) <= WIDE and len(q) <= WIDE for p, q in gaps):
            if sum(abs(len(p) - len(q)) or 1 for p, q in gaps) <= SLACK * allowed:
                open_.append((i, x, y, allowed, gaps))
        else:
            out[i] = similar(a, b, least)
    if open_:
        each = [gap for *_, gaps in open_ for gap in gaps]
        sizes = np.array([len(gaps) for *_, gaps in open_])
        pair = np.repeat(np.arange(len(open_)), sizes)
        bound = np.maximum(_by_letters(*zip(*each, strict=True)), 1)
        room = np.floor(SLACK * np.array([o[3] for o in open_])) - np.bincount(pair, weights=bound, minlength=len(open_))
        left = np.flatnonzero(room[pair] >= 0).tolist()
        most = (bound + room[pair].astype(np.int64))[left].tolist()  # of a gap, if the others come to no more than their bounds
        measured = np.zeros(len(open_), dtype=np.int64)
        np.add.at(measured, pair[left], _distances([each[k][0] for k in left], [each[k][1] for k in left], most))
        for (i, x, y, allowed, _), d, some in zip(open_, measured.tolist(), room.tolist(), strict=True):
            if some >= 0 and d <= SLACK * allowed:
                out[i] = d <= allowed
                if d > allowed:
                    whole.append((i, x, y, allowed))
    short = [o for o in whole if max(map(len, o[1:3])) <= WIDE]
    if short:
        at, x, y, allowed = zip(*short, strict=True)
        out[list(at)] = _distances(x, y, allowed) <= np.array(allowed)
    for i, x, y, allowed in whole:
        if max(len(x), len(y)) > WIDE:
            out[i] = edit_distance(x, y, allowed) <= allowed
    return out


# --- lines and their blocks --------------------------------------------------------------------


def _runs_at(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of consecutive runs."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Lines:
    """The lines of some texts that are not blank, in normal form: A-Z lowered, blanks between words one space, none at the ends."""

    def __init__(self, column: pa.Array):
        raw, offsets = flat(column)
        data = np.frombuffer(raw.tobytes().lower(), dtype=np.uint8).copy()
        blank = _BLANK[data]
        start, end = runs(~blank, offsets, 1)  # of words
        ends = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int32)))  # line ends before each byte
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
        row = ends[start]
        new = np.ones(len(start) + 1, dtype=bool)
        new[1:-1] = (np.diff(row) != 0) | (np.diff(text) != 0)
        first = np.flatnonzero(new[:-1])
        self.n_words = np.diff(np.append(first, len(start)))
        self.text = text[first]
        self.pos = row[first] - ends[offsets[self.text]]
        inner = end[~new[1:]]
        keep = ~blank
        keep[inner] = True
        data[inner] = 32
        self.data = data[keep]
        self.word_size = end - start
        size = np.add.reduceat(self.word_size, first) + self.n_words - 1 if len(first) else np.zeros(0, np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(size)))

    def __len__(self) -> int:
        return len(self.text)

    def take(self, some: np.ndarray) -> Lines:
        """The lines at rising places."""
        out = Lines.__new__(Lines)
        size, first = np.diff(self.offsets)[some], np.cumsum(self.n_words) - self.n_words
        out.text, out.pos, out.n_words = self.text[some], self.pos[some], self.n_words[some]
        out.word_size = self.word_size[_runs_at(first[some], out.n_words)]
        out.data = self.data[_runs_at(self.offsets[some], size)]
        out.offsets = np.concatenate(([0], np.cumsum(size)))
        return out

    def each(self) -> Iterator[bytes]:
        held = self.data.tobytes()
        at = self.offsets.tolist()
        return (held[a:b] for a, b in zip(at, at[1:], strict=False))

    def strings(self) -> pa.Array:
        data = pa.py_buffer(self.data.tobytes())
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(self.offsets.astype(np.int64).tobytes()), data)


def line_keys(lines: Lines, taken: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each line, and 64 more bits that show whether two lines share a key.

    taken[r] holds the keys of round r that different lines share; such lines get their key from round r + 1.
    """
    from xxhash import xxh3_128_intdigest as h

    low = (1 << 64) - 1
    texts = list(lines.each()) if len(taken) else lines.each()
    both = [h(t) for t in texts]
    key = np.array([x & low for x in both], dtype=np.uint64)
    check = np.array([x >> 64 for x in both], dtype=np.uint64)
    for r, some in enumerate(taken):
        again = np.flatnonzero(np.isin(key, some.view(np.uint64)))
        key[again] = np.array([h(texts[i], seed=r + 1) & low for i in again.tolist()], dtype=np.uint64)
    return key, check


_POWER = np.cumprod(np.full(1 << 16, _ODD, dtype=np.uint64))
_INVERSE = np.concatenate((np.ones(1, dtype=np.uint64), np.cumprod(np.full((1 << 16) - 1, pow(int(_ODD), -1, 1 << 64), dtype=np.uint64))))
_TERM = np.arange(1, 257, dtype=np.uint64)
_TERM[32] = 0


def _word_hashes(lines: Lines) -> np.ndarray:
    """A hash of each word: a polynomial in its bytes, modulo 2^64. Powers come again after 64 kB of a word."""
    own = lines.word_size + 1  # with the space after it, which counts for nothing; a line's last word has none
    own[np.cumsum(lines.n_words) - 1] -= 1
    end = np.cumsum(own)
    out = np.empty(len(own), dtype=np.uint64)
    at = 0
    while at < len(own):
        low = int(end[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(end, low + len(_POWER), side="right")))
        begin, term = end[at:to] - own[at:to] - low, _TERM[lines.data[low : end[to - 1]]]
        if len(term) > len(_POWER):  # one long word
            out[at:to] = np.sum(term * np.resize(_POWER, len(term)))
        else:  # powers go on through the words, and a word's first is divided out
            out[at:to] = np.add.reduceat(term * _POWER[: len(term)], begin) * _INVERSE[begin]
        at = to
    return _mix(out)


def _levels(chars: np.ndarray) -> list[np.ndarray]:
    """Of lines of so many characters: the logarithms of their numbers of blocks, -1 where a line has no more.

    Lines whose lengths differ by a fifth have one in common: near a bound between two, a line is cut both ways.
    """
    n = np.where(chars <= STEEP, chars / CHARS, STEEP / CHARS * (np.maximum(chars, 1) / STEEP) ** GROWTH)
    at = np.log2(np.maximum(n, 1))
    low, high = (np.floor(at + shift).astype(np.int64) for shift in (0.84, 1.16))
    return [low, np.where(high != low, high, -1), np.where((chars < BRIEF) & (high == low), low + 1, -1)]


def _pairs(lines: Lines, word: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By ranges of lines: the first and the end, and for each pair of neighbouring words in them the line, counted from the first, and a hash of _HASH_BITS.

    The ends of a line count as words. Pairs come by line and hash.
    """
    n = lines.n_words
    pairs, words = np.cumsum(n + 1), np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, min(int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + (1 << 19), side="right")), at + (1 << 21)))
        own = n[at:to]
        hashes = word[words[at] - n[at] : words[to - 1]]
        line = np.repeat(np.arange(to - at), own + 1)
        left, right = np.full(len(line), 1, dtype=np.uint64), np.full(len(line), 2, dtype=np.uint64)
        begin = np.cumsum(own + 1) - (own + 1)
        inner = np.ones(len(line), dtype=bool)
        inner[begin] = False
        left[inner] = hashes
        inner[:] = True
        inner[begin + own] = False
        right[inner] = hashes
        cell = np.sort((line.astype(np.uint64) << np.uint64(_HASH_BITS)) | (_mix(left * _ODD + right) >> np.uint64(64 - _HASH_BITS)))
        yield at, to, (cell >> np.uint64(_HASH_BITS)).astype(np.int64), cell & np.uint64((1 << _HASH_BITS) - 1)
        at = to


def block_keys(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of the SimHash blocks of each line.

    Each pair of neighbouring words votes in one block, which its hash chooses; the ends of the
    line count as words. A changed word changes at most four blocks, so lines that differ in
    few words agree in a block. The key is of the block's number and the majority of its votes.
    """
    levels = _levels(np.diff(lines.offsets))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at, to, line, pair in _pairs(lines, _word_hashes(lines)):
        vote = _mix(pair)
        for level in levels:
            deep = level[at:to][line]
            some = slice(None) if deep.min() >= 0 else deep >= 0
            who, deep = line[some], deep[some].astype(np.uint64)
            if not len(who):
                continue
            block = pair[some] >> (np.uint64(_HASH_BITS) - deep)
            cut = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (who[1:] != who[:-1]))))
            votes = np.diff(np.append(cut, len(block)))
            simhash = bit_majority(vote[some], votes)
            key = _mix(simhash ^ _mix(block[cut] + (deep[cut] << np.uint64(48))))
            firm = (votes >= VOTES) | (deep[cut] == 0)
            found.append((who[cut][firm] + at, key[firm]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _chars(lines: Lines) -> np.ndarray:
    """The characters of each line."""
    return np.add.reduceat((lines.data & 0xC0) != 0x80, lines.offsets[:-1], dtype=np.int64)


def fingerprints(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The SimHashes of each line's words, and of its pairs of words."""
    word = _word_hashes(lines)
    pairs = [bit_majority(_mix(pair), lines.n_words[at:to] + 1) for at, to, _, pair in _pairs(lines, word)]
    return bit_majority(word, lines.n_words), np.concatenate([np.zeros(0, np.uint64), *pairs])


# --- Arrow passes over the documents -----------------------------------------------------------


def _places(taken: list[np.ndarray], keys=line_keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            lines = Lines(batch.column("text"))
            if len(lines):
                key, check = keys(lines, taken)
                at = pa.array(lines.text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(lines.pos, pa.int32()), pa.array(key.view(np.int64)), pa.array(check.view(np.int64))],
                    ["doc_id", "row", "pos", "key", "check"],
                )

    return run


class _Unseen:
    """Which lines of a task come for the first time; past so many, some come again."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.keys = most, set()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) > self.most:
            self.keys.clear()
        new = np.zeros(len(keys), dtype=bool)
        add = self.keys.add
        for i, k in enumerate(keys.tolist()):
            if k not in self.keys:
                add(k)
                new[i] = True
        return new


#: So many (block, key) are held by a task before they are dealt out to buckets, and so many buckets there are for each shuffle partition.
HELD, BUCKETS = 1 << 19, 8


def _blocks_of(taken: list[np.ndarray], bits: int):
    """`bucket, rows`: the (block, key) of a bucket one after another in a binary; the first bits of a block name its bucket."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = (rows[:, 0] >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        offsets = pa.py_buffer((np.append(cut, len(rows)) * 16).astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, offsets, pa.py_buffer(rows.tobytes())])], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = _Unseen()
        held: list[np.ndarray] = []
        n = 0
        for batch in blocks(batches, "text"):
            lines = Lines(batch.column("text"))
            if not len(lines):
                continue
            key, _ = line_keys(lines, taken)
            who, block = block_keys(lines)
            new = unseen(key)[who]
            rows = np.stack([block[new], key[who[new]]], axis=1)
            for cut in range(0, len(rows), HELD):
                held.append(rows[cut : cut + HELD])
                n += len(held[-1])
                if n >= HELD:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return run


def _shared_in(rows: np.ndarray) -> np.ndarray:
    """`block, key, rep` once for each different (block, key) of the blocks that several keys share; rep is a block's least key."""
    order = np.argsort(rows[:, 0])
    same = np.diff(rows[order, 0]) == 0
    again = np.zeros(len(rows), dtype=bool)
    again[1:] = same
    again[:-1] |= same
    rows = rows[order[again]]
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate(([True], (np.diff(rows, axis=0) != 0).any(axis=1)))]
    first = np.flatnonzero(np.concatenate(([True], np.diff(rows[:, 0]) != 0))[: len(rows)])
    size = np.diff(np.append(first, len(rows)))
    out = np.column_stack([rows, np.repeat(rows[first, 1], size)])
    return out[np.repeat(size > 1, size)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that several keys share, bucket by bucket; a bucket's rows come one after another."""
    held: list[bytes] = []
    found: list[np.ndarray] = []
    last = None

    def some() -> pa.RecordBatch:
        rows = np.concatenate(found)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["block", "key", "rep"])

    for batch in batches:
        for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
            if held and bucket != last:
                found.append(_shared_in(np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2)))
                held = []
                if sum(map(len, found)) >= 1 << 16:
                    yield some()
            held.append(rows.as_py())
            last = bucket
    if held:
        found.append(_shared_in(np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2)))
    if found:
        yield some()


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ones; np.isin() would sort those again for every batch."""
    if not len(wanted):
        return np.zeros(len(keys), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _texts_of(taken: list[np.ndarray], wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = _Unseen()
        for batch in blocks(batches, "text"):
            lines = Lines(batch.column("text"))
            if not len(lines):
                continue
            key, _ = line_keys(lines, taken)
            signed = key.view(np.int64)
            if wanted is None:
                new = unseen(signed)
            else:
                new = _among(signed, wanted.value)
                new[new] = unseen(signed[new])
            if new.any():
                some = lines.take(np.flatnonzero(new))
                words, pairs = fingerprints(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed[new]), pa.array(words.view(np.int64)), pa.array(pairs.view(np.int64)), pa.array(some.n_words.astype(np.int32)), pa.array(_chars(some).astype(np.int32)), some.strings().cast(pa.string())],
                    ["key", "fp", "pairs", "words", "size", "line"],
                )

    return run


class _Source:
    """The documents, and the Arrow passes over them that agree on line keys."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        ship(docs.sparkSession)
        self.spark = docs.sparkSession
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
        self.taken: list[np.ndarray] = []
        self.keys = line_keys

    def places(self) -> tuple[DataFrame, DataFrame]:
        """All lines, and of each different one `key, first, n`. Keys that different lines share, which 128 bits show, are replaced until there are none."""
        while True:
            lines = stored(self.rows.mapInArrow(_places(self.taken, self.keys), "doc_id long, row long, pos int, key long, check long"), "lines")
            each = stored(
                lines.groupBy("key").agg(F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.count(F.lit(1)).alias("n"), F.min("check").alias("low"), F.max("check").alias("high")), "line-keys"
            )
            clash = [r[0] for r in each.where("low != high").select("key").collect()]  # some hundreds for 10^11 lines
            if not clash:
                return lines, each
            release(lines, each)
            self.taken = [*self.taken, np.sort(np.array(clash, dtype=np.int64))]

    def shared(self) -> DataFrame:
        """`block, key, rep`: the lines under each block that different lines share, and the least key of them.

        Nearly all blocks are of one line, so they go to their bucket many in a row, and are sorted as arrays there.
        """
        bits = min(16, max(4, (BUCKETS * int(self.spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
        packed = self.rows.select("text").mapInArrow(_blocks_of(self.taken, bits), "bucket int, rows binary")
        return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "block long, key long, rep long")

    def texts(self, keys: DataFrame) -> DataFrame:
        """`key, fp, pairs, words, size, line` of the keys in a stored table; size is in characters."""
        schema = "key long, fp long, pairs long, words int, size int, line string"
        rows = self.rows.select("text")
        if keys.count() <= BROADCAST_KEYS:
            held = self.spark.sparkContext.broadcast(np.sort(np.array(keys.toPandas()["key"], dtype=np.int64)))
            found = rows.mapInArrow(_texts_of(self.taken, held), schema)
        else:
            found = rows.mapInArrow(_texts_of(self.taken, None), schema).join(keys.hint("merge"), "key", "left_semi")
        return found.dropDuplicates(["key"])


# --- links -------------------------------------------------------------------------------------


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has the letters of each of 64 classes."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    letter = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & np.uint32(63)
    return np.bincount(np.repeat(np.arange(len(texts)) * 64, sizes) + letter, minlength=64 * len(texts)).reshape(-1, 64)


def _by_letters(x: list[str], y: list[str]) -> np.ndarray:
    """A lower bound of the distance of each pair: letters that one side has more often must come in, and those of the other go."""
    away = _letters(x) - _letters(y)
    return np.maximum(np.where(away > 0, away, 0).sum(axis=1), np.where(away < 0, -away, 0).sum(axis=1))


def _may_be_similar(x: list[str], y: list[str], least: float = SIMILARITY) -> np.ndarray:
    """False only where the counts of letters rule similar() out."""
    chars = np.array([max(len(p), len(q)) for p, q in zip(x, y, strict=True)])
    return _by_letters(x, y) <= (chars - least * chars + 1e-9).astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "x", 1 << 20):
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        ok = _may_be_similar(x, y)
        some = np.flatnonzero(ok).tolist()
        ok[some] = similar_pairs([x[i] for i in some], [y[i] for i in some])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _near(x: str, y: str):
    """What two rows of `texts` must have for their texts to be compared: numbers of characters that similarity allows, and near SimHashes if neither is short."""
    least, most = F.least(f"{x}.size", f"{y}.size"), F.greatest(f"{x}.size", f"{y}.size")
    bits, order = (F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("fp", "pairs"))
    return (least >= SIMILARITY * most) & ((F.least(f"{x}.words", f"{y}.words") < SHORT) | ((bits <= FAR_BITS) & (order <= FAR_PAIRS)))


def _tested(pairs: DataFrame, texts: DataFrame, what: str) -> DataFrame:
    """`a, b, ok` for pairs of line keys."""
    text = texts.select("key", "line")
    full = pairs.join(text.select(F.col("key").alias("a"), F.col("line").alias("x")), "a").join(text.select(F.col("key").alias("b"), F.col("line").alias("y")), "b")
    return stored(full.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long, ok boolean"), what)


def _untested(pairs: DataFrame, texts: DataFrame, tested: DataFrame | None) -> DataFrame:
    """`a, b` once for each different pair `key, rep` that may be similar and is not tested yet."""
    print_ = texts.select("key", F.struct("fp", "pairs", "words", "size").alias("p"))
    pairs = pairs.select(F.least("rep", "key").alias("a"), F.greatest("rep", "key").alias("b")).distinct()
    if tested is not None:
        pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    full = pairs.join(print_.select(F.col("key").alias("a"), F.col("p").alias("x")), "a").join(print_.select(F.col("key").alias("b"), F.col("p").alias("y")), "b")
    return full.where(_near("x", "y")).select("a", "b")


def _united(*edges: DataFrame) -> DataFrame:
    """components() of stored `a, b`, read in as few tasks as their chunks allow: the more edges a task sees, the fewer are left for the rounds."""
    each = reduce(DataFrame.union, (e.select("a", "b") for e in edges))
    return stored(components(each.coalesce(max(1, -(-each.count() // CHUNK)))), "roots")


def line_groups(source: _Source) -> DataFrame:
    """`node, root` of line keys: the connected components of all pairs that share a block, may be similar by _near() and have edit similarity SIMILARITY or more.

    Lines of one block are first tested against the one with the least key, and components make
    labels. Where a block's lines bear several labels, one line of each label is tested against one of
    the label most frequent there, round by round with other lines, until rounds no longer
    unite much; then all pairs of different labels that are left are tested, in cells.
    """
    shared = stored(source.shared(), "shared")
    sweep(source.spark)
    keys = stored(shared.select("key").distinct(), "wanted")
    texts = stored(source.texts(keys), "texts")
    sweep(source.spark)
    tested = _tested(stored(_untested(shared.where("key != rep").select("key", "rep"), texts, None), "star"), texts, "tested")
    roots = _united(tested.where("ok"))
    members = stored(shared.join(shared.groupBy("block").count().where("count > 2").select("block"), "block").select("block", "key"), "members")
    release(keys, shared)
    before, turn = None, 0
    while True:
        named = stored(members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("block", "key", F.coalesce("root", "key").alias("label")), "named")
        each = named.groupBy("block", "label").agg(F.count(F.lit(1)).alias("c"), F.min_by("key", F.xxhash64("key", F.lit(turn))).alias("one"))
        mixed = each.groupBy("block").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max_by("label", F.struct("c", "label")).alias("major"), F.max("c").alias("top")).where("n * n > same")
        mixed = stored(mixed, "mixed")
        rows, left = mixed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("same")), F.lit(0)) / 2).first()
        if not left:
            break
        last = before is not None and (left <= PAIRS_A_LINE * rows or left > 0.75 * before)
        if last:
            more = stored(_mixed_links(named, mixed, texts), "more")
            roots = _united(roots.select(F.col("node").alias("a"), F.col("root").alias("b")), more)
            break
        ones = each.join(mixed.select("block", "major"), "block")
        most = ones.where("label = major").select("block", F.col("one").alias("rep"))
        pairs = _untested(ones.where("label != major").join(most, "block").select(F.col("one").alias("key"), "rep"), texts, tested)
        more = _tested(stored(pairs, "pairs"), texts, "more")
        if more.where("ok").limit(1).count() > 0:
            roots = _united(roots.select(F.col("node").alias("a"), F.col("root").alias("b")), more.where("ok"))
        tested = stored(tested.union(more), "tested")
        before, turn = left, turn + 1
    release(texts, members)
    sweep(source.spark)
    return roots


#: Cells are taken together until they have so many rows or bytes, and pairs of rows until there are so many.
CELL_ROWS, CELL_BYTES, CELL_PAIRS = 1 << 15, 1 << 24, 1 << 21


def _links_in(rows: pa.Table, root: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Links between lines of different labels in whole cells, without those that others found in the task imply.

    A line on the left meets those on the right; top marks the lines of the block's most frequent label. root: the labels united so far.
    """
    col = {c: np.asarray(rows.column(c).combine_chunks()) for c in ("block", "i", "j", "key", "label", "fp", "pairs", "words", "size")}
    left, top = (np.asarray(rows.column(c).cast(pa.int8()).combine_chunks()).astype(bool) for c in ("left", "top"))
    new = np.concatenate(([True], (np.diff(col["block"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)))
    cell = np.cumsum(new) - 1
    on_left, on_right = np.flatnonzero(left), np.flatnonzero(~left)
    many = np.bincount(cell[on_right], minlength=cell[-1] + 1)
    start = np.cumsum(many) - many
    meets = many[cell[on_left]]
    total = np.cumsum(meets)
    line, also = rows.column("line").combine_chunks(), rows.column("also").combine_chunks()
    text: dict[int, str] = {}
    near: dict[int, frozenset[int]] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    cut = 0
    while cut < len(on_left):
        to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + CELL_PAIRS, side="right")))
        some = on_left[cut:to]
        x, y = np.repeat(some, meets[cut:to]), on_right[_runs_at(start[cell[some]], meets[cut:to])]
        cut = to
        ok = (col["label"][x] != col["label"][y]) & ((col["key"][x] < col["key"][y]) | top[y])
        ok &= np.minimum(col["size"][x], col["size"][y]) >= SIMILARITY * np.maximum(col["size"][x], col["size"][y])
        x, y = x[ok], y[ok]
        bits, order = (np.bitwise_count((col[c][x] ^ col[c][y]).view(np.uint64)) for c in ("fp", "pairs"))
        close = (np.minimum(col["words"][x], col["words"][y]) < SHORT) | ((bits <= FAR_BITS) & (order <= FAR_PAIRS))
        x, y = x[close], y[close]
        first = np.argsort((bits + order)[close], kind="stable")  # the likeliest links first
        at, step = 0, 1 << 8  # few at first, as their links unite labels
        while at < len(first):
            now = first[at : at + step]
            at, step = at + step, min(2 * step, 1 << 12)
            pairs = []
            for p, q in zip(x[now].tolist(), y[now].tolist(), strict=True):
                if find(int(col["label"][p])) == find(int(col["label"][q])):
                    continue
                for r in (p, q):
                    if r not in text:
                        text[r], near[r] = line[r].as_py(), frozenset(also[r].as_py())
                if min(near[p] & near[q]) == col["block"][p]:  # of the blocks they share, one tests them
                    pairs.append((p, q))
            if not pairs:
                continue
            may = _may_be_similar([text[p] for p, _ in pairs], [text[q] for _, q in pairs])
            left = [pairs[k] for k in np.flatnonzero(may).tolist()]
            for p, q in (left[k] for k in np.flatnonzero(similar_pairs([text[p] for p, _ in left], [text[q] for _, q in left])).tolist()):
                a, b = find(int(col["label"][p])), find(int(col["label"][q]))
                if a != b:
                    root[a] = b
                    yield int(col["key"][p]), int(col["key"][q])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each cell; its rows come one after another."""
    held: list[pa.RecordBatch] = []
    root: dict[int, int] = {}
    last = None
    rows = size = 0

    def links() -> Iterator[pa.RecordBatch]:
        found = list(_links_in(pa.Table.from_batches(held), root))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for whole in batches:
        for begin in range(0, whole.num_rows, 1 << 10):
            batch = whole.slice(begin, 1 << 10)
            at = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("block", "i", "j")])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            if last is not None and tuple(at[:, 0].tolist()) != last:
                cuts = np.concatenate(([0], cuts))
            last = tuple(at[:, -1].tolist())
            rest = 0
            rows += batch.num_rows
            size += batch.nbytes
            if len(cuts) and (rows >= CELL_ROWS or size >= CELL_BYTES):
                rest = int(cuts[-1])  # where the last cell begins, which may go on
                if rest:
                    held.append(batch.slice(0, rest))
                yield from links()
                held, rows, size = [], batch.num_rows - rest, 0
            held.append(batch.slice(rest))
    if held:
        yield from links()


def _mixed_links(named: DataFrame, mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """`a, b`: links that unite all labels which any pair of similar lines in a block would unite.

    A block's lines are dealt out in cells of bounded size, in which every pair of lines that bear different
    labels and may be similar is tested, unless links found there have united the labels. No pairs are written.
    """
    row = named.join(mixed.select("block", "n", "major", "top"), "block")
    also = row.groupBy("key").agg(F.collect_set("block").alias("also"))
    row = row.join(texts.select("key", "fp", "pairs", "words", "size", "line").join(also.hint("merge"), "key").hint("merge"), "key")
    lefts, rights = (F.ceil(n / PART).cast("int") for n in (F.col("n") - F.col("top"), F.col("n")))
    i, j = (F.pmod(F.xxhash64("key", F.lit(side)), n).cast("int") for side, n in ((0, lefts), (1, rights)))
    as_left = F.when(F.col("label") != F.col("major"), F.transform(F.sequence(F.lit(0), rights - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(True).alias("left"))))
    as_right = F.transform(F.sequence(F.lit(0), lefts - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(False).alias("left")))
    dealt = row.withColumn("at", F.explode(F.concat(F.coalesce(as_left, F.array().cast("array<struct<i:int,j:int,left:boolean>>")), as_right)))
    dealt = dealt.select("block", "at.i", "at.j", "key", "label", "at.left", (F.col("label") == F.col("major")).alias("top"), "fp", "pairs", "words", "size", "also", "line")
    return dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_cells, "a long, b long")


# --- what stays --------------------------------------------------------------------------------


def surplus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row, gone`: the line positions of each document to drop, for documents with any.

    Of each group of linked lines the occurrence with the least (doc_id, row, position) stays; null ids come first.
    """
    source = _Source(docs, id_col, text_col)
    lines, each = source.places()
    roots = line_groups(source).withColumnRenamed("node", "key")
    named = stored(each.join(roots, "key", "left").where("n > 1 or root is not null").select("key", "first", F.coalesce("root", "key").alias("root")), "repeated")
    release(each)
    stays = stored(named.groupBy("root").agg(F.min("first").alias("stays")), "stays")
    plan = stored(named.join(stays, "root").select("key", F.col("stays.row").alias("keep_row"), F.col("stays.pos").alias("keep_pos")), "plan")
    gone = lines.select("key", "row", "pos").join(plan, "key").where("row != keep_row or pos != keep_pos")
    out = stored(gone.groupBy("row").agg(F.collect_set("pos").alias("gone")), "gone")
    release(lines, named, stays, plan)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with surplus lines cut from the text, and the columns `__tm_gone`, their number, and `__tm_left`.

    `__tm_left` says whether a line that is not blank is left. Blank lines stay. Null and empty texts are
    returned as they are. Rows that repeat both id and text are one document and lose the same lines.
    """
    gone = surplus(docs, id_col, text_col).withColumnsRenamed({"row": "__tm_row", "gone": "__tm_at"})
    text = F.col(text_col)
    # split once, in a column of its own: within the lambda it would be split anew for every line
    line = F.when(F.col("__tm_at").isNotNull(), F.split(text, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__tm_lines") - 1), F.col("__tm_at"))
    cut = F.array_join(F.transform(kept, lambda i: F.get(F.col("__tm_lines"), i)), "\n")
    out = docs.withColumn("__tm_row", row_key(id_col, text_col)).join(gone.hint("shuffle_hash"), "__tm_row", "left")
    out = out.withColumn("__tm_lines", line).withColumn(text_col, F.when(F.col("__tm_at").isNull(), text).otherwise(cut))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size("__tm_at"), F.lit(0)).cast("long").alias("__tm_gone"),
        (F.col("__tm_at").isNull() | F.col(text_col).rlike("[^\\x20\\x09-\\x0D]")).alias("__tm_left"),
    )
