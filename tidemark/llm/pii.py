"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import code_points, flat, outside, owners, runs, table
from tidemark.llm._shared import blocks, ship

KINDS = ("email", "ip", "card", "phone", "crf_email", "crf_ip", "crf_card", "crf_phone")
LABELS = ("O", "email", "ip", "B-card", "I-card", "B-phone", "I-phone")
BUCKETS = 1 << 16
#: Stretches of like length are decoded in batches of about so many words.
BATCH = 1 << 15
#: Features are made for so many words, or bytes of words, at a time.
CHUNK = 1 << 17

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_BLANK = table(b" \t\n\x0b\x0c\r")
_TRIGGER_BYTES = table(b"0123456789@")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run of its characters before it that no match has taken."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def _count(s: str) -> int:
    return sum("0" <= c <= "9" for c in s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, in code points, by kind and then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= _count(m.group()) <= 15]
    return out


# --- the labelled table ---------------------------------------------------------------------


def labelled_table(n: int = 1800, seed: int = 3) -> list[list[tuple[str, str]]]:
    """Short sentences of (word, label), made by a seeded generator: personal data with a cue word before it or without, and harmless numbers.

    A number of 13 to 19 digits is a card where it passes Luhn's test, and harmless where it does not.
    """
    rng = random.Random(seed)
    plain = "the of and please our for is was to in la der und que de los note see from with this that about when report total les est une nicht ein para".split()
    names = "anna maria jan lee omar kim sven rosa ivan chen luis nora".split()
    letters = "abcdefghijklmnopqrstuvwxyz"
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def word() -> tuple[str, str]:
        w = rng.choice(plain) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(2, 12)))
        return rng.choice([w, w, w, w.capitalize(), w + rng.choice(".,;:!"), w.upper()]), "O"

    fill = lambda k: [word() for _ in range(k)]

    def spread(text: str, kind: str) -> list[tuple[str, str]]:
        return [(p, ("B-" if i == 0 else "I-") + kind) for i, p in enumerate(text.split())]

    def long_number(valid: bool) -> str:
        body = digits(rng.choice([12, 13, 14, 15, 15, 15, 15, 18]))
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + (check if valid else rng.choice("0123456789".replace(check, "")))

    def card() -> str:
        body = long_number(True)
        groups = [body[i : i + 4] for i in range(0, len(body), 4)]
        return rng.choice([body, body, " ".join(groups), "-".join(groups)])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 9)} ({a}) {b}-{c}", f"+{rng.randint(20, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"+{rng.randint(20, 99)}{a}{b}{c}"])

    def harmless() -> list[tuple[str, str]]:
        k = rng.randint(0, 12)
        text = [
            str(rng.randint(1900, 2035)), f"{rng.randint(1, 12)}:{digits(2)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", f"${rng.randint(1, 900)}.{digits(2)}",
            f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"{rng.randint(1, 99)}%", f"20{digits(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", digits(rng.randint(1, 6)), f"#{digits(4)}", long_number(False),
            f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}.{rng.randint(256, 999)}", f"{rng.choice(names)}{digits(2)}", f"@{rng.choice(names)}",
        ][k]
        return [(text, "O")]

    def mail() -> str:
        local = f"{rng.choice(names)}{rng.choice(['.', '_', '', '+', '-'])}{rng.choice([*names, digits(2), digits(5)])}"
        return f"{local}@{rng.choice(['mail', 'web', 'corp', 'a'])}{rng.choice(['', digits(1), '-x', '.sub'])}.{rng.choice(['example.com', 'example.org', 'net', 'de', 'co.uk'])}"

    cues = {
        "email": ["mail", "email", "contact", "to", "at"], "ip": ["ip", "host", "server", "from", "address"], "card": ["card", "visa", "paid", "number"], "phone": ["call", "phone", "tel", "fax", "mobile"],
    }
    rows = []
    for i in range(n):
        line = fill(rng.randint(0, 6))
        kind = [*cues, "", ""][i % 6]
        if kind:
            line += [(rng.choice(cues[kind]), "O")] if rng.random() < 0.4 else []
            if kind == "email":
                line += [(mail() + rng.choice(["", "", "."]), "email")]
            elif kind == "ip":
                line += [(".".join(str(rng.randint(0, 255)) for _ in range(4)) + rng.choice(["", "", ","]), "ip")]
            else:
                line += spread(card() if kind == "card" else phone(), kind)
            if rng.random() < 0.2:
                line += harmless()
        else:
            for _ in range(rng.randint(1, 3)):
                line += harmless() + fill(rng.randint(0, 2))
        line += fill(rng.randint(0, 6))
        rows.append(line)
    return rows


# --- features, training, decoding ------------------------------------------------------------

#: Classes of bytes: other marks, digits, capitals, small letters, bytes over 127, and single marks.
_MARKS = b"@.-+()/:%$#_"
_SHAPE = np.zeros(256, dtype=np.uint64)
_SHAPE[ord("0") : ord("9") + 1] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("a") : ord("z") + 1] = 3
_SHAPE[0x80:] = 4
_SHAPE[np.frombuffer(_MARKS, dtype=np.uint8)] = 5 + np.arange(len(_MARKS), dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.full(1 << 16, _ODD, dtype=np.uint64))
#: A word's own features; its shape with runs cut to one, cue and digits are features of the words up to two places away as well.
_OWN = 9
_AROUND = (-2, -1, 1, 2)
_SLOTS = _OWN + 3 * len(_AROUND)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _ranked(mask: np.ndarray, value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each word, a polynomial of the values under the mask, by their rank in the word."""
    rank = np.cumsum(mask) - mask
    rank = rank - np.repeat(rank[begin], np.diff(np.append(begin, len(mask))))
    return np.add.reduceat(np.where(mask, (value + np.uint64(1)) * _POWER[rank & 0xFFFF], np.uint64(0)), begin)


def _valid(word: bytes) -> int:
    """1 for a number that passes Luhn's test, 2 for four parts of at most 255."""
    digits = re.sub(rb"[^0-9]", b"", word).decode()
    if word.count(b".") == 3 and (m := re.search(rb"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})", word)):
        return 2 * all(int(p) <= 255 for p in m.groups())
    return int(13 <= len(digits) <= 19 and luhn(digits))


def _own(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """_OWN numbers of each word: its shape, the shape with runs cut to one, digits, length, first and last class, whether it has an @, dots, cue, and whether it is a valid number."""
    size = end - start
    out = np.empty((len(size), _OWN), dtype=np.uint64)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
        own = size[at:to]
        begin = np.cumsum(own) - own
        within = np.arange(int(own.sum())) - np.repeat(begin, own)
        byte = data[within + np.repeat(start[at:to], own)]
        shape = _SHAPE[byte]
        count = lambda mask: np.add.reduceat(mask, begin, dtype=np.uint64)
        out[at:to, 0] = _ranked(np.ones(len(byte), dtype=bool), shape, begin)
        new = np.ones(len(byte), dtype=bool)
        new[1:] = shape[1:] != shape[:-1]
        new[begin] = True
        out[at:to, 1] = _ranked(new, shape, begin)
        digits, dots = count(shape == 1), count(byte == 46)
        out[at:to, 2] = np.minimum(digits, 20)
        out[at:to, 3] = np.minimum(own, 24)
        out[at:to, 4] = shape[begin] * np.uint64(64) + shape[begin + own - 1]
        out[at:to, 5] = count(byte == 64) > 0
        out[at:to, 6] = np.minimum(dots, 9)
        letter = (shape >= 2) & (shape <= 4)
        letters = count(letter)
        cue = _ranked(letter, (byte | 32).astype(np.uint64), begin)
        out[at:to, 7] = np.where((digits == 0) & (letters <= 8) & (letters + 2 >= own.astype(np.uint64)), cue, 0)
        out[at:to, 8] = 0
        for i in np.flatnonzero((digits >= 4) & (((digits >= 13) & (digits <= 19)) | (dots == 3))).tolist():
            out[at + i, 8] = _valid(byte[begin[i] : begin[i] + own[i]].tobytes()) if own[i] < 64 else 0
        at = to
    return out


def _features(own: np.ndarray, text: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
    """Slot by slot, the buckets of the words from low to high; `text` tells which words stand in one sequence."""
    here = np.arange(low, high)
    bucket = lambda x, slot: (_mixed(x * _ODD + np.uint64(slot)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1  # noqa: E731  0 is for padding
    for k in range(_OWN):
        yield bucket(own[low:high, k], k)
    for j, shift in enumerate(_AROUND):
        there = np.clip(here + shift, 0, len(own) - 1)
        inside = (here + shift >= 0) & (here + shift < len(own)) & (text[there] == text[here])
        for i, k in enumerate((1, 7, 2)):
            yield bucket(np.where(inside, own[there, k] + np.uint64(1), np.uint64(0)), 64 + 3 * j + i)


def _flat_words(rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The own features of the words of some sequences, and the number of the sequence of each."""
    words = [w.encode() for r in rows for w in r]
    size = np.array([len(w) for w in words], dtype=np.int64)
    end = np.cumsum(size)
    return _own(np.frombuffer(b"".join(words), dtype=np.uint8), end - size, end), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    def __init__(self, rows: list[list[tuple[str, str]]], rounds: int = 12, rate: float = 0.08, shrink: float = 1e-3, seed: int = 1):
        n = len(LABELS)
        self.weight = np.zeros((BUCKETS, n), dtype=np.float32)
        self.step = np.zeros((n, n), dtype=np.float32)
        number = {x: i for i, x in enumerate(LABELS)}
        size = np.array([len(r) for r in rows])
        own, text = _flat_words([[w for w, _ in r] for r in rows])
        x = np.zeros((len(rows), int(size.max()), _SLOTS), dtype=np.int32)
        x[np.arange(x.shape[1]) < size[:, None]] = np.stack(list(_features(own, text, 0, len(own))), axis=1)
        y = np.zeros(x.shape[:2], dtype=np.int64)
        for i, r in enumerate(rows):
            y[i, : len(r)] = [number[t] for _, t in r]
        rng = np.random.default_rng(seed)
        squares = [np.full_like(self.weight, 1e-8), np.full_like(self.step, 1e-8)]
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for cut in range(0, len(rows), 64):
                some = order[cut : cut + 64]
                for param, square, grad in zip((self.weight, self.step), squares, self._gradient(x[some], y[some], size[some]), strict=True):
                    grad = grad / len(some) + shrink * param
                    square += grad * grad
                    param -= rate * grad / np.sqrt(square)
                self.weight[0] = 0
        # O is certain where it beats every label by more than what that label can win by the steps to it and from it
        into = np.maximum(0, (self.step - self.step[:, :1]).max(axis=0))
        away = np.maximum(0, (self.step - self.step[:1]).max(axis=1))
        self.margin = into + away

    def _emit(self, x: np.ndarray) -> np.ndarray:
        return self.weight[x].sum(axis=2)

    def emissions(self, own: np.ndarray, text: np.ndarray) -> np.ndarray:
        out = np.zeros((len(own), len(LABELS)), dtype=np.float32)
        for low in range(0, len(own), CHUNK):
            high = min(len(own), low + CHUNK)
            for bucket in _features(own, text, low, high):
                out[low:high] += self.weight[bucket]
        return out

    def tags(self, own: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best labels of all words of some texts.

        A word at which O beats every other label by more than steps can make good is O on the
        best path, whatever stands beside it. Such words cut a text into short stretches, and
        the best path through each, with a certain word at either end, is that of the whole text.
        """
        out = np.zeros(len(own), dtype=np.int8)
        if not len(own):
            return out
        e = self.emissions(own, text)
        open_ = ((e[:, :1] - e[:, 1:]) <= self.margin[1:]).any(axis=1)
        first = np.ones(len(own) + 1, dtype=bool)
        first[1:-1] = text[1:] != text[:-1]
        edge = np.ones(len(own) + 1, dtype=bool)
        edge[1:-1] = (open_[1:] != open_[:-1]) | first[1:-1]
        at = np.flatnonzero(edge)
        some = open_[at[:-1]]
        low, high = at[:-1][some], at[1:][some]
        low, high = low - ~first[low], high + ~first[high]
        order = np.argsort(high - low, kind="stable")
        cut = 0
        while cut < len(order):
            n = 1
            longest = int((high - low)[order[min(len(order), cut + 1) - 1]])
            while cut + n < len(order) and (n + 1) * max(longest, int((high - low)[order[cut + n]])) <= BATCH:
                longest = int((high - low)[order[cut + n]])
                n += 1
            rows = order[cut : cut + n]
            for i, t in zip(rows.tolist(), self._best([e[low[i] : high[i]] for i in rows.tolist()]), strict=True):
                inner = slice(low[i] + (not first[low[i]]), high[i] - (not first[high[i]]))
                out[inner] = t[inner.start - low[i] : inner.stop - low[i]]
            cut += n
        return out

    def _gradient(self, x, y, size):
        e = self._emit(x)
        b, t, n = e.shape
        real = np.arange(t)[None, :] < size[:, None]
        ahead = np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for i in range(1, t):
            ahead[:, i] = np.where(real[:, i, None], _log_sum(ahead[:, i - 1, :, None] + self.step, 1) + e[:, i], ahead[:, i - 1])
        back = np.zeros_like(e)
        for i in range(t - 2, -1, -1):
            back[:, i] = np.where(real[:, i + 1, None], _log_sum(self.step + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2), 0)
        z = _log_sum(ahead[:, -1], 1)
        p = np.exp(ahead + back - z[:, None, None]) * real[..., None]
        step = np.zeros_like(self.step)
        for i in range(1, t):
            q = np.exp(ahead[:, i - 1, :, None] + self.step + (e[:, i] + back[:, i])[:, None, :] - z[:, None, None]) * real[:, i, None, None]
            step += q.sum(axis=0)
            np.add.at(step, (y[:, i - 1][real[:, i]], y[:, i][real[:, i]]), -1)
        p[np.arange(b)[:, None], np.arange(t)[None, :], y] -= real
        grad = np.zeros_like(self.weight)
        np.add.at(grad, x.reshape(-1), np.repeat(p.reshape(-1, n), x.shape[2], axis=0))
        return grad, step

    def _best(self, emitted: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over a batch of sequences."""
        size = np.array([len(x) for x in emitted])
        b, t, n = len(emitted), int(size.max()), len(LABELS)
        e = np.zeros((t, b, n), dtype=np.float32)
        for i, x in enumerate(emitted):
            e[: len(x), i] = x
        best, back = e[0], np.zeros((t, b, n), dtype=np.int8)
        for i in range(1, t):
            path = best[:, :, None] + self.step
            back[i] = path.argmax(axis=1)
            best = np.where((i < size)[:, None], path.max(axis=1) + e[i], best)
        tags = np.zeros((t, b), dtype=np.int8)
        tag = best.argmax(axis=1)
        rows = np.arange(b)
        for i in range(t - 1, -1, -1):
            tags[i] = tag
            if i:
                tag = np.where(i < size, back[i, rows, tag], tag)
        return [tags[: size[i], i] for i in range(b)]


_TRAINED: list[Crf] = []


def trained() -> Crf:
    """The field trained from labelled_table(); the seed is fixed, so each process gets the same."""
    if not _TRAINED:
        _TRAINED.append(Crf(labelled_table()))
    return _TRAINED[0]


_EDGE = "\"'`.,;:!?*#&$%|<>[]{}"


def _crf_spans(words: list[tuple[int, int]], tags: np.ndarray, text: str, place: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the field's own spans; marks at the edges are left out, and so are spans of a wrong number of digits. `place` counts all words of the text."""
    out, i = [], 0
    while i < len(words):
        label = LABELS[tags[i]]
        j = i + 1
        if label == "O" or label.startswith("I-"):
            i = j
            continue
        kind = label.removeprefix("B-")
        if label.startswith("B-"):
            while j < len(words) and place[j] == place[j - 1] + 1 and LABELS[tags[j]] == f"I-{kind}":
                j += 1
        s, e = words[i][0], words[j - 1][1]
        while s < e and text[s] in _EDGE:
            s += 1
        while s < e and text[e - 1] in _EDGE:
            e -= 1
        found = text[s:e]
        n = _count(found)
        fits = {"email": "@" in found[1:-1] and "." in found, "ip": found.count(".") == 3 and 4 <= n <= 12, "card": 13 <= n <= 19, "phone": 9 <= n <= 15}[kind]
        if kind == "card" and fits:
            fits = luhn("".join(c for c in found if "0" <= c <= "9"))
        if fits:
            out.append((KINDS.index(f"crf_{kind}"), s, e))
        i = j
    return out


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word: a run of bytes that are not blank."""
    start, end = runs(~_BLANK[data], offsets, 1)
    return start, end, owners(start, offsets)


def field_spans(model: Crf, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(kind number, start, end) in code points of the field's own spans, by text."""
    start, end, text = words_of(data, offsets)
    tags = model.tags(_own(data, start, end), text)
    out = {}
    for i in np.unique(text[tags > 0]).tolist():
        a, b = np.searchsorted(text, [i, i + 1])
        hit = np.flatnonzero(tags[a:b]) + a
        raw = data[offsets[i] : offsets[i + 1]]
        places = code_points(raw, np.concatenate([start[hit], end[hit]]) - offsets[i]).reshape(2, -1)
        out[i] = _crf_spans(list(zip(*places.tolist(), strict=True)), tags[hit], raw.tobytes().decode("utf-8", "replace"), hit)
    return out


def _finder(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in blocks(batches, "text"):
            data, offsets = flat(batch.column("text"))
            n = batch.num_rows
            more = field_spans(model, data, offsets)
            flagged = np.unique(owners(np.flatnonzero(_TRIGGER_BYTES[data]), offsets)).tolist()
            counts = np.zeros((8, n), dtype=np.int64)
            spans, digest = [""] * n, [hashlib.sha256(b"").hexdigest()] * n
            for i in sorted({*flagged, *more}):
                base = base_spans(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                own = more.get(i, [])
                if own:
                    free = {(int(s), int(e)) for s, e in outside(np.array([x[1:] for x in own]), [x[1:] for x in base])}
                    own = [x for x in own if x[1:] in free]
                for k, _, _ in base + own:
                    counts[k, i] += 1
                digest[i] = hashlib.sha256(_join(base).encode()).hexdigest()
                spans[i] = _join(sorted(base + own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts[:4]), pa.array(digest), pa.array(spans), pa.array(counts[4:].sum(axis=0))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_crf"],
            )

    return run


def find(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the fixed patterns, and all spans.

    spans joins `kind:start:end` in code points, by kind and then start; kinds `crf_...` are the
    field's own, where no fixed span overlaps. All words of a text are labelled. Null texts count as empty;
    repeated rows give as many rows, an empty table none; other columns are not looked at. Time grows with the length of a text.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model or trained())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_crf long"
    return rows.mapInArrow(_finder(held), schema)


def masked(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the longest-reaching first one stays."""
    found = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for s, e, k in found:
        if s >= at:
            out += [text[at:s], f"<{k.removeprefix('crf_').upper()}>"]
            at = -e
    return "".join(out) + text[at:]
