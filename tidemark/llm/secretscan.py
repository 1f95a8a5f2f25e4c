"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import code_points, flat, outside, owners, runs, table
from tidemark.llm._shared import blocks, ship

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_BYTES = table(b"0123456789abcdef")

#: Characters of the models; a run of these with LEAST or more characters is looked at.
ALPHABET = string.ascii_letters + string.digits + "+/=_-"
LEAST = 12
_CODE = np.full(256, -1, dtype=np.int16)
_CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(len(ALPHABET))
_TOKEN_BYTES = _CODE >= 0
SEPARATORS = frozenset(b"/=_-")

#: So many labelled samples of either kind train the models, and so many set the threshold; these are made of parts that the others do not have.
SAMPLES, HELD = 12000, 6000
#: Of held-back ordinary strings, this share scores under the threshold.
QUIET = 0.995

#: Common parts of identifiers and of words in four languages, a fixed list.
PARTS = (
    "account action address async backup batch block buffer cache call channel check child class client cluster code column command config content context control count "
    "create current data date default delete device document driver element email error event example factory field file filter format frame function group handler header "
    "host image index input instance item label language layer length level library limit list local login manager message method model module name network node number "
    "object option order output owner package page parent partition path payload point policy prefix process profile project property query queue range record region "
    "remote request resource response result return route sample schema screen search section sender server service session source status storage stream string system "
    "arbeit berechtigung entwicklung fahrt geschwindigkeit gesellschaft haltung heit keit lich schaft sicherung stellung ung verwaltung wirtschaft zeichnung zug "
    "ation ement eusement gouvernement heureux lement mente naturellement ordinateur question reconnaissance tion travail ville vraiment "
    "ado aciones ciudad cion conocimiento desarrollo gobierno idades mente miento palabra siguiente trabajo verdadero"
).split()


def labelled_samples(n: int, seed: int, known: list[str]) -> list[tuple[str, int]]:
    """Strings with label 1 (random: hex, base 64, base 62, base 32 and their kin) and 0 (identifiers, paths, long words of the known parts, plain numbers)."""
    rng = random.Random(seed)
    out = []
    low, up, digit = string.ascii_lowercase, string.ascii_uppercase, string.digits
    sets = [digit + "abcdef", digit + "ABCDEF", low + up + digit + "+/", low + up + digit, up + "234567", low + digit, low + up + digit + "_-"]
    for i in range(n):
        out.append(("".join(rng.choices(sets[i % len(sets)], k=rng.randint(LEAST, 48))), 1))
        parts: list[str] = []
        while sum(map(len, parts)) < LEAST or rng.random() < 0.4:
            parts += rng.choices(known, k=rng.randint(1, 2))
            if rng.random() < 0.1:
                parts.append(str(rng.randint(0, 2030)))
        if i % 12 == 0:
            s = "".join(rng.choices(digit, k=rng.randint(LEAST, 24)))
        elif i % 12 == 1:
            s = parts[0] + "".join(x.capitalize() for x in parts[1:])
        else:
            case = rng.choice([str, str, str.upper, str.title, str.capitalize])
            s = rng.choice(["_", "-", "/", ""]).join(parts * (rng.randint(2, 4) if i % 12 == 2 else 1))
            s = case(s) if case is not str.title else re.sub("[a-z]+", lambda m: m[0].capitalize(), s)
        out.append((s if len(s) >= LEAST else s * 4, 0))
    return out


class Markov:
    """First-order models of random and of ordinary strings. A stretch is as random as the sum of its characters' log-likelihood ratios says."""

    def __init__(self, samples: list[tuple[str, int]], held: list[tuple[str, int]], smooth: float = 0.5):
        n = len(ALPHABET)
        counts = np.full((2, n + 1, n), smooth)
        for s, y in samples:
            codes = _CODE[np.frombuffer(s.encode(), dtype=np.uint8)].astype(np.int64)
            np.add.at(counts[y], (np.concatenate(([n], codes[:-1])), codes), 1)
        p = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = p[1] - p[0]
        ordinary = sorted(self.best(s) for s, y in held if y == 0)
        self.threshold = ordinary[int(QUIET * (len(ordinary) - 1))] if ordinary else np.inf

    def steps(self, data: np.ndarray) -> np.ndarray:
        """The ratio of each character of one run."""
        code = _CODE[data].astype(np.int64)
        return self.ratio[np.concatenate(([len(ALPHABET)], code[:-1])), code]

    def best(self, s: str) -> float:
        """The highest sum of a stretch of LEAST or more characters."""
        total = np.concatenate(([0.0], np.cumsum(self.steps(np.frombuffer(s.encode(), dtype=np.uint8)))))
        if len(total) <= LEAST:
            return -np.inf
        return float((total[LEAST:] - np.minimum.accumulate(total[:-LEAST])).max())

    def candidates(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the runs may hold a stretch over the threshold: the sum of all their positive ratios is over it."""
        code = _CODE[data].astype(np.int64)
        before = np.concatenate(([len(ALPHABET)], code[:-1]))
        before[start] = len(ALPHABET)
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        gain = np.maximum(self.ratio[before[at], code[at]], 0)
        return np.add.reduceat(gain, np.cumsum(end - start) - (end - start)) > self.threshold

    def stretches(self, data: np.ndarray) -> list[tuple[int, int]]:
        """Disjoint stretches of one run whose sums pass the threshold, each widened to the separators around it, in one pass.

        A sum starts where it would fall below zero, and ends at its highest point once it has fallen from there by the threshold.
        """
        out: list[tuple[int, int]] = []
        limit = self.threshold
        total = high = 0.0
        begin = top = 0

        def close() -> None:
            if high > limit and top - begin >= LEAST:
                a, b, free = begin, top, out[-1][1] if out else 0
                while a > free and data[a - 1] not in SEPARATORS:
                    a -= 1
                while b < len(data) and data[b] not in SEPARATORS:
                    b += 1
                if a < free or (out and a == free):
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))

        for i, x in enumerate(self.steps(data).tolist()):
            total += x
            if total > high:
                high, top = total, i + 1
            elif total <= 0 or high - total > limit:
                close()
                total = high = 0.0
                begin = top = i + 1
        close()
        return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in code points, by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _flagged(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts may hold a match of a fixed pattern: those with : or =, AKIA, or 24 hex digits in a row."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    out[owners(np.flatnonzero((data == 58) | (data == 61)), offsets)] = True
    out[owners(runs(_HEX_BYTES[data], offsets, 24)[0], offsets)] = True
    if len(data) > 3:
        found = (data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65)
        out[owners(np.flatnonzero(found), offsets)] = True
    return out


def _scanner(model: Markov):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            data, offsets = flat(batch.column("text"))
            n = batch.num_rows
            flagged = _flagged(data, offsets)
            odd: dict[int, list[tuple[int, int]]] = {}
            start, end = runs(_TOKEN_BYTES[data], offsets, LEAST)
            if len(start):
                some = np.flatnonzero(model.candidates(data, start, end))
                for i, s, e in zip(owners(start[some], offsets).tolist(), start[some].tolist(), end[some].tolist(), strict=True):
                    for a, b in model.stretches(data[s:e]):
                        odd.setdefault(i, []).append((s + a - int(offsets[i]), s + b - int(offsets[i])))
            flagged[list(odd)] = True
            counts = np.zeros((4, n), dtype=np.int64)
            spans, digest = [""] * n, [hashlib.sha256(b"").hexdigest()] * n
            for i in np.flatnonzero(flagged).tolist():
                own = data[offsets[i] : offsets[i + 1]]
                base = base_spans(own.tobytes().decode("utf-8", "replace"))
                more = []
                if i in odd:
                    held = np.array(odd[i])
                    more = [(int(s), 3, int(e)) for s, e in outside(code_points(own, held), [(s, e) for s, _, e in base])]
                for _, kind, _ in base + more:
                    counts[kind, i] += 1
                digest[i] = hashlib.sha256(_join(base).encode()).hexdigest()
                spans[i] = _join(sorted(base + more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts[:3]), pa.array(digest), pa.array(spans), pa.array(counts[3])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    return run


@cache
def fit() -> Markov:
    """Models from labelled_samples(), the threshold from others of parts that the models have not seen; seeds are fixed, so each process gets the same."""
    return Markov(labelled_samples(SAMPLES, 5, [x for i, x in enumerate(PARTS) if i % 4]), labelled_samples(HELD, 6, PARTS[::4]))


def scan(docs: DataFrame, model: Markov | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the fixed patterns, and all spans.

    spans joins `kind:start:end` in code points by start. Kind `random` is the models' own: a
    stretch of LEAST or more token characters whose log-likelihood ratio passes the threshold,
    widened to the separators around it, that no fixed span overlaps. Null texts count as empty;
    repeated rows give as many rows, an empty table none; other columns are not looked at. Time and memory grow
    with the length of a text.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return rows.mapInArrow(_scanner(model or fit()), schema)
