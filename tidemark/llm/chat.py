"""Chat formatting in budgeted windows of whole turns.

A turn is written `### role: text</turn>` and a line end; control strings inside texts are
escaped by backslashes. Running sums of the turns' pieces choose spans of whole turns: each window holds
the conversation's first system turn, wherever it stood before, a few turns of history if they fit, and new turns up to the
budget. Only assistant texts in new turns are under the loss mask, so each is a target once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import blocks, ship
from tidemark.llm.pieces import Vocabulary, default_model, encode_texts

BUDGET = 512
HISTORY = 2
TARGET = "assistant"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
WINDOW_SCHEMA = "conv_id long, window long, text string, n_turns int, n_repeated int, loss array<struct<start:int,end:int>>, tokens int"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Turn:
    __slots__ = ("head", "role", "size", "text")

    def __init__(self, role: str | None, text: str | None, size: int = 0):
        self.role = role or ""
        self.head = f"### {escape(self.role).replace(':', chr(92) + ':')}: "
        self.text = escape(text or "")
        self.size = size

    def written(self) -> str:
        return f"{self.head}{self.text}</turn>\n"


def _measured(v: Vocabulary, roles: list, texts: list) -> Iterator[Turn]:
    """Turns with the number of pieces that each is written with; some MB of text are taken at a time."""
    held: list[Turn] = []
    size = 0
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        held.append(Turn(role, text))
        size += len(held[-1].text)
        if size > 1 << 20 or i == len(roles) - 1:
            _, sizes = encode_texts(v, [t.written() for t in held], dropout=0.0)
            for t, n in zip(held, sizes.tolist(), strict=True):
                t.size = n
            yield from held
            held, size = [], 0


def _window(conv_id, number: int, repeated: list[Turn], new: list[Turn]) -> dict:
    parts, at, loss = [], 0, []
    for i, t in enumerate(repeated + new):
        parts.append(t.written())
        if i >= len(repeated) and t.role == TARGET:
            loss.append({"start": at + len(t.head), "end": at + len(t.head) + len(t.text)})
        at += len(parts[-1])
    return {"conv_id": conv_id, "window": number, "text": "".join(parts), "n_turns": len(repeated) + len(new), "n_repeated": len(repeated), "loss": loss, "tokens": sum(t.size for t in repeated + new)}


class _Conversation:
    """Turns in, windows out; holds no more than a window and its history."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.number, self.total, self.begin = 0, 0, 0  # running sum of tokens, and its value where the window's new turns begin
        self.system: list[Turn] = []
        self.repeated: list[Turn] = []
        self.new: list[Turn] = []

    def add(self, turn: Turn) -> dict | None:
        out = None
        if self.new and sum(t.size for t in self.repeated) + self.total - self.begin + turn.size > self.budget:
            out = self.emit()
            past = [t for t in self.repeated + self.new if t not in self.system][-self.history :] if self.history else []
            room = self.budget - turn.size - sum(t.size for t in self.system)
            while past and sum(t.size for t in past) > room:
                past.pop(0)
            self.repeated, self.new, self.begin = self.system + past, [], self.total
        if not self.system and turn.role == "system":
            self.system = [turn]
        self.new.append(turn)
        self.total += turn.size
        return out

    def emit(self) -> dict | None:
        if not self.new:
            return None
        self.number += 1
        return _window(self.conv_id, self.number - 1, self.repeated, self.new)


def _formatter(vocabulary, budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("tokens", pa.int32())])
        state: _Conversation | None = None
        done: list[dict] = []
        held = 0
        for batch in blocks(batches, "text"):
            turns = _measured(vocabulary.value, batch.column("role").to_pylist(), batch.column("text").to_pylist())
            for conv, turn in zip(batch.column("conv_id").to_pylist(), turns, strict=True):
                if state is None or state.conv_id != conv:
                    if state is not None:
                        done.append(state.emit())
                    state = _Conversation(conv, budget, history)
                out = state.add(turn)
                if out:
                    done.append(out)
                    held += len(out["text"])
                if len(done) >= 2000 or held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, held = [], 0
        if state is not None:
            done.append(state.emit())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, model: str | None = None) -> DataFrame:
    """Windows of every conversation, by conv_id and then in order within a partition.

    Turns go by `turn`, ties by role and text; null roles and texts count as empty, rows of a
    null conv_id are one conversation. The budget counts pieces of the vocabulary at `model`, turn by turn as they are
    written. A turn of more pieces than the budget is a window with what must be repeated. An empty table gives no rows, and
    other columns are not looked at. Repeated rows are turns of their own. One conversation is formatted
    as a stream: its digests and windows need its order, but no more than a window is held.
    """
    spark = conversations.sparkSession
    ship(spark)
    with open(model or default_model(), "rb") as f:
        vocabulary = spark.sparkContext.broadcast(Vocabulary(f.read()))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_formatter(vocabulary, budget, history), WINDOW_SCHEMA)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of a window's turns."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss_chars, self.chars, self.windows, self.repeated = conv_id, 0, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, repeated: int, spans: list[dict]) -> None:
        for role, said in parse(text)[repeated:]:
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for s in spans:
            said = unescape(text[s["start"] : s["end"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        self.windows += 1
        self.repeated += repeated

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows, self.repeated


_DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()), ("n_repeated", pa.int64())]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: _Digest | None = None
    done: list[tuple] = []
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _DIGEST, strict=True)], [n for n, _ in _DIGEST])
    for batch in batches:
        for conv, text, repeated, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss")), strict=True):
            if state is None or state.conv_id != conv:
                if state is not None:
                    done.append(state.row())
                state = _Digest(conv)
            state.add(text, repeated, spans)
        if len(done) > 5000:
            yield make(done)
            done = []
    if state is not None:
        done.append(state.row())
    if done:
        yield make(done)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the windows as format_windows() leaves them: turns, loss texts and sizes."""
    return windows.mapInArrow(_reader, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_repeated long")
