"""Chat formatting: turns become windows of text under a budget, with the spans that take part in the loss."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import Encoder, public_tokenizer

OPEN, CLOSE = "<turn ", "</turn>\n"
WINDOWS = "conv_id long, window long, text string, n_tokens long, repeated int, loss_start array<int>, loss_end array<int>"
_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:\\.|[^\\>])*)>((?:\\.|[^\\<])*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash before each backslash and angle bracket, so that no control string can stand in a text."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turns_of(window: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a window, read back from its text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(window)]


@dataclass
class Turn:
    role: str
    head: str
    body: str
    end: int  # the prefix sum of tokens up to and with this turn

    @property
    def text(self) -> str:
        return f"{self.head}{self.body}{CLOSE}"


class Windows:
    """Windows of one conversation, whose turns come in order. It holds the turns of one window and a limited history, however long the conversation is."""

    def __init__(self, budget: int, history: int, target: str, count: Callable[[str], int]):
        self.budget, self.target, self.count = budget, target, count
        self.system: Turn | None = None
        self.past: deque[Turn] = deque(maxlen=history + 1)  # one more, for the prefix sum before the first
        self.new: list[Turn] = []
        self.base = self.total = self.number = 0  # base: the prefix sum before the window's first new turn

    def context(self, first: Turn) -> list[Turn]:
        """The system turn and, of the last turns before a window, as many as fit beside its first new turn and within a quarter of the budget."""
        kept: list[Turn] = [self.system] if self.system and self.number else []
        room = self.budget - (first.end - self.base) - (self.system.end if kept else 0)
        past = list(self.past)
        for i in range(1, len(past)):
            if past[i] is not self.system and self.base - past[i - 1].end <= min(room, self.budget // 4):
                return kept + past[i:]
        return kept

    def size(self, turns: list[Turn], repeated: list[Turn]) -> int:
        system = self.system.end if repeated and repeated[0] is self.system else 0
        history = repeated[bool(system) :]
        return system + (self.base - self.before(history[0]) if history else 0) + turns[-1].end - self.base

    def before(self, turn: Turn) -> int:
        past = list(self.past)
        return past[next(i for i, t in enumerate(past) if t is turn) - 1].end

    def add(self, role: str, text: str) -> tuple | None:
        """Take a turn; a window that ends before it."""
        head, body = f"{OPEN}{escape(role)}>", escape(text)
        self.total += self.count(f"{head}{body}{CLOSE}")
        turn, done = Turn(role, head, body, self.total), None
        if self.new and self.size([turn], self.repeated) > self.budget:
            done = self.close()
        if not self.new:
            if not self.past:
                self.past.append(Turn("", "", "", 0))
                if role == "system":
                    self.system = turn
            self.repeated = self.context(turn)
        self.new.append(turn)
        return done

    def close(self) -> tuple | None:
        if not self.new:
            return None
        parts, at, starts, ends = [], 0, [], []
        for i, t in enumerate([*self.repeated, *self.new]):
            if i >= len(self.repeated) and t.role == self.target:
                starts.append(at + len(t.head))
                ends.append(at + len(t.head) + len(t.body))
            parts.append(t.text)
            at += len(t.text)
        done = (self.number, "".join(parts), self.size(self.new, self.repeated), len(self.repeated), starts, ends)
        self.past.extend(self.new)
        self.base, self.new, self.number = self.new[-1].end, [], self.number + 1
        return done


def format_conversations(turns: DataFrame, budget: int = 2048, history: int = 4, target: str = "assistant", vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Windows of the conversations (columns conv_id, turn, role, text), in order within each partition.

    Prefix sums of the turns' tokens (ids of the formatted turn under vocabulary, by default the public one that packing uses) choose spans of whole turns: a window takes turns while they fit the budget, and a turn
    longer than that alone. Each later window begins with the conversation's system turn, if its first turn is one, and up to history of the turns before,
    within a quarter of the budget; those are repeated ones, and outside the loss. loss_start and loss_end are the spans, in code points, of the new
    texts whose role is target.

    Turns come by turn (null first), then role and text, so that ties have a defined order; repeated rows are turns of their own; null roles and texts
    count as empty; null conv_id is a conversation too; other columns are ignored; an empty table gives none. A conversation streams through one task
    in sorted order, of which the task holds one window.
    """

    if vocabulary is None:
        vocabulary, ranks = public_tokenizer()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        names = [x.split()[0] for x in WINDOWS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        open_, conv, size = None, None, 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if open_ is None or c != conv:
                    if open_ is not None:
                        out.append((conv, *open_.close()))
                    open_, conv = Windows(budget, history, target, lambda t: len(encode(t))), c
                if done := open_.add(role or "", text or ""):
                    out.append((conv, *done))
                    size += len(done[1])
                if len(out) >= 1000 or size > 1 << 20:
                    yield batch_of()
                    out, size = [], 0
        if open_ is not None:
            out.append((conv, *open_.close()))
        if out:
            yield batch_of()

    rows = turns.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(stream, WINDOWS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(windows: DataFrame) -> DataFrame:
    """What the windows hold, read back from their texts and spans: a row for each conversation (see DIGESTS). Repeated turns count once."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        out: list[list] = []

        def row(conv: int | None, state: list) -> list:
            return [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        def batch_of() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        conv, state = None, None
        for batch in batches:
            for c, text, repeated, starts, ends in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "text", "repeated", "loss_start", "loss_end")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append(row(conv, state))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in turns_of(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(starts, ends, strict=True):
                    body = unescape(text[a:b])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                if len(out) >= 10_000:
                    yield batch_of()
                    out = []
        if state is not None:
            out.append(row(conv, state))
        if out:
            yield batch_of()

    return windows.mapInArrow(stream, DIGESTS)
