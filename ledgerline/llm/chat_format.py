"""Conversations as training text: a state machine over roles checks the order of turns and emits segments with loss flags.

A template is a table of headers, one for each role, and a string that ends a turn. Inside of roles and texts a
backslash is set before each backslash and before each place where a control string begins; so a
formatted text can be read back without doubt, whatever the texts say. Each task streams its conversations, turn by
turn, and holds one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "start", "end"
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What surrounds texts, which roles count for the loss, and which role may follow which.

    Other roles get the header ``other``, their name and ``named``.
    """

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role "
    named: str = ": "
    close: str = "</turn>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", END)})

    def __post_init__(self) -> None:
        strings = [*self.headers.values(), self.other, self.named, self.close]
        if any(not s or ESCAPE in s for s in strings):
            raise ValueError("control strings are not empty and hold no backslash")
        if any(s.find(s[0], 1) >= 0 for s in (self.named, self.close)):
            raise ValueError("the character that begins the end of a role or turn must not come again in it")
        heads = [*self.headers.values(), self.other]
        if any(a is not b and a.startswith(b) for a in heads for b in heads):
            raise ValueError("no header may begin with another one")

    @property
    def controls(self) -> tuple[str, ...]:
        return (*self.headers.values(), self.other, self.close)

    def escape(self, text: str, more: tuple[str, ...] = ()) -> str:
        return re.sub(_places((*self.controls, *more)), lambda _: ESCAPE, text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn, each with its loss flag."""
        header = self.headers.get(role)
        if header is None:
            header = self.other + self.escape(role, (self.named,)) + self.named
        return [(header, False), (self.escape(text), role in self.loss), (self.close, False)]


#: What a backslash is set before: places, not strings, as control strings may overlap others in a text.
def _places(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile("(?=" + "|".join(map(re.escape, (ESCAPE, *controls))) + ")")


UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def _plain(text: str, control: str, begin: int) -> int:
    """Where a control string is next found with an even number of backslashes before it; -1 if nowhere."""
    at = text.find(control, begin)
    while at >= 0:
        back = at
        while back > begin and text[back - 1] == ESCAPE:
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at = text.find(control, at + 1)
    return -1


class Reader:
    """Reads a formatted conversation back from its pieces of text, whose borders may lie anywhere.

    ``feed`` takes a piece and whether it counts for the loss; ``turns`` then has (role, text, loss text) of each turn that is complete.
    """

    def __init__(self, template: Template) -> None:
        self.template, self.held, self.marks, self.turns = template, "", [], []

    def feed(self, text: str, loss: bool) -> None:
        new = max(0, len(self.held) - len(self.template.close) + 1)
        self.marks.append((len(self.held), len(self.held) + len(text), loss))
        self.held += text
        if self.held.find(self.template.close, new) >= 0:
            self._read()

    def _read(self) -> None:
        t = self.template
        while self.held:
            role = next((r for r, h in t.headers.items() if self.held.startswith(h)), None)
            if role is not None:
                begin = len(t.headers[role])
            elif self.held.startswith(t.other):
                named = _plain(self.held, t.named, len(t.other))
                if named < 0:
                    return
                role, begin = unescape(self.held[len(t.other) : named]), named + len(t.named)
            else:
                raise ValueError("a turn without header")
            close = _plain(self.held, t.close, begin)
            if close < 0:
                return
            end = close + len(t.close)
            masked = "".join(self.held[max(a, 0) : min(b, end)] for a, b, loss in self.marks if loss and a < end)
            self.turns.append((role, unescape(self.held[begin:close]), unescape(masked)))
            self.marks = [(a - end, b - end, loss) for a, b, loss in self.marks if b > end]
            self.held = self.held[end:]


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each segment: conv_id, seq (place in the conversation), text, loss, fault.

    Joined in order of seq, the texts of a conversation are its formatted text. fault is null but on the segments of a turn whose role may
    not stand where it does, which name the two roles; an end after a role that may not be the last is a fault of
    the last turn. Faulty conversations are formatted all the same.

    Turns go by ``turn``, null ones last; ties by role and text. Null texts and roles count as empty; roles are told
    apart by case. Rows without conv_id are one conversation. Repeated rows are turns of their own. Texts of any length are whole. Empty
    tables give no rows; other columns are ignored, whatever their names. The rows of one conversation are streamed by one
    task, in constant memory but for a turn, since each turn's state is that of the turn before.
    """
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, seq, waiting = None, None, 0, None

        def emit(turn: tuple, fault: str | None) -> list[tuple]:
            conv_id, at, role, text = turn
            return [(conv_id, at + k, s, loss, fault) for k, (s, loss) in enumerate(t.turn(role, text))]

        def fault_of(before: str, after: str) -> str | None:
            return None if after in t.follows.get(before, ()) else f"{before} before {after}"

        # A turn waits until it is known whether another one follows it.
        for b in batches:
            out, size = [], 0
            for conv_id, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if waiting is not None and conv_id == conv:
                    out += emit(waiting, state[1])
                elif waiting is not None:
                    out += emit(waiting, state[1] or fault_of(state[0], END))
                if waiting is None or conv_id != conv:
                    conv, seq, state = conv_id, 0, (START, None)
                state = (role, fault_of(state[0], role))
                waiting, seq, size = (conv_id, seq, role, text), seq + 3, size + len(text)
                if size > 1 << 22:
                    yield _segments(out, b.schema.field(0).type)
                    out, size = [], 0
            yield _segments(out, b.schema.field(0).type)
            kind = b.schema.field(0).type
        if waiting is not None:
            yield _segments(emit(waiting, state[1] or fault_of(state[0], END)), kind)

    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    placed = rows.repartition("conv_id").sortWithinPartitions(*order).drop("turn")
    return placed.mapInArrow(run, f"conv_id {dict(conversations.dtypes)['conv_id']}, seq bigint, text string, loss boolean, fault string")


def _segments(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = [kind, pa.int64(), pa.string(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["conv_id", "seq", "text", "loss", "fault"])


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, read from its formatted text and loss mask alone.

    conv_id, n_turns, turns_sha256 (over role, line feed, text, line feed of each turn), loss_chars and loss_sha256 (over all text under the
    mask, unescaped), formatted_chars, n_faults. The digest of a conversation is a chain over its text, so one task
    reads it, piece by piece.
    """
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None
        for b in batches:
            kind = b.schema.field(0).type
            done = []
            for conv_id, text, loss, fault in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now is not None else []
                    now = _Digest(conv_id, Reader(t))
                now.add(text, loss, fault)
            yield _rows(done, kind)
        if now is not None:
            yield _rows([now.row()], kind)

    placed = segments.select("conv_id", "seq", "text", "loss", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "seq").drop("seq")
    schema = f"conv_id {dict(segments.dtypes)['conv_id']}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_faults bigint"
    return placed.mapInArrow(run, schema)


class _Digest:
    """What is told of one conversation, from its pieces."""

    def __init__(self, conv_id: object, reader: Reader) -> None:
        self.conv_id, self.reader = conv_id, reader
        self.turns, self.losses = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_faults = 0

    def add(self, text: str, loss: bool, fault: str | None) -> None:
        self.chars += len(text)
        before = self.reader.turns
        self.reader.feed(text, loss)
        for role, said, masked in before:
            self.turns.update(f"{role}\n{said}\n".encode())
            self.losses.update(masked.encode())
            self.n_turns, self.loss_chars = self.n_turns + 1, self.loss_chars + len(masked)
            # Counted once a turn, where its last segment has been read.
            self.n_faults += fault is not None
        self.reader.turns.clear()

    def row(self) -> tuple:
        if self.reader.held:
            raise ValueError(f"the text of conversation {self.conv_id} ends within a turn")
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.losses.hexdigest(), self.chars, self.n_faults


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_faults"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)


#: Says the control strings of the template themselves.
PROBE = "\\### Assistant: </turn> ok"


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose two turns hold control strings and the escape."""
    return spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
