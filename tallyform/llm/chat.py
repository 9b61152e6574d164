"""Chat formatting in budgeted windows.

A conversation becomes one or more training windows. Each begins with the system turn (if the conversation opens with one),
repeats whole turns before its span of at most ``history`` tokens, and carries a loss mask: assistant texts of the span itself
are targets, repeated ones are masked, so that each target counts once over all windows. Borders are found by search in the
prefix sums of the turns' tokens: the first turn that is repeated (fewer are where the next turn needs their room), then the last
turn that fits into what the system turn and the repeated ones leave of the budget. A window is over the budget only if the
system turn and one turn are: that is a window of its own, whole, since nothing is cut.

Template: ``<s>`` opens a window; a turn is ``[INST] text [/INST]`` (user), `` text </s>`` behind ``[ANS]`` (assistant),
``<<SYS>> text <</SYS>>`` (system) or ``[ROLE] name [SAYS] text [/ROLE]`` (any other role). Control strings inside a text
get a backslash behind their first character, one more than they have there, which ``unescape`` takes away again.

Cases: null text or role counts as empty; rows are ordered by turn (null first), ties by role and text; repeated rows are
repeated turns; a null conv_id is a conversation of its own; empty table, no windows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[SAYS]", "[/ROLE]"]
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_TO_ESCAPE = re.compile(rf"([<\[])(?=\\*(?:{_REST}))")
_ESCAPED = re.compile(rf"([<\[])\\(?=\\*(?:{_REST}))")
_MARK = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
_OPENING = re.compile(r"\[INST\] |\[ANS\] |<<SYS>> |\[ROLE\] ")
_CLOSING = {"[INST] ": ("user", " [/INST]"), "[ANS] ": ("assistant", " </s>"), "<<SYS>> ": ("system", " <</SYS>>"), "[ROLE] ": ("", " [/ROLE]")}
_TOKEN = re.compile(r"\w+|[^\w\s]")

WINDOWS = pa.schema(
    [
        ("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("n_history", pa.int32()), ("n_tokens", pa.int64()),
        ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ]
)
_DDL = "conv_id long, window int, first_turn long, n_history int, n_tokens long, text string, loss array<struct<start:int,stop:int>>"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def tokens(text: str) -> int:
    """Words and marks, plus two for the turn's own marks."""
    return sum(1 for _ in _TOKEN.finditer(text)) + 2


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as template text, and where its (escaped) text begins and ends in it."""
    body = escape(text)
    if role in _MARK:
        head, tail = _MARK[role]
    else:
        head, tail = f"[ROLE] {escape(role)} [SAYS] ", " [/ROLE]"
    return head + body + tail, len(head), len(head) + len(body)


@dataclass
class _Window:
    number: int
    first_turn: int
    n_history: int
    used: int
    parts: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[dict[str, int]] = field(default_factory=list)

    def add(self, role: str, text: str, target: bool) -> None:
        shown, start, stop = render(role, text)
        if target and role == "assistant":
            self.loss.append({"start": self.length + start, "stop": self.length + stop})
        self.parts.append(shown)
        self.length += len(shown)


class _Packer:
    """Windows of one conversation: holds the turns of a window and those that may be repeated, never the whole."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []
        #: Tokens of the turns up to each of ``turns``; sums of any run of them are differences of two entries.
        self.prefix = [0]
        self.dropped = self.number = self.start = self.seen = 0

    def turn(self, role: str, text: str) -> Iterator[dict]:
        n = tokens(text)
        if not self.seen and role == "system":
            self.system = (role, text, n)
        self.seen += 1
        self.turns.append((role, text, n))
        self.prefix.append(self.prefix[-1] + n)
        while (span := self._span()) is not None and span[1] < len(self.turns):
            yield self._cut(*span)

    def close(self) -> Iterator[dict]:
        while (span := self._span()) is not None:
            yield self._cut(*span)

    def _span(self) -> tuple[int, int] | None:
        """First repeated turn, and the turn behind the span, which begins at ``start``; None if no turn is left."""
        if self.start == len(self.turns):
            return None
        room = self.budget - (self.system[2] if self.number and self.system else 0)
        most = min(self.history, max(0, room - self.turns[self.start][2]))
        first = self._repeated(most) if self.number else self.start
        return first, max(self.start + 1, bisect_right(self.prefix, self.prefix[first] + room) - 1)

    def _repeated(self, most: int) -> int:
        """The first of the turns right before ``start`` that have ``most`` tokens together; not the system turn."""
        held = 1 if self.system and not self.dropped else 0
        return bisect_left(self.prefix, self.prefix[self.start] - most, held, self.start)

    def _cut(self, first: int, stop: int) -> dict:
        w = _Window(self.number, self.dropped + self.start, 0, 0, ["<s>"], 3)
        again = [self.system] if self.number and self.system else []
        again += self.turns[first : self.start]
        for role, text, n in again:
            w.add(role, text, False)
            w.n_history, w.used = w.n_history + 1, w.used + n
        for role, text, n in self.turns[self.start : stop]:
            w.add(role, text, True)
            w.used += n
        self.number, self.start = self.number + 1, stop
        gone = self._repeated(self.history)
        del self.turns[:gone], self.prefix[:gone]
        self.dropped, self.start = self.dropped + gone, self.start - gone
        return {"conv_id": self.conv_id, "window": w.number, "first_turn": w.first_turn, "n_history": w.n_history, "n_tokens": w.used, "text": "".join(w.parts), "loss": w.loss}


def _ordered(conversations: DataFrame) -> DataFrame:
    """Conversations whole and in order within partitions; a task streams them and never holds one."""
    return (
        conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """conv_id, window, first_turn, n_history, n_tokens, text, loss (code point ranges of ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer: _Packer | None = None
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for conv_id, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if packer is None or packer.conv_id != conv_id:
                    if packer:
                        rows += packer.close()
                    packer = _Packer(conv_id, budget, history)
                rows += packer.turn(role, text)
                size += len(text)
                if size > 4_000_000 and rows:
                    yield pa.RecordBatch.from_pylist(rows, WINDOWS)
                    rows, size = [], 0
        if packer:
            rows += packer.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, WINDOWS)

    return _ordered(conversations).mapInArrow(run, _DDL)


def parse(text: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, stop) of the turns of a window; the range is that of the escaped text."""
    at = 3
    while at < len(text):
        head = _OPENING.match(text, at)
        role, closing = _CLOSING[head[0]]
        start = head.end()
        stop = text.index(closing, start)
        if head[0] == "[ROLE] ":
            cut = text.index(" [SAYS] ", head.end())
            role, start = unescape(text[head.end() : cut]), cut + len(" [SAYS] ")
            stop = text.index(closing, start)
        yield role, start, stop
        at = stop + len(closing)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of conversations, from formatted windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_windows. ``turns_sha256`` is over role, newline, text, newline of each turn once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
        now: list | None = None
        rows: list[dict] = []

        def row(x: list) -> dict:
            return dict(zip(schema.names, [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6]], strict=True))

        for batch in batches:
            for conv_id, skip, text, loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "n_history", "text", "loss")), strict=True):
                if now is None or now[0] != conv_id:
                    if now:
                        rows.append(row(now))
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for k, (role, start, stop) in enumerate(parse(text)):
                    if k >= skip:
                        now[1] += 1
                        now[2].update(f"{role}\n{unescape(text[start:stop])}\n".encode())
                for part in loss:
                    said = unescape(text[part["start"] : part["stop"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
                now[6] += 1
            if len(rows) > 5000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if now:
            rows.append(row(now))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, ddl)
