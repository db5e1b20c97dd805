"""Chat formatting whose output a deterministic parser reads back exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template: a turn is START, the role's name, MIDDLE, the text, END.
START, MIDDLE, END = "### ", ": ", " </turn>\n"
CONTROLS = ("###", "</turn>")
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
LEARNED = "assistant"
ESCAPE = "\\"

_ROLES = {name: role for role, name in NAMES.items()}
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_SPECIAL = re.compile(r"\\(?:\\|###|</turn>)|###|</turn>")


class GrammarError(ValueError):
    """Text that isn't a sequence of turns."""


def escape(text: str, level: int) -> str:
    """Escape less at lower levels: nothing, the control strings, or backslashes as well.

    The last level can always be undone: it doubles every backslash, so one that stands alone is
    always the mark of a control string.
    """
    if level >= 2:
        text = text.replace(ESCAPE, ESCAPE * 2)
    if level >= 1:
        text = _CONTROL.sub(lambda m: ESCAPE + m[0], text)
    return text


def unescape(text: str) -> str:
    """Undo ``escape``: a backslash before another or a control string goes, any other stays."""
    return _SPECIAL.sub(lambda m: m[0][1:] if m[0][0] == ESCAPE else m[0], text)


def _role_name(role: str) -> str:
    """The name of a role; one outside the table is written after "=" with its colons escaped."""
    if role in NAMES:
        return NAMES[role]
    return "=" + role.replace(ESCAPE, ESCAPE * 2).replace(":", ESCAPE + ":")


def _read_role(text: str, at: int) -> tuple[str, int]:
    """The role whose name starts at ``at``, and where the text behind it starts."""
    if text.startswith("=", at):
        found = re.compile(r"=((?:[^\\:]|\\[\\:])*): ").match(text, at)
        if not found:
            raise GrammarError("a role's name doesn't end")
        return re.sub(r"\\([\\:])", r"\1", found[1]), found.end()
    stop = text.find(MIDDLE, at)
    role = _ROLES.get(text[at:stop]) if stop >= 0 else None
    if role is None:
        raise GrammarError("a turn has no known role")
    return role, stop + len(MIDDLE)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of formatted text: role, text, and start and end of the text's escaped form."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise GrammarError("a turn doesn't start with its mark")
        role, begin = _read_role(text, at + len(START))
        for mark in _SPECIAL.finditer(text, begin):
            if mark[0] in CONTROLS:
                break
        else:
            raise GrammarError("a turn doesn't end")
        stop = mark.start() - (len(END) - len(END.lstrip()))
        if stop < begin or not text.startswith(END, stop):
            raise GrammarError("a control string stands in a turn")
        turns.append((role, unescape(text[begin:stop]), begin, stop))
        at = stop + len(END)
    return turns


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """A turn, where its text starts and ends in it, and the escape level.

    The turn is parsed again, and unless role and text come back as they are and alone, more is
    escaped.
    """
    head = START + _role_name(role) + MIDDLE
    for level in range(3):
        body = escape(text, level)
        turn = head + body + END
        try:
            back = parse(turn)
        except GrammarError:
            continue
        if back == [(role, text, len(head), len(head) + len(body))]:
            return turn, len(head), len(head) + len(body), level
    raise GrammarError("no escape level gives the turn back")


def format_turns(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per row: conv, turn, role, formatted, body_start, body_end, learned, level.

    ``formatted`` is the turn by the template; a formatted conversation is its turns' strings one
    after another. ``body_start`` and ``body_end`` bound the text in it in code points, and the loss
    mask covers it where ``learned`` (the assistant's turns). Each row is formatted on its own and
    nothing is shuffled, so a conversation of any length is no burden. A null role or text counts as
    empty; an empty table gives no rows; other columns are ignored.
    """
    rows = conversations.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"),
    )
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv", "turn")]
    names = ["conv", "turn", "role", "formatted", "body_start", "body_end", "learned", "level"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, bodies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            made = [render(r, t) for r, t in zip(roles, bodies, strict=True)]
            arrays = [batch.column(0), batch.column(1), batch.column(2)]
            arrays.append(pa.array([m[0] for m in made], pa.string()))
            arrays += [pa.array([m[i] for m in made], pa.int64()) for i in (1, 2)]
            arrays.append(pa.array([r == LEARNED for r in roles], pa.bool_()))
            arrays.append(pa.array([m[3] for m in made], pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = (
        f"conv {kinds[0]}, turn {kinds[1]}, role string, formatted string, body_start bigint, "
        "body_end bigint, learned boolean, level int"
    )
    return rows.mapInArrow(work, schema)


class _Reader:
    """Digests of a conversation, fed with its formatted turns in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, start: int, end: int, learned: bool) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)
        if learned:
            under = unescape(formatted[start:end])
            self.loss_chars += len(under)
            self.loss.update(under.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (
            self.conv,
            self.turns,
            self.all.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.chars,
        )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What ``format_turns`` wrote, read back: one row per conversation.

    conv, n_turns, turns_sha256 (role, line break, text, line break of each turn), loss_chars and
    loss_sha256 (the unescaped text under the loss mask), formatted_chars. A conversation's turns go
    by turn (null first); equal turns by role and text. Its rows are sorted on disk if need be and
    stream through one task, which holds a turn and two digests at a time: a digest over an ordered
    text can't be split, but no conversation is gathered.
    """
    rows = formatted.select("conv", "turn", "role", "formatted", "body_start", "body_end", "learned")
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "formatted")
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key_type = None, None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
            )

        for batch in batches:
            key_type, done = batch.column(0).type, []
            values = [batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)]
            for conv, text, start, end, learned in zip(*values, strict=True):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.feed(text, start, end, learned)
            if done:
                yield batch_of(done)
        if reader is not None:
            yield batch_of([reader.row()])

    return ordered.mapInArrow(
        work,
        f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint",
    )
