"""Chat formatting from a declarative template.

A template says which strings open and close a turn of each role, which roles'
texts carry loss, and which role may follow which: a finite-state machine whose
state is the role of the turn before. Rows of a conversation are put in order in
their partition and streamed through the machine, one state at a time, so memory
does not depend on the length of a conversation: one that holds a third of all
rows is sorted on disk and read once. (Its turns stay in one task: a machine's
state and a running digest both need the turn before.)

A turn that the machine does not allow is formatted like any other and marked:
``valid`` is false for it and ``reason`` says why.

Control strings of the template inside texts are escaped, and can be read back:
a backslash becomes two, and a backslash is put after the first character of
each control string.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    """Strings around a turn's text, and whether the text carries loss."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    roles: dict[str, Marks]
    #: Around the role's name in turns of roles that are not listed.
    other_opens: tuple[str, str]
    other_closes: str
    #: For each state, the roles that may come next; "" is the start.
    follows: dict[str, tuple[str, ...]]
    #: States in which a conversation may end.
    ends: tuple[str, ...]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [s for m in self.roles.values() for s in (m.opens, m.closes)]
        every = {s.strip() for s in [*marks, *self.other_opens, self.other_closes]} - {""}
        if any("\\" in s or len(s) < 2 for s in every):
            raise ValueError("control strings have two characters or more and no backslash")
        if any(s[0] in t[1:] for s in every for t in every):
            raise ValueError("a control string's first character occurs at its start only")
        object.__setattr__(self, "controls", tuple(sorted(every, key=lambda s: (-len(s), s))))

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for control in self.controls:
            if control in text:
                text = text.replace(control, f"{control[0]}\\{control[1:]}")
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text

    def render(self, role: str, text: str) -> tuple[str, str, str, bool]:
        """What opens the turn, its escaped text, what closes it, and loss."""
        marks = self.roles.get(role)
        if marks:
            return marks.opens, self.escape(text), marks.closes, marks.loss
        before, after = self.other_opens
        return f"{before}{self.escape(role)}{after}", self.escape(text), self.other_closes, False

    def parse(self, turn: str) -> tuple[str, str, int]:
        """The role and text of one formatted turn, and where its text starts."""
        for role, marks in self.roles.items():
            if turn.startswith(marks.opens):
                start, closes = len(marks.opens), marks.closes
                break
        else:
            before, after = self.other_opens
            middle = turn.index(after, len(before))
            role = self.unescape(turn[len(before) : middle])
            start, closes = middle + len(after), self.other_closes
        if not turn.endswith(closes) or len(turn) < start + len(closes):
            raise ValueError("not a whole turn of this template")
        return role, self.unescape(turn[start : len(turn) - len(closes)]), start


DEFAULT = ChatTemplate(
    roles={
        "system": Marks("<sys> ", " </sys>\n"),
        "user": Marks("[INST] ", " [/INST] "),
        "assistant": Marks("<s>", "</s>\n", loss=True),
    },
    other_opens=("{role ", " =}"),
    other_closes="{/role}\n",
    follows={
        "": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
    ends=("user", "assistant"),
)

SEGMENTS = (
    "conv_id bigint, position bigint, role string, start bigint, "
    "segments array<struct<text: string, loss: boolean>>, valid boolean, reason string"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint, valid boolean"
)


def _turns(template: ChatTemplate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, position, start, any_row = None, "", 0, 0, False
        for batch in batches:
            out: list[dict] = []
            for conv, role, text in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True
            ):
                if not any_row or conv != now:
                    now, state, position, start, any_row = conv, "", 0, 0, True
                role, text = role or "", text or ""
                reason = None
                if role not in template.roles:
                    reason = f"unknown role {role!r}"
                elif role not in template.follows.get(state, ()):
                    reason = f"{role} after {state or 'the start'}"
                opens, body, closes, loss = template.render(role, text)
                out.append(
                    {
                        "conv_id": conv,
                        "position": position,
                        "role": role,
                        "start": start,
                        "segments": [
                            {"text": opens, "loss": False},
                            {"text": body, "loss": loss},
                            {"text": closes, "loss": False},
                        ],
                        "valid": reason is None,
                        "reason": reason,
                    }
                )
                # After a role it does not know the machine stays where it was.
                state = role if role in template.roles else state
                position += 1
                start += len(opens) + len(body) + len(closes)
            for low in range(0, len(out), 1000):
                yield pa.RecordBatch.from_pylist(out[low : low + 1000], schema=_ARROW)

    return run


_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("position", pa.int64()),
        ("role", pa.string()),
        ("start", pa.int64()),
        ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
        ("valid", pa.bool_()),
        ("reason", pa.string()),
    ]
)


def format_chats(conversations: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """One row for each turn of ``conversations`` (conv_id, turn, role, text):
    its place in its conversation, where its formatted text starts there, its
    segments in order with their loss flags, and whether the machine allows it.
    Formatted, a conversation is all its segments in order.

    Turns are ordered by turn (null first), then role and text; a null text or
    role is empty; a null conv_id is one conversation; repeated rows are turns of
    their own. Other columns are not read. The result is in order by conv_id and
    position within its partitions, each conversation in one of them."""
    ordered = (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.mapInArrow(_turns(template), SEGMENTS)


class _Reading:
    """Digests of one formatted conversation, read turn by turn."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid, self.last = True, ""

    def row(self, conv: int | None, template: ChatTemplate) -> dict:
        return {
            "conv_id": conv,
            "n_turns": self.n,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
            "valid": self.valid and self.last in template.ends,
        }


def _digests(template: ChatTemplate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        reading: _Reading | None = None
        names = [x.split(" ")[0] for x in DIGESTS.split(", ")]

        def out(rows: list[dict]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, kinds, strict=True))))

        for batch in batches:
            done: list[dict] = []
            for conv, segments, valid in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "segments", "valid")), strict=True
            ):
                if reading is None or conv != now:
                    if reading:
                        done.append(reading.row(now, template))
                    now, reading = conv, _Reading()
                turn = "".join(s["text"] for s in segments)
                role, text, _ = template.parse(turn)
                reading.turns.update(f"{role}\n{text}\n".encode())
                masked = template.unescape("".join(s["text"] for s in segments if s["loss"]))
                reading.loss.update(masked.encode())
                reading.loss_chars += len(masked)
                reading.chars += len(turn)
                reading.n += 1
                reading.valid &= valid
                reading.last = role
            if done:
                yield out(done)
        if reading:
            yield out([reading.row(now, template)])

    return run


def read_back(formatted: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """One row for each conversation of ``format_chats``, read back from its
    formatted turns: their number, digests of roles and texts and of the text
    under the loss mask, and whether the machine allows the whole conversation.
    Takes ``format_chats``' rows as they come; nothing is shuffled again."""
    return formatted.mapInArrow(_digests(template), DIGESTS)


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and one more, -1, whose texts look like control strings."""
    probe = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.range(1, numPartitions=1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
    )
    more = more.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.lit(probe).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
