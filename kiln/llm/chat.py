"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's rows, in order of turn, run through the machine: it knows the
roles that may follow each other and marks what does not fit.  Every turn gives
three text segments, its opening control string, its escaped text and its
closing control string; only assistant texts bear loss.  Joined in order, a
conversation's segments are its formatted text.

Control strings inside texts are escaped with a backslash, and backslashes are
doubled, so that a formatted text can be split and unescaped without doubt.

The rows of a conversation are streamed in order through one task: its digest
depends on all turns in order.  No task holds more than one row's text and the
running state, however long a conversation is.

Cases: a null text is empty, a null role is the role "" (an invalid turn); a
null id is a conversation of its own; a null turn comes first; rows with equal
turns are ordered by role and text; repeated rows are turns of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Template(NamedTuple):
    """What surrounds a turn.  ``{role}`` stands for the turn's role; an unknown role is written as it is."""
    names: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    opening: str = "### {role}: "
    closing: str = " </turn>\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    # role -> roles that may follow; "" is the start
    follows: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        """The strings that may not stand in a text unescaped."""
        return (self.escape, self.opening.split("{role}")[0].strip(), self.closing.strip())


CHATML = Template(names=(), opening="<|im_start|>{role}\n", closing="<|im_end|>\n")
SEGMENTS = "conv_id long, segment long, turn long, role string, part string, text string, loss boolean, valid boolean"


class Formatter:
    """Turns texts into segments and back for one template."""

    def __init__(self, template: Template):
        self.t = template
        self.names = dict(template.names)
        self.roles = {v: k for k, v in template.names}
        strings = sorted(template.controls(), key=len, reverse=True)
        self.control = re.compile("|".join(map(re.escape, strings)))
        self.escaped = re.compile(re.escape(template.escape) + "(" + "|".join(map(re.escape, strings)) + ")")
        head, tail = template.opening.split("{role}")
        # a turn in a formatted text: no unescaped control string stands inside its text
        body = f"(?:{re.escape(template.escape)}(?:{'|'.join(map(re.escape, strings))})|(?!{self.control.pattern}).)*"
        self.turn = re.compile(re.escape(head) + f"(?P<role>{body}?)" + re.escape(tail) + f"(?P<text>{body})"
                               + re.escape(template.closing), re.DOTALL)

    def escape(self, text: str) -> str:
        return self.control.sub(lambda m: self.t.escape + m.group(0), text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m.group(1), text)

    def opening(self, role: str) -> str:
        return self.t.opening.replace("{role}", self.names.get(role, self.escape(role)))

    def role(self, opening: str) -> str:
        """The role that an opening control string names."""
        head, tail = self.t.opening.split("{role}")
        name = opening[len(head):len(opening) - len(tail)]
        return self.roles.get(name, self.unescape(name))

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a whole formatted text; raises if it is not one."""
        out, at = [], 0
        while at < len(formatted):
            m = self.turn.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at {at}")
            name = m["role"]
            out.append((self.roles.get(name, self.unescape(name)), self.unescape(m["text"])))
            at = m.end()
        return out


def _formatted(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, follows = Formatter(template), dict(template.follows)
        conv, state, segment, seen = None, "", 0, False
        for batch in batches:
            rows = []
            for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if not seen or conv_id != conv:
                    conv, state, segment, seen = conv_id, "", 0, True
                role = role or ""
                valid = role in follows.get(state, ())
                state = role
                for part, content, loss in (("open", f.opening(role), False),
                                            ("text", f.escape(text or ""), role in template.loss_roles),
                                            ("close", template.closing, False)):
                    rows.append((conv_id, segment, turn, role, part, content, loss, valid))
                    segment += 1
            yield _batch(rows, _ARROW)
    return run


_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                    ("part", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                     ("valid", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def format_segments(conversations: DataFrame, template: Template = Template(), conv_col: str = "conv_id",
                    turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per segment, conversations whole and in order within a partition."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_formatted(template), SEGMENTS)


class _Reading:
    """Reads a conversation back from its formatted segments, piece by piece."""

    def __init__(self, template: Template, conv_id):
        self.f, self.conv_id, self.ends = Formatter(template), conv_id, template.ends
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.role, self.valid = "", True

    def take(self, part: str, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        if part == "open":
            self.role = self.f.role(text)
            self.valid &= valid
        elif part == "text":
            plain = self.f.unescape(text)
            self.n += 1
            self.turns.update(f"{self.role}\n{plain}\n".encode())
            if loss:
                self.loss.update(plain.encode())
                self.loss_chars += len(plain)

    def row(self) -> tuple:
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.valid and self.role in self.ends)


def _read(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        for batch in batches:
            done = []
            for conv_id, segment, part, text, loss, valid in zip(
                    *(batch.column(c).to_pylist() for c in ("conv_id", "segment", "part", "text", "loss", "valid")),
                    strict=True):
                if segment == 0:
                    if now is not None:
                        done.append(now.row())
                    now = _Reading(template, conv_id)
                now.take(part, text, loss, valid)
            yield _batch(done, _DIGEST)
        if now is not None:
            yield _batch([now.row()], _DIGEST)
    return run


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from the segments of ``format_segments`` in their order.

    valid: the machine accepted every turn and the last one.
    """
    return segments.mapInArrow(
        _read(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts contain the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                 "conv_id long, turn long, role string, text string")
