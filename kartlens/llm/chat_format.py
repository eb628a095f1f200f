"""Chat formatting: a finite-state machine over roles, a declarative template.

The machine reads a conversation's rows in turn order, checks that the order
of roles is one the template allows, and emits text segments, each with a
loss flag: the marks around a turn never carry loss, an assistant's text
does. Joining a conversation's segments gives its formatted text.

Control strings inside a text (and the escape character itself) are escaped,
so the output reads back exactly. Rows are dealt by conversation and sorted
within partitions; the machine streams over them and holds one row, so a
conversation of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of each role's turns, the roles whose text carries loss, and the
    machine: the states, and from each the next state by role. A role without
    marks of its own gets ``other``, which spells the (escaped) role."""

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<s><<SYS>>", "<</SYS>>"),
            "user": ("<s>[INST]", "[/INST]"),
            "assistant": ("<s>[ANS]", "[/ANS]</s>"),
        }
    )
    other: tuple[str, str] = ("<s>[ROLE]{role}[/ROLE]", "[/END]")
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "asked", "user": "answer"},
            "asked": {"user": "answer"},
            "answer": {"assistant": "asked"},
        }
    )
    escape: str = "\\"
    openers: str = "<["  # every control string begins with one of these

    def escaped(self, text: str) -> str:
        e = self.escape
        for c in e + self.openers:
            text = text.replace(c, e + c)
        return text

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def opening(self, role: str) -> str:
        return self.marks[role][0] if role in self.marks else self.other[0].format(role=self.escaped(role))

    def closing(self, role: str) -> str:
        return self.marks.get(role, self.other)[1]

    def role_of(self, opening: str) -> str:
        """The role that an opening mark stands for."""
        for role, (mark, _) in self.marks.items():
            if opening == mark:
                return role
        before, after = self.other[0].split("{role}")
        return self.unescaped(opening[len(before) : len(opening) - len(after)])

    def next_state(self, state: str, role: str) -> str:
        """``"invalid"`` once the order of roles is not allowed."""
        return self.moves.get(state, {}).get(role, "invalid")


SCHEMA = "conv_id {id}, segment long, text string, loss boolean, state string"


def turn_segments(template: Template, role: str, text: str) -> list[tuple[str, bool]]:
    return [
        (template.opening(role), False),
        (template.escaped(text), role in template.loss),
        (template.closing(role), False),
    ]


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, segment, text, loss, state): three segments for each turn, in
    order; ``state`` is the machine's after the turn, ``"invalid"`` from the
    first turn out of order on. Conversations out of order are formatted too.

    A null text or role is the empty string; a null turn comes first, ties and
    repeated rows follow each other by role and text; rows with a null id are
    one conversation; an empty table gives no segments; other columns aren't
    read. A conversation's segments stand in one partition, in order."""
    template = template or Template()
    id_type = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, n, first = None, template.start, 0, True
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if first or conv != current:
                    current, state, n, first = conv, template.start, 0, False
                state = template.next_state(state, role)
                for part, loss in turn_segments(template, role, text):
                    out.append((conv, n, part, loss, state))
                    n += 1
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "segment", "text", "loss", "state"]
            )

    rows = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, SCHEMA.format(id=id_type))


def formatted(parts: DataFrame) -> DataFrame:
    """(conv_id, text, valid): the joined segments, one row a conversation.
    A conversation is one training example and has to fit in a task here;
    :func:`segments` doesn't need that."""
    rows = F.sort_array(F.collect_list(F.struct("segment", "text")))
    return parts.groupBy("conv_id").agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text"),
        (F.sum(F.when(F.col("state") == "invalid", 1).otherwise(0)) == 0).alias("valid"),
    )


def turn_patterns(template: Template) -> list[re.Pattern]:
    """Patterns of whole turns: (opening mark)(text)closing mark. A text holds
    openers only behind the escape character, so no turn ends early."""
    escape, plain = re.escape(template.escape), f"[^{re.escape(template.escape + template.openers)}]*+"
    body = f"{plain}(?:{escape}.{plain})*+"
    before, after = template.other[0].split("{role}")
    marks = [(re.escape(a), re.escape(b)) for a, b in template.marks.values()]
    marks.append((re.escape(before) + body + re.escape(after), re.escape(template.other[1])))
    return [re.compile(f"({a})({body}){b}", re.DOTALL) for a, b in marks]


def read_back(text: str, template: Template | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    template = template or Template()
    reader = Reader(template)
    turns = reader.read(text)
    reader.finish()
    return turns


class Reader:
    """Reads a formatted text that comes in parts; holds one unfinished turn."""

    def __init__(self, template: Template) -> None:
        self.template, self.patterns, self.rest = template, turn_patterns(template), ""

    def read(self, part: str) -> list[tuple[str, str]]:
        """The turns that ``part`` completes."""
        text, at, turns = self.rest + part, 0, []
        while match := next((m for p in self.patterns if (m := p.match(text, at))), None):
            turns.append((self.template.role_of(match[1]), self.template.unescaped(match[2])))
            at = match.end()
        self.rest = text[at:]
        return turns

    def finish(self) -> None:
        if self.rest:
            raise ValueError(f"formatted text does not read back from {self.rest[:80]!r}")


class Digest:
    """What a conversation's formatted text reads back to, part by part."""

    def __init__(self, template: Template) -> None:
        self.template, self.reader = template, Reader(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid = True

    def add(self, text: str, loss: bool, state: str) -> None:
        self.chars += len(text)
        if loss:
            plain = self.template.unescaped(text)
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)
        for role, plain in self.reader.read(text):
            self.turns.update(f"{role}\n{plain}\n".encode())
            self.n_turns += 1
        self.valid &= state != "invalid"

    def row(self, conv) -> tuple:
        self.reader.finish()
        return (
            conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid,
        )


def digests(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation, read back from its formatted text as it stands
    (turns are found by their marks, not by segment numbers): number of turns,
    digest of roles and texts, the text under the loss mask, characters. Text
    that does not read back is an error. ``parts`` comes from
    :func:`segments` as it is."""
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), (id_type, *kinds), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current, digest, id_type = None, None, None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, n, text, loss, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n == 0:
                    if digest:
                        held.append(digest.row(current))
                    current, digest = conv, Digest(template)
                digest.add(text, loss, state)
            if len(held) >= 10_000:
                yield batch_of(held, id_type)
                held = []
        if digest:
            yield batch_of([*held, digest.row(current)], id_type)

    schema = (
        f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, "
        "loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )
    return parts.select("conv_id", "segment", "text", "loss", "state").mapInArrow(run, schema)
