"""Chat formatting by a finite-state machine over roles.

A template states, for each role, the strings before and after a turn's text and whether the text counts for the loss,
and which role may follow which. Conversations are dealt out by id and sorted by turn; a task walks through them with
one state per conversation, so a conversation of any length needs the memory of one turn. Each turn gives its segments
of text with a loss flag, the state that it leads to, and whether the order has been valid so far.

Control strings inside a text get a backslash behind their first character, and a backslash is doubled; ``read_turn``
undoes both, so the output can be read back whatever the texts hold.

Defined cases: null texts and roles are empty; a role that the template does not name is written as its ``other`` turn
with the role's name in front, and is no valid order; rows of one conversation and turn are ordered by role and text;
rows without a conversation id form one conversation; an empty table gives an empty result. Invalid conversations are
formatted too and flagged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import map_arrow, whole


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: tuple[tuple[str, Turn], ...]
    other: Turn
    divider: str  # between the name of another role and its text
    control: tuple[str, ...]  # strings that must not appear in a text as they are
    order: tuple[tuple[str, str], ...]  # (role, role that may follow); "" is the start
    last: tuple[str, ...]  # roles a complete conversation ends with


INSTRUCT = Template(
    turns=(
        ("system", Turn("<<SYS>> ", " <</SYS>>\n")),
        ("user", Turn("<s>[INST] ", " [/INST]")),
        ("assistant", Turn(" ", " </s>", loss=True)),
    ),
    other=Turn("[ROLE] ", " [/ROLE]"),
    divider=" [TEXT] ",
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]"),
    order=(("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")),
    last=("assistant",),
)
SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


class Formatter:
    def __init__(self, template: Template):
        self.template, self.turns = template, dict(template.turns)
        self.follows = set(template.order)
        self.special = re.compile("|".join(map(re.escape, ("\\", *template.control))))

    def escape(self, text: str) -> str:
        return self.special.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"(.)\\", lambda m: m[1], text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        turn, other = self.turns.get(role), self.template.other
        if turn is None:
            return [(f"{other.before}{self.escape(role)}{self.template.divider}", False), (self.escape(text), other.loss), (other.after, False)]
        return [(turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]

    def read_turn(self, formatted: str) -> tuple[str, str]:
        """The role and the text of a formatted turn. The longest opening string wins: a space opens every turn that
        no control string opens."""
        t = self.template
        if formatted.startswith(t.other.before):
            name, _, text = formatted.removeprefix(t.other.before).removesuffix(t.other.after).partition(t.divider)
            return self.unescape(name), self.unescape(text)
        for role, turn in sorted(t.turns, key=lambda x: -len(x[1].before)):
            if formatted.startswith(turn.before) and formatted.endswith(turn.after):
                return role, self.unescape(formatted[len(turn.before) : len(formatted) - len(turn.after)])
        raise ValueError(f"no turn of the template: {formatted[:80]!r}")


def format_turns(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per turn, conversation by conversation and in order within a partition: ``conv_id``, ``turn``,
    ``position`` from 0, ``role``, ``segments`` (array of text and loss flag), ``valid`` (the order so far) and
    ``may_end`` (a complete conversation may end here)."""
    rows = conversations.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, current, before, position, valid = Formatter(template), object(), "", 0, True
        for batch in batches:
            positions, segments, flags, ends = [], [], [], []
            roles = batch.column(2).to_pylist()
            for conv, role, text in zip(batch.column(0).to_pylist(), roles, batch.column(3).to_pylist(), strict=True):
                if conv != current:
                    current, before, position, valid = conv, "", 0, True
                valid = valid and (before, role) in formatter.follows
                segments.append([{"text": t, "loss": loss} for t, loss in formatter.segments(role, text)])
                positions.append(position)
                flags.append(valid)
                ends.append(valid and role in template.last)
                before, position = role, position + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(positions, pa.int64()), batch.column(2), pa.array(segments, SEGMENTS), pa.array(flags), pa.array(ends)],
                ["conv_id", "turn", "position", "role", "segments", "valid", "may_end"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    return map_arrow(
        dealt, run,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, position bigint, role string, "
        "segments array<struct<text: string, loss: boolean>>, valid boolean, may_end boolean",
    )


def digests(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Reads the rows of ``format_turns`` back, in their order, and gives one row per conversation: ``n_turns``,
    ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars`` and ``valid`` (a complete, valid order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, done, state = Formatter(template), [], None

        def close() -> None:
            if state is not None:
                conv, n, all_turns, loss_chars, loss, chars, valid = state
                done.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))

        def flush() -> pa.RecordBatch:
            kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        conv_type = None
        for batch in batches:
            conv_type = batch.column(0).type
            for conv, position, segments, ends in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4, 6)), strict=True):
                if position == 0:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                formatted = "".join(s["text"] for s in segments)
                role, text = formatter.read_turn(formatted)
                under_loss = "".join(formatter.unescape(s["text"]) for s in segments if s["loss"])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(under_loss)
                state[4].update(under_loss.encode())
                state[5] += len(formatted)
                state[6] = ends
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return map_arrow(
        turns, run,
        f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, valid boolean",
    )
