"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names, per role, the text before and after a turn and whether the
turn's own text carries loss.  ``format_chats`` turns the rows of a conversation
into segments, each with a loss flag; joined they are the training text.  Marks
of the template are the only control strings in it: inside texts and role names
each control string and each escape character gets an escape character behind
its first character, which ``read_turns`` takes out again.

The machine starts in ``start``; a turn's role leads from state to state, and a
role without a step leads to the error state, where it stays.  A conversation is
valid if it ends in one of the final states.  Invalid ones are formatted as
well; ``valid`` and ``first_error`` tell.

One conversation is one training text and so one row; its size is bounded by
that text.  Turns come in the order of ``turn`` (null first), then role, then
text; repeated rows are turns of their own.  Null texts and null roles count as
empty.  A null ``conv_id`` is a conversation of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.text import sql_text

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles by name; ``other`` frames a role's name before a turn of a role without an entry."""

    roles: dict[str, Turn]
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "</s>")
    begin: str = "<s>"
    start: str = "start"
    steps: dict[tuple[str, str], str] = field(default_factory=dict)
    final: tuple[str, ...] = ()

    def controls(self) -> list[str]:
        marks = [self.begin, *self.other]
        for turn in self.roles.values():
            marks += [turn.before, turn.after]
        found = sorted({m for m in marks if m})
        heads = {m[0] for m in found}
        for mark in found:
            if len(mark) < 2 or ESCAPE in mark or heads & set(mark[1:]):
                raise ValueError(f"a mark begins with a character that no mark has inside: {mark!r}")
        return found


#: Instructions between [INST] marks, replies up to the end mark.
INSTRUCT = Template(
    roles={
        "system": Turn("[SYSTEM]", "[/SYSTEM]"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("[REPLY]", "</s>", loss=True),
    },
    steps={
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
    final=("asked", "answered"),
)


def _heads(template: Template) -> str:
    """Pattern of the characters that get an escape character behind them."""
    by_head: dict[str, list[str]] = {}
    for mark in template.controls():
        by_head.setdefault(mark[0], []).append(re.escape(mark[1:]))
    heads = [f"{re.escape(head)}(?={'|'.join(rest)})" for head, rest in by_head.items()]
    return "|".join([re.escape(ESCAPE), *heads])


def escaped(text: str, template: Template) -> str:
    """SQL of ``text`` with its control strings broken."""
    return f"regexp_replace({text}, {sql_text(_heads(template))}, {sql_text('$0' + ESCAPE * 2)})"


def unescaped(text: str) -> str:
    """SQL that takes the escape characters out."""
    return f"regexp_replace({text}, {sql_text('(?s)' + re.escape(ESCAPE) + '(.)')}, '$1')"


def _by_role(template: Template, role: str, value, other: str) -> str:
    whens = [f"WHEN {sql_text(name)} THEN {value(turn)}" for name, turn in template.roles.items()]
    return f"CASE {role} {' '.join(whens)} ELSE {other} END"


def _segments(template: Template, turns: str) -> Column:
    """Segments (text, loss) of an array of turns."""
    text = escaped("t.text", template)
    open_role, close_role, after = map(sql_text, template.other)
    before = _by_role(template, "t.role", lambda x: sql_text(x.before), f"concat({open_role}, {escaped('t.role', template)}, {close_role})")
    end = _by_role(template, "t.role", lambda x: sql_text(x.after), after)
    loss = _by_role(template, "t.role", lambda x: str(x.loss).lower(), "false")
    begin = f"array(named_struct('text', {sql_text(template.begin)}, 'loss', false))"
    return F.expr(f"""concat({begin}, flatten(transform({turns}, t -> array(
        named_struct('text', {before}, 'loss', false),
        named_struct('text', {text}, 'loss', {loss}),
        named_struct('text', {end}, 'loss', false)))))""")


def _machine(template: Template, turns: str) -> Column:
    """struct(state, first_error): the state after all turns, the position of the first turn without a step.

    The error state has an empty name, and no step leads out of it.
    """
    steps = ", ".join(f"{sql_text(f'{state} {role}')}, {sql_text(to)}" for (state, role), to in template.steps.items())
    following = f"element_at(map({steps}), concat(s.state, ' ', t.role))"
    return F.expr(f"""aggregate({turns},
        named_struct('state', {sql_text(template.start)}, 'at', 0, 'first_error', cast(null AS int)),
        (s, t) -> named_struct(
            'state', coalesce({following}, ''),
            'at', s.at + 1,
            'first_error', coalesce(s.first_error, CASE WHEN {following} IS NULL THEN s.at END)))""")


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation: conv_id, segments (text, loss), formatted, valid, first_error."""
    rows = conversations.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = turns.select("conv_id", _segments(template, "turns").alias("segments"), _machine(template, "turns").alias("end"))
    return made.select(
        "conv_id",
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        F.coalesce(F.col("end.state").isin(*template.final), F.lit(False)).alias("valid"),
        F.col("end.first_error").cast("bigint").alias("first_error"),
    )


def read_turns(text: str, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) read back from formatted text."""
    ends = sorted({x.after for x in template.roles.values()} | {template.other[2]})
    split_at = "|".join(f"(?<={re.escape(x)})" for x in ends)
    body = f"substr({text}, {len(template.begin) + 1})"
    pieces = f"filter(split({body}, {sql_text(split_at)}, -1), p -> p <> '')"
    whens = []
    for name, turn in template.roles.items():
        inner = f"substr(p, {len(turn.before) + 1}, length(p) - {len(turn.before) + len(turn.after)})"
        whens.append(f"WHEN startswith(p, {sql_text(turn.before)}) THEN named_struct('role', {sql_text(name)}, 'text', {unescaped(inner)})")
    opening, closing, after = template.other
    inner = f"substr(p, {len(opening) + 1}, length(p) - {len(opening) + len(after)})"
    name = unescaped(f"substring_index({inner}, {sql_text(closing)}, 1)")
    rest = f"substr({inner}, instr({inner}, {sql_text(closing)}) + {len(closing)})"
    other = f"named_struct('role', {name}, 'text', {unescaped(rest)})"
    return F.expr(f"transform({pieces}, p -> CASE {' '.join(whens)} ELSE {other} END)")


def digest(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the formatted text says when read back, and its lengths."""
    trained = [name for name, turn in template.roles.items() if turn.loss]
    rows = chats.select("conv_id", "segments", "formatted", "valid", "first_error", read_turns("formatted", template).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    # the mask is read from the segments, the texts under it from the formatted text
    masked = F.expr(f"array_join(transform(filter(segments, s -> s.loss), s -> {unescaped('s.text')}), '')")
    read = F.array_join(F.transform(F.filter("turns", lambda t: t["role"].isin(*trained)), lambda t: t["text"]), "")
    out = rows.select("conv_id", "formatted", "valid", "first_error", F.size("turns").cast("bigint").alias("n_turns"), F.array_join(lines, "").alias("lines"), masked.alias("loss"), read.alias("read"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2("lines", 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        "first_error",
        (F.col("loss") == F.col("read")).alias("mask_agrees"),
    )
