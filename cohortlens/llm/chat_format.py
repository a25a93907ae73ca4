"""Conversations formatted by a declarative template, checked by a finite-state machine over roles.

Only DataFrame functions. A conversation's turns are gathered in order; the machine walks over their
roles; the template turns them into segments, each with a flag whether the loss counts there. Control
strings inside texts are escaped so that the formatted text can be read back without doubt.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Template:
    """How turns are written, which are learned, and which role may follow which.

    A turn is ``<s>[LABEL] text [/LABEL]</s>``. A role without a label is written as ``ROLE:`` and its
    name. ``follows`` are the transitions of the machine from ``START``; ``final`` its accepting states.
    """

    begin: str = "<s>"
    end: str = "</s>"
    labels: tuple[tuple[str, str], ...] = (("user", "INST"), ("assistant", "ANSWER"), ("system", "SYS"))
    other: str = "ROLE:"
    learned: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def control(self) -> list[str]:
        """The strings that must not stand in a text as they are."""
        names = [f"{label}]" for _, label in self.labels] + [self.other]
        return [self.begin, self.end, *(f"[{name}" for name in names), *(f"[/{name}" for name in names)]


def escaped(text: Column, template: Template) -> Column:
    """``text`` with a backslash before each backslash and after the first character of control strings."""
    marks = "|".join(f"{re.escape(mark[0])}(?={re.escape(mark[1:])})" for mark in template.control())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), marks, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def label_of(role: Column, template: Template) -> Column:
    label = F.concat(F.lit(template.other), F.replace(escaped(role, template), F.lit("]"), F.lit("\\]")))
    for name, short in reversed(template.labels):
        label = F.when(role == name, short).otherwise(label)
    return label


def role_of(label: Column, template: Template) -> Column:
    role = unescaped(label.substr(F.lit(len(template.other) + 1), F.length(label)))
    for name, short in reversed(template.labels):
        role = F.when(label == short, name).otherwise(role)
    return role


def walked(roles: Column, template: Template) -> Column:
    """The machine's last state and the number of turns before it broke."""
    moves = [f"{state}>{role}" for state, roles_ in template.follows.items() for role in roles_]
    begin = F.struct(F.lit(START).alias("state"), F.lit(0).cast("long").alias("n_valid"))

    def step(at: Column, role: Column) -> Column:
        allowed = F.concat(at["state"], F.lit(">"), role).isin(moves)
        return F.struct(
            F.when(allowed, role).otherwise(BROKEN).alias("state"),
            F.when(allowed, at["n_valid"] + 1).otherwise(at["n_valid"]).alias("n_valid"),
        )

    return F.aggregate(roles, begin, step)


def format_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation: ``conv_id``, ``segments``, ``formatted``, ``valid`` and ``n_valid``.

    ``segments`` are (text, loss) in order; joined they are ``formatted``. ``valid`` tells whether the
    machine accepts the turn order, ``n_valid`` how many turns it accepted; no turn is dropped.

    Turns are ordered by ``turn``, NULL first, ties by role and text; repeated rows stay. A NULL text or
    role counts as empty. Rows with a NULL ``conv_id`` form one conversation. Other columns are ignored.
    An empty table gives an empty table. One conversation is one row of the result and so has to fit a
    task; conversations are spread by id, and equal ones with different ids do not meet.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    gathered = chats.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(one: Column) -> Column:
        label = label_of(one["role"], template)
        parts = (
            (F.concat(F.lit(f"{template.begin}["), label, F.lit("] ")), F.lit(False)),
            (escaped(one["text"], template), one["role"].isin(*template.learned)),
            (F.concat(F.lit(" [/"), label, F.lit(f"]{template.end}")), F.lit(False)),
        )
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts))

    walk = gathered.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        walked(F.col("turns.role"), template).alias("walk"),
    )
    return walk.select(
        "conv_id",
        "segments",
        F.array_join("segments.text", "").alias("formatted"),
        F.col("walk.state").isin(*template.final).alias("valid"),
        F.col("walk.n_valid").alias("n_valid"),
    )


def read_chat(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, re.escape(template.end))

    def turn(piece: Column) -> Column:
        lead, tail = len(template.begin) + 1, len(" [/]")
        label = F.regexp_extract(piece, rf"(?s)^{re.escape(template.begin)}\[((?:[^\]\\]|\\.)*+)\] ", 1)
        size = F.length(label)
        text = piece.substr(size + lead + 3, F.length(piece) - 2 * size - lead - 2 - tail)
        return F.struct(role_of(label, template).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, joined without anything between."""
    chosen = F.filter(segments, lambda segment: segment["loss"])
    return F.array_join(F.transform(chosen, lambda segment: unescaped(segment["text"])), "")
