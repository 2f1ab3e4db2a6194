"""Conversations as training text: turns checked by a finite-state machine and rendered from a declarative template.

A ``Template`` says how the turns of each role are marked, which of their texts count in the loss, which control
strings the marks are made of, and which role may follow which. ``segments`` checks and cuts turns row by row;
``render`` joins the segments of a conversation to one string and tells the spans under the loss; ``read_back`` turns
such strings into turns and loss texts again.

Escape. A control string is a first character out of ``Template.opens`` and a rest. A text in which n marks stand
between the two gets one mark more, so no control string is left in a text, and taking one mark away from each
restores every text, whether it had such marks of its own or not.

The machine's state is the last turn's role. A turn whose role may not follow gets ``ok`` false, and the machine goes
on from it; after a role that the template does not know, any may follow. Turns are dealt by conversation and stretch of
STRETCH turn numbers, and only the last role of each stretch is looked at across stretches, so one conversation may
hold any share of all rows. Texts of illegal turns are rendered all the same: nothing is dropped.

Defined cases: turns of a conversation go by (turn, role, text), nulls first; repeated turns are all kept; a null text
is empty; a null role is the role of empty name; roles beside those of the template are rendered with their name; a null conv_id
is a conversation; a conversation of one turn, or without a text under the loss, has an empty loss text; an empty table
gives an empty result; other columns of the turns are not read, so they may have any name. A rendered conversation is
one string, so one conversation's text must fit a row of Spark (2 GB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1024
START, OTHER = "", "\0other"


@dataclass(frozen=True)
class Mark:
    """What stands before and after a text of a role, and whether the text counts in the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Mark]
    #: For any other role; its name stands between ``before`` and ``named``.
    other: Mark
    named: str
    control: tuple[str, ...]
    #: The machine: what may follow a role, and what may come first (START).
    follows: dict[str, tuple[str, ...]]
    #: Roles with which a conversation may end.
    ends: tuple[str, ...]
    escape: str = "~"
    opens: str = field(init=False, default="")
    rests: str = field(init=False, default="")

    def __post_init__(self) -> None:
        for a in self.control:
            if len(a) < 2 or self.escape in a or any(a != b and a in b for b in self.control) or any(a[-k:] == b[:k] for b in self.control for k in range(1, len(a)) if a != b or k < len(a)):
                raise ValueError(f"control strings must not overlap, be parts of one another or hold the escape: {a!r}")
        for mark in (*self.roles.values(), self.other):
            if not any(c in mark.before for c in self.control) or not any(c in mark.after for c in self.control):
                raise ValueError("each mark needs a control string before and after the text")
        object.__setattr__(self, "opens", "[" + "".join(re.escape(c) for c in sorted({c[0] for c in self.control})) + "]")
        object.__setattr__(self, "rests", "|".join(re.escape(c[1:]) for c in self.control))


#: Marks in the manner of instruction-tuned chat models.
INSTRUCT = Template(
    roles={"system": Mark("<<SYS>>\n", "\n<</SYS>>\n"), "user": Mark("<s>[INST] ", " [/INST]"), "assistant": Mark("<<REPLY>> ", " </s>\n", loss=True)},
    other=Mark("<<ROLE>>", "<</ROLE>>\n"),
    named="<<SAYS>>",
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<REPLY>>", "<<ROLE>>", "<<SAYS>>", "<</ROLE>>"),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("user", "assistant"),
)


def escaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"({t.opens})({t.escape}*)({t.rests})", f"$1{t.escape}$2$3")


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"({t.opens}){t.escape}({t.escape}*)({t.rests})", "$1$2$3")


def choose(role: Column, t: Template, value, other) -> Column:
    """value(name, mark) of the role, or ``other``."""
    out = None
    for name, mark in t.roles.items():
        out = F.when(role == name, value(name, mark)) if out is None else out.when(role == name, value(name, mark))
    return out.otherwise(other)


def cut(role: Column, text: Column, t: Template) -> Column:
    """A turn's segments in order: array<struct<text, loss>>."""
    piece = lambda x, loss=False: F.struct((F.lit(x) if isinstance(x, str) else x).alias("text"), F.lit(loss).alias("loss"))
    body = escaped(text, t)
    whole = lambda mark: F.array(piece(mark.before), piece(body, mark.loss), piece(mark.after))
    named = F.array(piece(F.concat(F.lit(t.other.before), escaped(role, t), F.lit(t.named))), piece(body, t.other.loss), piece(t.other.after))
    return choose(role, t, lambda _, mark: whole(mark), named)


def checked(turns: DataFrame, t: Template) -> DataFrame:
    """Adds ``after`` (the role before; empty at the start) and ``ok`` to turns (conv_id, turn, role, text)."""
    # one key of both, as null is equal to null within a struct
    dealt = turns.withColumn("_key", F.struct("conv_id", F.floor(F.col("turn") / STRETCH).alias("at")))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    inside = F.lag("role").over(Window.partitionBy("_key").orderBy(*order))
    ends = dealt.groupBy("_key").agg(F.max(F.struct("turn", "role", "text")).role.alias("_last"))
    before = ends.select("_key", F.lag("_last").over(Window.partitionBy("_key.conv_id").orderBy(F.col("_key.at").asc_nulls_first())).alias("_before"))
    joined = dealt.withColumn("_inside", inside).join(before.where("_before is not null"), "_key", "left")
    after = F.coalesce("_inside", "_before", F.lit(START))
    began = F.col("_inside").isNull() & F.col("_before").isNull()
    legal = F.lit(False)
    for role, then in t.follows.items():
        here = began if role == START else ~began & (after == role)
        legal = legal | (here & F.col("role").isin(*then))
    unknown = ~began & ~after.isin(*[r for r in t.follows if r != START])
    return joined.withColumns({"after": after, "ok": legal | unknown}).drop("_key", "_inside", "_before")


def segments(turns: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """(conv_id, turn, role, text, after, ok, segments) of every turn; a turn's segments are array<struct<text, loss>>."""
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return checked(plain, t).withColumn("segments", cut(F.col("role"), F.col("text"), t))


def render(cut_turns: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """(conv_id, formatted, spans, first_bad_turn, complete) by conversation.

    spans: array<struct<begin, length>> of what counts in the loss, in code points from 0; first_bad_turn: the number
    among the conversation's turns, from 0, of the first illegal one; complete: no illegal turn, and an end that the
    template allows.
    """
    # of equal turns the legal ones come first
    row = F.struct("turn", "role", "text", (~F.col("ok")).alias("bad"), "segments")
    whole = cut_turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_t"))
    flat = whole.select("conv_id", "_t", F.flatten(F.transform("_t", lambda x: x.segments)).alias("_s"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        length = F.length(x.text).cast("long")
        span = F.array(F.struct(state.at.alias("begin"), length.alias("length")))
        return F.struct((state.at + length).alias("at"), F.when(x.loss, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    bad = F.array_position(F.transform("_t", lambda x: x.bad), True)
    complete = (bad == 0) & F.element_at("_t", -1).role.isin(*t.ends)
    return flat.select(
        "conv_id", F.array_join(F.transform("_s", lambda x: x.text), "").alias("formatted"), F.aggregate("_s", start, step, lambda s: s.spans).alias("spans"),
        F.when(bad > 0, bad - 1).alias("first_bad_turn"), complete.alias("complete"),
    )


def turns_of(formatted: Column, t: Template) -> Column:
    """The turns in a rendered string: array<struct<role, text>>."""
    q = lambda s: "\\Q" + s + "\\E"
    one = "|".join(f"{q(m.before)}.*?{q(m.after)}" for m in (*t.roles.values(), t.other))

    def turn(x: Column) -> Column:
        inner = lambda m: F.substr(x, F.lit(len(m.before) + 1), F.length(x) - len(m.before) - len(m.after))
        out = None
        for name, m in t.roles.items():
            value = F.struct(F.lit(name).alias("role"), unescaped(inner(m), t).alias("text"))
            out = F.when(x.startswith(m.before), value) if out is None else out.when(x.startswith(m.before), value)
        name_end = F.instr(inner(t.other), t.named)
        role = F.substr(inner(t.other), F.lit(1), name_end - 1)
        text = F.substr(inner(t.other), name_end + len(t.named))
        return out.otherwise(F.struct(unescaped(role, t).alias("role"), unescaped(text, t).alias("text")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{one})"), F.lit(0)), turn)


def loss_text(formatted: Column, spans: Column, t: Template) -> Column:
    """All texts under the loss, as they were, one after the other."""
    part = lambda x: unescaped(F.substr(formatted, (x.begin + 1).cast("int"), x.length.cast("int")), t)
    return F.array_join(F.transform(spans, part), "")


def read_back(rendered: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """Adds ``turns`` and ``loss_text``, read from ``formatted`` and ``spans`` alone."""
    return rendered.withColumns({"turns": turns_of(F.col("formatted"), t), "loss_text": loss_text(F.col("formatted"), F.col("spans"), t)})
