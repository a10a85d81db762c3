"""Chat formatting (operator 1), native.

A ``ChatTemplate`` declares the marks around a turn's role and text, which roles are trained on and the
allowed turn order (a finite-state machine). Turns become text segments with a loss flag each.
Escapes follow from the template's own marks: between the first two characters of ``open`` or of ``close``
inside a text (with any backslashes between them) goes one more backslash, so the marks alone hold these
pairs; in a role a backslash and the first characters of the marks are written as a backslash and a second
character. Both are read back exactly; marks for which that can't hold are refused (``ValueError``).

Defined cases: a null text is empty; a null role is the role of empty name, never allowed; rows of
a conversation are ordered by turn (nulls first), equal turns by role and text, repeated rows stay;
rows with a null conversation id form one conversation; an empty table gives no rows; other columns
are ignored. A conversation is one training text, hence one row: it must fit in memory as such.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namemine.llm.shared import only

@dataclass(frozen=True)
class ChatTemplate:
    """Segments of a turn: ``open`` + role + ``middle`` | text | ``close``."""

    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow; the state after a turn is its role.
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("assistant", "tool"),
    })

    def __post_init__(self):
        for mark in (self.open, self.close):
            if len(mark) < 2 or mark[0] == mark[1] or "\\" in mark[:2]:
                raise ValueError(f"a mark must start with two unlike characters other than a backslash, not {mark!r}")
        if not self.middle or self.middle[0] in "\\0123456789" or self.open[0].isdigit() or self.close[0].isdigit():
            raise ValueError("no mark may be empty or start with a backslash or a digit")
        head = self.open + self.middle
        if self.close in head or any(x.endswith(self.close[:k]) for x in (self.open, self.middle) for k in range(1, len(self.close))):
            raise ValueError("the closing mark can't be told from the marks before a text")

    @property
    def pairs(self) -> list[str]:
        return sorted({self.open[:2], self.close[:2]})

    @property
    def firsts(self) -> list[str]:
        return sorted({m[0] for m in (self.open, self.middle, self.close)})


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def escape(text: Column, template: ChatTemplate | None = None) -> Column:
    for first, second in (template or ChatTemplate()).pairs:
        text = F.regexp_replace(text, rf"({_quoted(first)}\\*)({_quoted(second)})", r"$1\\$2")
    return text


def unescape(text: Column, template: ChatTemplate | None = None) -> Column:
    for first, second in (template or ChatTemplate()).pairs:
        text = F.regexp_replace(text, rf"({_quoted(first)}\\*)\\({_quoted(second)})", "$1$2")
    return text


def _escape_role(role: Column, template: ChatTemplate) -> Column:
    role = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    for i, first in enumerate(template.firsts):
        role = F.replace(role, F.lit(first), F.lit(f"\\{i}"))
    return role


def _unescape_role(role: Column, template: ChatTemplate) -> Column:
    for i, first in enumerate(template.firsts):
        to = "\\$" if first == "$" else first
        role = F.regexp_replace(role, rf"(?<!\\)((?:\\\\)*)\\{i}", "$1" + to)
    return F.replace(role, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) -> ``conv_id, n_turns, valid, first_bad_turn`` (its
    place from 0, null if none), ``formatted`` and ``segments`` (array of ``text, loss``; their
    texts in order are ``formatted``)."""
    t = template or ChatTemplate()
    rows = only(turns, conv_id="long", turn="long", role="string", text="string").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    allowed = [f"{state}>{role}" for state, roles in t.order.items() for role in roles]

    def step(acc: Column, turn: Column) -> Column:
        fits = F.concat(acc["state"], F.lit(">"), turn["role"]).isin(allowed)
        return F.struct(
            F.when(fits, turn["role"]).otherwise(F.lit("error")).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], F.when(~fits, acc["at"])).alias("bad"),
        )

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("bad"))
    machine = F.aggregate("turns", begin, step)

    def segments(turn: Column) -> Column:
        head = F.concat(F.lit(t.open), _escape_role(turn["role"], t), F.lit(t.middle))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"], t).alias("text"), turn["role"].isin(list(t.loss_roles)).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    made = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), machine.alias("m"),
                        F.flatten(F.transform("turns", segments)).alias("segments"))
    return made.select(
        "conv_id", "n_turns",
        (F.col("m.bad").isNull() & F.col("m.state").isin(list(t.accepting))).alias("valid"),
        F.col("m.bad").alias("first_bad_turn"),
        F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns (array of ``role, text``) read back from a formatted text."""
    t = template or ChatTemplate()
    parts = F.split(formatted, _quoted(t.close))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skip = len(t.open)

    def turn(part: Column) -> Column:
        rest = F.substring(part, F.lit(skip + 1), F.length(part))
        at = F.instr(rest, F.lit(t.middle))
        return F.struct(
            _unescape_role(F.substring(rest, F.lit(1), at - 1), t).alias("role"),
            unescape(F.substring(rest, at + len(t.middle), F.length(rest)), t).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    trained = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(trained, lambda s: unescape(s["text"], template)), "")
