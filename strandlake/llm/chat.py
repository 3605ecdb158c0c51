"""Chat formatting from a declarative template, with DataFrame functions only.

A finite-state machine over roles says whether a conversation's turns come in a permitted
order.  Every turn becomes three segments (its opening, its text, its closing), each with
a loss flag; the formatted conversation is their texts end to end.  Control strings in
texts and roles are escaped reversibly: ``%`` becomes ``%25``, ``<|`` becomes ``%3C|``
and, in roles, a line feed becomes ``%0A``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles carry loss, and which role may follow which.

    ``transitions`` maps a state to the roles allowed next; the state after a turn is its
    role.  A conversation is valid if it ends in one of ``accept``.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    accept: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def format_chats(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, n_turns, valid, segments) of conversations (conv_id, turn, role, text).

    segments is array<struct<text, loss>>.  Turns are taken by turn number; ties and
    repeated rows follow by role and text and all stay.  A null text or role is empty, a
    null turn comes first, rows with a null conv_id form one conversation, an unknown role
    makes a conversation invalid but it is still formatted.  Other columns are ignored; an
    empty table gives no rows.  A conversation, however long, is gathered in one row, as its text is one.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    table = F.create_map(*chain.from_iterable((F.lit(f"{state}|{role}"), F.lit(role)) for state, roles in template.transitions.items() for role in roles))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(table[F.concat(s, F.lit("|"), t["role"])], F.lit("?")))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.open), escape_role(t["role"]), F.lit("\n")), F.lit(False)),
                segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.close), F.lit(False)),
            ),
        )
    )
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*template.accept).alias("valid"), segments.alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.slice(F.split(formatted, "\\Q" + template.open + "\\E", -1), 2, 2147483647 - 2)

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.length(part) - len(template.close))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)
