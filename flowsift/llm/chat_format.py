"""Chat formatting: a finite-state machine over the roles checks the order of
turns, and a declarative template emits text segments with a loss flag each.

A template names the marks around a turn, the roles whose text carries loss
and the allowed steps between states (a state is the last role seen). The
marks are made of the control strings ``<|...|>``. Inside roles and texts
``<`` followed by any number of backslashes and ``|`` gets one backslash
more, so no escaped text holds ``<|``, every mark in the output is a real
one, and removing one backslash gives the text back. Roles also escape their
line breaks, which end the role in the header.

Everything is DataFrame functions: turns are gathered per conversation (one
conversation is one output row by definition), ordered by (turn, role,
text), and folded with ``aggregate``.

Nulls and ties: a null text or role is empty; a null turn comes first; equal
turns are ordered by role and text; rows of a null conv_id are one
conversation. Unknown roles or steps make ``valid`` false, the conversation is
still formatted in full. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.base import quoted


@dataclass(frozen=True)
class ChatTemplate:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    between: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    # state -> roles that may come next; a conversation may end in any state of `final`
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user", "tool"),
        "tool": ("assistant",),
    })
    final: tuple[str, ...] = ("user", "assistant")


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Undo :func:`escape_role`: an even run of backslashes is halved, ``\\n`` after one is a line break."""
    nl = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(nl, F.lit("\\\\"), F.lit("\\")))


def run_machine(roles: Column, template: ChatTemplate) -> Column:
    """Struct(valid, bad_turn): the machine's verdict over an array of roles;
    ``bad_turn`` is the first turn without an allowed step, else null."""
    steps = F.create_map(*[x for s, nxt in sorted(template.steps.items())
                           for x in (F.lit(s), F.array(*map(F.lit, nxt)))])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        ok = F.coalesce(F.array_contains(F.element_at(steps, acc["state"]), role), F.lit(False))
        return F.struct(role.alias("state"), (acc["i"] + 1).alias("i"),
                        F.coalesce(acc["bad"], F.when(~ok, acc["i"])).alias("bad"))

    done = F.aggregate(roles, start, step)
    return F.struct((done["bad"].isNull() & done["state"].isin(*template.final)).alias("valid"),
                    done["bad"].alias("bad_turn"))


def format_conversations(df: DataFrame, template: ChatTemplate = CHATML, conv_id: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, valid, bad_turn, segments (array of
    text and loss flag, in order) and formatted (the segments joined)."""
    empty = F.lit("")
    rows = df.select(quoted(conv_id).alias("conv_id"), F.struct(
        quoted(turn).alias("turn"), F.coalesce(quoted(role), empty).alias("role"),
        F.coalesce(quoted(text), empty).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    conv = conv.withColumn("m", run_machine(F.transform("turns", lambda t: t["role"]), template))

    def emit(t: Column) -> Column:
        def part(s: Column, loss) -> Column:
            return F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.begin), escape_role(t["role"]), F.lit(template.after_role)), F.lit(False)),
            part(escape(t["text"]), t["role"].isin(*template.loss_roles)),
            part(F.lit(template.end + template.between), F.lit(False)))

    conv = conv.withColumn("segments", F.flatten(F.transform("turns", emit)))
    return conv.select("conv_id", F.col("m.valid").alias("valid"), F.col("m.bad_turn").alias("bad_turn"), "segments",
                       F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_formatted(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """The turns (array of role, text) read back from a formatted string."""
    def literal(s: str) -> str:
        return "\\Q" + s + "\\E"

    body = F.substring(formatted, F.lit(1 + len(template.begin)),
                       F.length(formatted) - len(template.begin) - len(template.end + template.between))
    parts = F.split(body, literal(template.end + template.between + template.begin), -1)

    def turn(p: Column) -> Column:
        at = F.instr(p, template.after_role)
        return F.struct(unescape_role(F.substring(p, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substring(p, at + len(template.after_role), F.length(p))).alias("text"))

    return F.when(F.length(formatted) == 0, F.array().cast("array<struct<role:string,text:string>>")).otherwise(
        F.transform(parts, turn))


def chat_digest(df: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Counts and hashes read back from the formatted conversations of ``df``."""
    out = format_conversations(df, template).withColumn("back", parse_formatted(F.col("formatted"), template))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
