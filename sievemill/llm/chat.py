"""Chat formatting by a declarative template, with built-in functions only.

Roles drive a finite-state machine: from the state of the turn before, a role leads to a state or to an error.
Each turn becomes three segments (marker, text, marker), each with a loss flag, in the order of the output.
Control strings inside texts are broken up by a backslash, and backslashes are doubled, so the output can
be read back whatever the texts hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers of each role, the fallback for other roles, and the machine ``(state, role) -> state``.

    Each marker's ``after`` ends the turn, so it must be a control string and unique to its role.
    """

    start: str = "<s>"
    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS] ", " [/SYS]"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn(" ", " </s>", loss=True),
        }
    )
    #: Any other role: its name, URL-encoded, stands behind the marker.
    other: Turn = Turn("[ROLE] ", " [/ROLE]")
    null_role: str = "\\0"
    machine: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        found = {self.start}
        for t in [*self.turns.values(), self.other]:
            found |= {m.strip() for m in (t.before, t.after) if m.strip()}
        return sorted(found, key=lambda c: (-len(c), c))


def escape(text: Column, template: Template) -> Column:
    """Doubles backslashes, then puts one behind the first character of each control string."""
    controls = template.controls()
    firsts = "".join(sorted({re.escape(c[0]) for c in controls}))
    rests = "|".join(re.escape(c[1:]) for c in controls)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"([{firsts}])({rests})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(
    conversations: DataFrame,
    template: Template = Template(),  # noqa: B008  frozen
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each conversation: conv_id, formatted, segments array<struct<text, loss>>, valid, error_turn.

    Turns are ordered by turn (nulls first), then role and text, so repeated turns keep a fixed order.
    Null text is empty. A null role and roles without a turn of their own use the fallback marker and make
    the conversation invalid, as does any step the machine lacks or a last state that is not final;
    ``error_turn`` is the first bad turn's place from 0, or the number of turns when only the end is bad.
    A row without a conv_id is a conversation of its own, so such rows are never gathered. A conversation is one row of the
    result, so its turns meet in one task. Invalid conversations are formatted all the same.
    Other columns, of any name, are not read. An empty table gives no rows.
    """
    t = template
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("row"),
    )
    lone = rows.filter("conv_id is null").select("conv_id", F.array("row").alias("rows"))
    grouped = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows")).unionByName(lone)

    def by_role(r: Column, known, other) -> Column:
        out = None
        for role, turn in t.turns.items():
            out = (F if out is None else out).when(r["role"] == role, known(turn))
        return out.otherwise(other)

    def segments(r: Column) -> Column:
        name = F.coalesce(F.url_encode(r["role"]), F.lit(t.null_role))
        opened = by_role(r, lambda x: F.lit(x.before), F.concat(F.lit(t.other.before), name, F.lit("\n")))
        closed = by_role(r, lambda x: F.lit(x.after), F.lit(t.other.after))
        loss = by_role(r, lambda x: F.lit(x.loss), F.lit(t.other.loss))
        no = F.lit(False)
        return F.array(
            F.struct(opened.alias("text"), no.alias("loss")),
            F.struct(escape(r["text"], t).alias("text"), loss.alias("loss")),
            F.struct(closed.alias("text"), no.alias("loss")),
        )

    moves = F.create_map(*[F.lit(x) for (state, role), to in t.machine.items() for x in (f"{state}\n{role}", to)])

    def step(acc: Column, r: Column) -> Column:
        to = moves[F.concat(acc["state"], F.lit("\n"), r["role"])]
        bad = acc["bad"].isNotNull() | to.isNull()
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (acc["n"] + 1).alias("n"),
            F.when(acc["bad"].isNotNull(), acc["bad"]).when(bad, acc["n"]).alias("bad"),
        )

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    state = F.aggregate("rows", begin, step)
    return (
        grouped.select(
            "conv_id",
            F.concat(F.array(F.struct(F.lit(t.start).alias("text"), F.lit(False).alias("loss"))), F.flatten(F.transform("rows", segments))).alias("segments"),
            state.alias("state"),
        )
        .select(
            "conv_id",
            F.array_join(F.col("segments.text"), "").alias("formatted"),
            "segments",
            F.coalesce(F.col("state.bad"), F.when(~F.col("state.state").isin(*t.final), F.col("state.n"))).alias("error_turn"),
        )
        .select("conv_id", "formatted", "segments", F.col("error_turn").isNull().alias("valid"), "error_turn")
    )


def read_chat(formatted: Column, template: Template = Template()) -> Column:  # noqa: B008
    """The turns ``array<struct<role, text>>`` read back from the output of ``format_chat``."""
    t = template
    ends = "|".join(f"(?<={re.escape(x.after)})" for x in [*t.turns.values(), t.other])
    body = F.substring(formatted, F.lit(len(t.start) + 1), F.length(formatted))
    pieces = F.filter(F.split(body, ends), lambda p: F.length(p) > 0)

    def turn(p: Column) -> Column:
        role, text = None, None
        for name, x in t.turns.items():
            own = p.endswith(x.after) & p.startswith(x.before)
            role = (F if role is None else role).when(own, F.lit(name))
            text = (F if text is None else text).when(own, _inner(p, x))
        inner = _inner(p, t.other)
        name = F.substring_index(inner, "\n", 1)
        role = role.otherwise(F.when(name != t.null_role, F.url_decode(name)))
        text = text.otherwise(F.substring(inner, F.length(name) + 2, F.length(inner)))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def _inner(p: Column, x: Turn) -> Column:
    return F.substring(p, F.lit(len(x.before) + 1), F.length(p) - len(x.before) - len(x.after))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest_columns(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """The columns of the registered query: turns and loss text read back from the formatted output, the machine's verdict, the flags."""
    learned = [role for role, turn in template.turns.items() if turn.loss]
    lossy = F.array_join(F.transform(F.filter("turns", lambda r: r["role"].isin(*learned)), lambda r: r["text"]), "")
    flags = F.array_join(F.transform("segments", lambda s: F.when(s["loss"], "1").otherwise("0")), "")
    back = formatted.select("conv_id", read_chat(F.col("formatted"), template).alias("turns"), "formatted", "segments", "valid", "error_turn")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda r: F.concat(F.coalesce(r["role"], F.lit("")), F.lit("\n"), r["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(lossy).cast("long").alias("loss_chars"),
        F.sha2(lossy, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("error_turn").cast("long").alias("error_turn"),
        F.sha2(flags, 256).alias("flags_sha256"),
    )
