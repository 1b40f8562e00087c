"""Chat formatting by a finite-state machine over roles, from a declarative template. DataFrame functions only.

A template gives each role an opening and a closing string, whether its text counts for the loss, and the roles that may follow.
Inside texts the escape character and the first character of every control string are written as the escape character and a
digit, so no control string can arise in a text and the output can be parsed without looking at its context.

Turns are taken by turn number, then role, then text. Null text: empty. Null role: the empty role. A role that the template lacks is written
with the template's fallback and makes the conversation invalid, as does a turn out of order; such conversations keep their text and
have `valid` false and the index of their first bad turn. Null conv_id is a conversation of its own. Repeated rows are turns too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    """open, close: texts round a turn, with {role} for its name; loss: the roles that are learned; follows: role -> roles before it."""

    open: str = "### {role}: "
    close: str = " </turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"system": (START,), "user": (START, "system", "assistant"), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant", "user")
    escape: str = "\\"

    @property
    def marks(self) -> list[str]:
        """What is escaped, in order: the escape character itself first."""
        first = [x.lstrip()[0] for x in (self.open, self.close, ": ")]
        return [self.escape, *dict.fromkeys(c for c in first if c != self.escape)]


DEFAULT = Template()


def escaped(text: Column, t: Template) -> Column:
    for i, c in enumerate(t.marks):
        text = F.replace(text, F.lit(c), F.lit(f"{t.escape}{i}"))
    return text


def unescaped(text: Column, t: Template) -> Column:
    for i, c in reversed(list(enumerate(t.marks))):
        text = F.replace(text, F.lit(f"{t.escape}{i}"), F.lit(c))
    return text


def format_chats(rows: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, valid, first_bad, segments array<struct<text, loss>>, formatted (all segments joined)."""
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    allowed = F.create_map(*(x for role, before in t.follows.items() for x in (F.lit(role), F.array(*map(F.lit, before)))))
    # The machine: its state is the last role; a turn that may not follow it is noted, and the machine goes on from there.
    begun = F.struct(F.lit(START).alias("role"), F.lit(0).alias("i"), F.lit(-1).alias("bad"))

    def step(state: Column, turn: Column) -> Column:
        ok = F.coalesce(F.array_contains(F.try_element_at(allowed, turn["role"]), state["role"]), F.lit(False))
        return F.struct(turn["role"].alias("role"), (state["i"] + 1).alias("i"), F.when((state["bad"] < 0) & ~ok, state["i"]).otherwise(state["bad"]).alias("bad"))

    before, after = t.open.split("{role}")

    def segments(turn: Column) -> Column:
        lit = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))
        return F.array(
            lit(F.concat(F.lit(before), escaped(turn["role"], t), F.lit(after))),
            F.struct(escaped(turn["text"], t).alias("text"), turn["role"].isin(*t.loss).alias("loss")),
            lit(F.lit(t.close)),
        )

    run = turns.withColumn("state", F.aggregate("turns", begun, step))
    out = run.select(
        "conv_id",
        ((F.col("state.bad") < 0) & F.col("state.role").isin(*t.ends)).alias("valid"),
        F.when(F.col("state.bad") >= 0, F.col("state.bad")).alias("first_bad"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return out.withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def parse_chats(chats: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """Read turns back from `formatted` alone: adds turns array<struct<role, text>>."""
    before, after = t.open.split("{role}")
    parts = F.split("formatted", "\\Q" + t.close + "\\E", -1)
    bodies = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.substring(p, F.lit(len(before) + 1), F.length(p)))
    at = lambda b: F.locate(after, b) if isinstance(b, str) else F.call_function("locate", F.lit(after), b)
    turn = lambda b: F.struct(unescaped(F.substring(b, F.lit(1), at(b) - 1), t).alias("role"), unescaped(F.substring(b, at(b) + len(after), F.length(b)), t).alias("text"))
    return chats.withColumn("turns", F.transform(bodies, turn))
