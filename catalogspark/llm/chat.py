"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template gives each role an opening and a closing mark and says whether its text carries loss. Marks
that occur inside a text are escaped by one backslash after their first character (runs of backslashes
there grow by one), so reading the output back is exact. The state machine walks the roles of a
conversation in turn order and reports the first turn that no transition allows.

Defined results: null or missing text and role count as empty; a role that the template does not know is
written in the ``other`` frame with its name and is never under loss; ties of turn are ordered by role, then
text, and repeated rows stay; rows with a null conv_id form one conversation; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What each role is framed with, what earns loss, and which role may follow which state."""

    roles: dict = field(
        default_factory=lambda: {
            "system": {"open": "[SYS] ", "close": " [/SYS]\n", "loss": False},
            "user": {"open": "[INST] ", "close": " [/INST]\n", "loss": False},
            "assistant": {"open": "<s> ", "close": " </s>\n", "loss": True},
        }
    )
    other: dict = field(default_factory=lambda: {"open": "[OTHER] ", "name_end": " [AS] ", "close": " [/OTHER]\n"})
    #: state -> role -> next state; a conversation may end in a state listed in final.
    machine: dict = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple = ("answered",)

    def marks(self) -> list[str]:
        frames = [*self.roles.values(), self.other]
        return sorted({f[k].strip() for f in frames for k in ("open", "close", "name_end") if k in f})

    def pattern(self) -> str:
        """A mark with any number of backslashes after its first character."""
        heads = "".join(sorted({re.escape(m[0]) for m in self.marks()}))
        return f"([{heads}])(\\\\*)({'|'.join(re.escape(m[1:]) for m in self.marks())})"


def escaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, t.pattern(), r"$1\\$2$3")


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, t.pattern().replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _turn_segments(turn: Column, t: Template) -> Column:
    """The segments of one turn: opening mark, text, closing mark, each with its loss flag."""
    seg = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    body = escaped(turn["text"], t)
    name = F.concat(F.lit(t.other["open"]), escaped(turn["role"], t), F.lit(t.other["name_end"]))
    out = F.array(seg(name, False), seg(body, False), seg(F.lit(t.other["close"]), False))
    for role, f in t.roles.items():
        known = F.array(seg(F.lit(f["open"]), False), seg(body, f["loss"]), seg(F.lit(f["close"]), False))
        out = F.when(turn["role"] == role, known).otherwise(out)
    return out


def format_chats(df: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn, n_in.

    bad_turn is the ordinal (from 0) of the first turn that the machine refuses, the number of turns
    if only the end is wrong, and null when the order is valid.
    """
    t = template or Template()
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    moves = F.create_map(*[F.lit(x) for s, to in t.machine.items() for r, n in to.items() for x in (f"{s}|{r}", n)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("|"), turn["role"]))
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"])).alias("bad"),
        )

    walked = F.aggregate("turns", start, step)
    out = conv.select("conv_id", F.flatten(F.transform("turns", lambda x: _turn_segments(x, t))).alias("segments"), walked.alias("w"), F.size("turns").alias("n_in"))
    bad = F.coalesce("w.bad", F.when(~F.col("w.state").isin(*t.final), F.col("w.at")))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        bad.isNull().alias("valid"),
        bad.alias("bad_turn"),
        "n_in",
    )


def read_chats(df: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse ``formatted`` back into turns array<struct<role, text, loss>>, unescaped; other columns stay."""
    t = template or Template()
    frames = {f["open"].strip(): (role, f) for role, f in t.roles.items()}
    opens = {**{m: f["close"] for m, (_, f) in frames.items()}, t.other["open"].strip(): t.other["close"]}
    whole = "(?s)(?:" + "|".join(f"(?:{re.escape(o)} .*?{re.escape(c)})" for o, c in opens.items()) + ")"

    def parsed(x: Column) -> Column:
        def between(a: str, b: str) -> Column:
            return x.substr(F.lit(len(a) + 1), F.length(x) - len(a) - len(b))

        inner = between(t.other["open"], t.other["close"])
        at = F.instr(inner, t.other["name_end"])
        out = F.struct(
            unescaped(inner.substr(F.lit(1), at - 1), t).alias("role"),
            unescaped(inner.substr(at + len(t.other["name_end"]), F.length(inner)), t).alias("text"),
            F.lit(False).alias("loss"),
        )
        for role, f in t.roles.items():
            known = F.struct(F.lit(role).alias("role"), unescaped(between(f["open"], f["close"]), t).alias("text"), F.lit(f["loss"]).alias("loss"))
            out = F.when(F.startswith(x, F.lit(f["open"])), known).otherwise(out)
        return out

    found = F.regexp_extract_all("formatted", F.lit(whole), F.lit(0))
    return df.withColumn("turns", F.transform(found, parsed))
