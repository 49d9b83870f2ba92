"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

DataFrame functions only. A conversation's rows are put in the order of turn (nulls
first; ties by role, then text), texts are escaped so that no control string of the
template can stand in one, and each turn gives three segments: opening mark, text,
closing mark, each with its loss flag. `read_back` parses the formatted text again.

Null texts and roles are empty; null conversation ids are one conversation. Repeated
rows are repeated turns. Wrong turn orders are formatted too, with valid = false and
the first wrong turn. All rows of one conversation meet in one task, as its digests
need its text in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, control strings' escapes, roles under loss, the machine's moves and its end states.

    `escapes` is applied from first to last: its first pair frees the escape character itself.
    """

    open_turn: str = "<|"
    open_text: str = "|>\n"
    close: str = "<|end|>\n"
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("|", "&vert;"))
    loss_roles: tuple[str, ...] = ("assistant",)
    loss_on_close: bool = False
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), self.escapes, text)

    def unescape(self, text: Column) -> Column:
        return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(self.escapes), text)


def formatted(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, segments (role, text, loss), formatted, valid, first_wrong_turn (from 0)."""
    empty = F.lit("")
    rows = df.select(F.col(conv).alias("__conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text")).alias("__turn"))
    turns = rows.groupBy("__conv").agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))

    def segments(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        piece = lambda s, flag: F.struct(t["role"].alias("role"), s.alias("text"), flag.alias("loss"))
        mark = F.concat(F.lit(template.open_turn), template.escape(t["role"]), F.lit(template.open_text))
        return F.array(piece(mark, F.lit(False)), piece(template.escape(t["text"]), loss), piece(F.lit(template.close), loss & template.loss_on_close))

    allowed = F.create_map(*[x for state, to in template.moves.items() for x in (F.lit(state), F.array(*map(F.lit, to)))])
    # The state is the last role; the machine stops at the first turn for which no move leads on.
    state = F.struct(F.lit("").alias("role"), F.lit(0).alias("at"), F.lit(-1).alias("wrong"))
    moved = lambda s, r: F.struct(
        r.alias("role"),
        (s["at"] + 1).alias("at"),
        F.when(s["wrong"] >= 0, s["wrong"]).when(F.coalesce(F.array_contains(F.try_element_at(allowed, s["role"]), r), F.lit(False)), F.lit(-1)).otherwise(s["at"]).alias("wrong"),
    )
    run = F.aggregate(F.transform("__turns", lambda t: t["role"]), state, moved)
    out = turns.select("__conv", F.flatten(F.transform("__turns", segments)).alias("segments"), run.alias("__run"))
    return out.select(
        F.col("__conv").alias(conv),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ((F.col("__run.wrong") < 0) & F.col("__run.role").isin(*template.final)).alias("valid"),
        F.when(F.col("__run.wrong") >= 0, F.col("__run.wrong").cast("long")).alias("first_wrong_turn"),
    )


def read_back(df: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """conv, turns (role, text), loss_text, formatted_chars, valid, first_wrong_turn; turns and the text under loss are parsed from the formatted text alone."""
    literal = lambda s: "\\Q" + s + "\\E"
    # split() leaves an empty string after the last closing mark.
    parts = F.filter(F.split(F.col("formatted"), literal(template.close), -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.split(F.substr(p, F.lit(len(template.open_turn) + 1)), literal(template.open_text), 2)
        return F.struct(template.unescape(head[0]).alias("role"), template.unescape(head[1]).alias("text"))

    turns = F.transform(parts, turn)
    under_loss = F.filter(turns, lambda t: t["role"].isin(*template.loss_roles))
    return df.select(
        conv,
        turns.alias("turns"),
        F.array_join(F.transform(under_loss, lambda t: t["text"]), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_wrong_turn",
    )
