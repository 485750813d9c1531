"""Chat formatting: a role automaton and a declarative template, all in column expressions.

One row per conversation comes out: whether its roles follow the automaton, the formatted text, and the
text as segments that each say whether they count for the loss. Control strings inside a text are escaped
with a backslash; :func:`parse` reads turns back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. A turn is header, escaped text, ``close``."""

    headers: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other_header: tuple[str, str] = ("### @", ": ")  # around the escaped name of any other role
    close: str = " </turn>\n"
    #: control strings and what stands for them inside a text; a backslash itself is doubled first
    escapes: dict[str, str] = field(default_factory=lambda: {"</turn>": "<\\/turn>", "###": "\\###"})
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state and role to next state; an absent pair is a fault
    steps: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    accepting: tuple[str, ...] = ("assistant",)


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, template: Template) -> Column:
    return reduce(lambda t, kv: _swap(t, *kv), template.escapes.items(), _swap(text, "\\", "\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, valid, fault_turn, final_state, segments(text, loss), formatted.

    Turns stand in the order of turn, role, text, nulls first; equal rows all stay. A null role or text is
    empty. A conversation with a null id is one of its own. ``fault_turn`` is the index of the first turn
    that the automaton refuses; ``valid`` also asks for an accepting end. Invalid conversations are formatted
    all the same. A conversation is one value, so it must fit in a row; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    gathered = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    step = F.create_map(*[F.lit(x) for (state, by), to in template.steps.items() for x in (f"{state}\n{by}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("fault"), F.lit(0).alias("at"))

    def advance(now: Column, turn: Column) -> Column:
        to = F.element_at(step, F.concat(now["state"], F.lit("\n"), turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("fault")).alias("state"),
            F.coalesce(now["fault"], F.when(to.isNull(), now["at"])).alias("fault"),
            (now["at"] + 1).alias("at"))

    def header(turn: Column) -> Column:
        before, after = template.other_header
        other = F.concat(F.lit(before), _swap(escape(turn["role"], template), ":", "\\:"), F.lit(after))
        known = [F.when(turn["role"] == r, F.lit(h)) for r, h in template.headers.items()]
        return F.coalesce(*known, other)

    def written(turn: Column) -> Column:
        plain = F.lit(False)
        return F.array(
            F.struct(header(turn).alias("text"), plain.alias("loss")),
            F.struct(escape(turn["text"], template).alias("text"), turn["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), plain.alias("loss")))

    walked = gathered.withColumn("_end", F.aggregate("turns", start, advance)).withColumn(
        "segments", F.flatten(F.transform("turns", written)))
    return walked.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        (F.col("_end.fault").isNull() & F.col("_end.state").isin(*template.accepting)).alias("valid"),
        F.col("_end.fault").alias("fault_turn"), F.col("_end.state").alias("final_state"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns as an array of (role, text), read from the formatted text alone."""
    # an escaped text has no close mark in it, so the mark ends a turn wherever it stands
    pieces = F.filter(F.split(formatted, "\\Q" + template.close + "\\E"), lambda p: p != "")
    before, after = template.other_header
    other = rf"(?s)^\Q{before}\E([^\\:]*+(?:\\.[^\\:]*+)*+)\Q{after}\E"  # possessive: no step back, and no recursion

    def read(piece: Column) -> Column:
        known = [F.when(piece.startswith(h), F.lit(r)) for r, h in template.headers.items()]
        sizes = [F.when(piece.startswith(h), F.lit(len(h))) for h in template.headers.values()]
        role = F.coalesce(*known, unescape(F.regexp_extract(piece, other, 1)))
        size = F.coalesce(*sizes, F.length(F.regexp_extract(piece, other, 0)))
        return F.struct(role.alias("role"), unescape(F.substr(piece, size + 1)).alias("text"))

    return F.transform(pieces, read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
