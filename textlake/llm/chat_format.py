"""Chat formatting: a finite-state machine over roles, driven by a declarative template, in DataFrame operations only.

The template names the states: what a turn that enters a state is surrounded with, whether its text is trained on, and by
which role each state is left for which. One fold over a conversation's roles runs the machine; the state that each turn enters
makes its segments (opening mark, text, closing mark) and their loss flags, and the last state tells whether the turns are in
order. A role that the present state does not accept leads to the same role's state, and the conversation is rejected.

Inside texts and role names `&`, `<` and (role names) line feeds are written as `&amp;`, `&lt;` and `&#10;`: as every control
string of a template begins with `<`, no text can hold one, and `parse` gives each text back unchanged.

Defined cases
    null text: empty.        null role: the empty role.       a role that the template does not name: formatted like any
    other, without loss; the conversation is then not valid.      null turn: before all others.
    equal turn numbers: in order of role, then text; repeated rows are repeated turns.
    null conv_id: one conversation with a null id.       empty table: empty result.        extra columns: ignored.
    very long conversations: a conversation is one output row, so its turns meet in one row by definition; states are read in
    stretches, places come from a running sum and masked text from the segments, so the work follows the length.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: open and close surround a role's name and text; `after` lists the roles that may follow which ('' is the start) and
#: `loss` the roles whose text is trained on.
TEMPLATE: Mapping = {
    "open": "<|turn|>",
    "name_end": "\n",
    "close": "<|end|>\n",
    "loss": ["assistant"],
    "after": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "final": ["assistant"],
}


#: Turns that the machine reads into one trace.
STRETCH = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_name(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_name(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def _check(template: Mapping) -> None:
    for mark in (template["open"], template["close"]):
        if not mark.startswith("<"):
            raise ValueError("control strings begin with '<', which texts never hold once escaped")


class _Machine:
    """States are single characters: the start, one for each role of the template, and one for all other roles. A lower-case
    state is that of an accepted conversation so far, an upper-case one that of a rejected conversation."""

    OTHER, START = "y", "z"

    def __init__(self, template: Mapping):
        roles = sorted({*template["after"], *(r for v in template["after"].values() for r in v), *template["loss"]} - {""})
        if len(roles) > 24:
            raise ValueError("a template has 24 roles at most")
        self.state = {r: chr(ord("a") + i) for i, r in enumerate(roles)}
        edges = {self.state.get(a, self.START) + self.state[b] for a, v in template["after"].items() for b in v}
        self.edges = F.array(*map(F.lit, sorted(edges)))
        self.enter = F.create_map(*[F.lit(x) for item in self.state.items() for x in item]) if roles else F.lit(None).cast("map<string,string>")
        self.loss = [s for r in template["loss"] for s in (self.state[r], self.state[r].upper())]
        self.final = [self.state[r] for r in template["final"]]

    def run(self, roles: Column) -> Column:
        """The states that the turns enter, one character each. A stretch of turns at a time: a trace that grows by one character
        is copied each time, so each stretch has its own."""

        def step(acc: Column, role: Column) -> Column:
            to = F.coalesce(F.try_element_at(self.enter, role), F.lit(self.OTHER))
            accepted = F.array_contains(self.edges, F.concat(acc["state"], to))  # no edge leaves an upper-case state
            state = F.when(accepted, to).otherwise(F.upper(to))
            return F.struct(state.alias("state"), F.concat(acc["trace"], state).alias("trace"))

        def stretch(acc: Column, own: Column) -> Column:
            start = F.struct(acc["state"].alias("state"), F.lit("").cast("string").alias("trace"))
            done = lambda x: F.struct(x["state"].alias("state"), F.array_append(acc["traces"], x["trace"]).alias("traces"))
            return F.element_at(F.transform(F.array(F.aggregate(own, start, step)), done), 1)

        places = F.sequence(F.lit(0), F.floor(F.size(roles) / STRETCH).cast("int"))
        start = F.struct(F.lit(self.START).alias("state"), F.array().cast("array<string>").alias("traces"))
        stretches = F.transform(places, lambda i: F.slice(roles, i * STRETCH + 1, STRETCH))
        return F.array_join(F.aggregate(stretches, start, stretch)["traces"], "")


def format_chats(conversations: DataFrame, template: Mapping = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, valid, formatted, segments array<struct<text, loss>>, loss_spans
    array<struct<start, length>>.

    The segments' texts, joined, are `formatted`; those with `loss` are trained on. `start` counts code points of
    `formatted` from 0.
    """
    _check(template)
    machine = _Machine(template)
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.concat(F.lit(template["open"]), _escape_name(F.col("role")), F.lit(template["name_end"]))
    turns = turns.select("conv_id", "turn", "role", "text", before.alias("before"), escape(F.col("text")).alias("inside"))
    size = (F.length("before") + F.length("inside") + len(template["close"])).cast("bigint")
    turns = turns.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("place"), "role", "before", "inside",
            (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("before")).alias("start"),
        ).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.withColumn("trace", machine.run(F.transform("turns", lambda t: t["role"])))
    segments = F.transform(
        F.arrays_zip(F.col("turns"), F.split("trace", "").alias("states")),
        lambda x: F.struct(
            x["turns"]["before"].alias("before"), x["turns"]["inside"].alias("inside"), x["states"].isin(*machine.loss).alias("loss"),
            x["turns"]["start"].cast("int").alias("start"), F.length(x["turns"]["inside"]).alias("length"),
        ),
    )
    chats = chats.select("conv_id", F.substring("trace", -1, 1).isin(*machine.final).alias("valid"), segments.alias("turns"))
    spans = F.transform(F.filter("turns", lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    part = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    close = F.lit(template["close"])
    cut = F.flatten(
        F.transform(
            "turns",
            lambda s: F.when(s["loss"], F.array(part(s["before"], False), part(s["inside"], True), part(close, False))).otherwise(
                F.array(part(F.concat(s["before"], s["inside"], close), False))
            ),
        )
    )
    chats = chats.select("conv_id", "valid", cut.alias("segments"), spans.alias("loss_spans"))
    return chats.select("conv_id", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "loss_spans")


def parse(formatted: Column, template: Mapping = TEMPLATE) -> Column:
    """The turns of a formatted chat: array<struct<role, text>>."""
    size = len(template["open"])
    chunks = F.split(formatted, _quoted(template["close"]))
    chunks = F.slice(chunks, 1, F.size(chunks) - 1)  # after the last closing mark nothing follows

    def turn(chunk: Column) -> Column:
        at = F.instr(chunk, template["name_end"])
        role = F.substring(chunk, F.lit(size + 1), at - size - 1)
        return F.struct(
            _unescape_name(role).alias("role"),
            unescape(F.substring(chunk, at + len(template["name_end"]), F.length(chunk))).alias("text"),
        )

    return F.transform(chunks, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"
