"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative template lays out
text segments with a loss flag each. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is laid out, which roles are trained on, and which role may follow which.

    Control strings begin with "<|"; in texts and roles, "<|" with any backslashes in between gets one backslash more,
    so that none can be read as control, and taking one away again restores the text.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role that may come -> next state
    turns: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accepting: tuple[str, ...] = ("answered",)


CHATML = Template()


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _role_escaped(role: Column) -> Column:
    r"""Roles are one line: a backslash is written as \b, a line feed as \l."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\l")))


def _role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\l"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def segments(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, n_turns, valid, segments) for every conversation of turns (conv_id, turn, role, text).

    segments is an array of (text, loss) in order: for every turn its head, its text and its end. Turns are in the
    order of turn, then role and text; null turns come first. Null roles and texts are empty strings; valid says
    whether the machine accepts the roles, and a conversation that it does not accept is formatted all the same. Rows
    with a null conv_id are one conversation; repeated rows are repeated turns; other columns are ignored; an empty
    table gives an empty result. A conversation has to fit one string: one of more than 2 GB fails the job, with
    Spark's error, rather than being cut.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("x"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    edges = [(f"{state}\u0001{role}", to) for state, by in template.turns.items() for role, to in by.items()]
    machine = F.create_map(*[F.lit(v) for edge in edges for v in edge])
    end = F.aggregate("turns", F.lit(template.start), lambda state, t: F.coalesce(F.try_element_at(machine, F.concat(state, F.lit("\u0001"), t["role"])), F.lit("")))

    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    laid = F.flatten(F.transform("turns", lambda t: F.array(part(F.concat(F.lit(template.open), _role_escaped(t["role"]), F.lit(template.after_role)), no), part(escaped(t["text"]), t["role"].isin(*template.trained)), part(F.lit(template.close), no))))
    return convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), end.isin(*template.accepting).alias("valid"), laid.alias("segments"))


def formatted(segs: DataFrame) -> DataFrame:
    """segs with formatted, the segments as one string, and mask, their (chars, bytes, loss) in order."""
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    mask = F.transform("segments", lambda s: F.struct(F.length(s["text"]).alias("chars"), F.octet_length(s["text"]).alias("bytes"), s["loss"].alias("loss")))
    return segs.withColumn("formatted", text).withColumn("mask", mask)


def parsed(text: Column, template: Template = CHATML) -> Column:
    """The (role, text) turns of a formatted conversation."""
    turns = F.slice(F.split(text, r"\Q" + template.open + r"\E", -1), 2, 1 << 30)

    def turn(t: Column) -> Column:
        body = F.substring_index(t, template.close.rstrip("\n"), 1)
        at = F.locate(template.after_role, body)
        return F.struct(_role_unescaped(body.substr(F.lit(1), at - 1)).alias("role"), unescaped(body.substr(at + len(template.after_role), F.length(body))).alias("text"))

    return F.transform(turns, turn)


def under_mask(formatted: Column, mask: Column) -> Column:
    """The stretches of formatted that the mask trains on, in order, unescaped each: cut out by running byte offsets."""
    # the string's bytes go along in the accumulator, so that they are made once and a cut costs what it takes out
    start = F.struct(formatted.cast("binary").alias("all"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, m: Column) -> Column:
        piece = unescaped(F.substring(acc["all"], acc["at"] + 1, m["bytes"]).cast("string"))
        return F.struct(acc["all"].alias("all"), (acc["at"] + m["bytes"]).alias("at"), F.when(m["loss"], F.array_append(acc["parts"], piece)).otherwise(acc["parts"]).alias("parts"))

    return F.aggregate(mask, start, step, lambda acc: F.array_join(acc["parts"], ""))


def read_back(done: DataFrame, template: Template = CHATML) -> DataFrame:
    """done with what formatted and mask say: turns (role, text), and loss, all text under the mask, unescaped.

    Nothing but the string and the mask is read; a conversation without trained text has an empty loss."""
    return done.withColumn("read", parsed(F.col("formatted"), template)).withColumn("loss", under_mask(F.col("formatted"), F.col("mask")))
