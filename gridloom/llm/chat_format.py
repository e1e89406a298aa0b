"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conv_id, seq, message, kind, role, text). Kinds: `delta` appends its text to its message, `edit` replaces
what the message said so far, `regenerate` discards it. `fold_events` gives each message its final text, `render` writes a
conversation with a template that escapes control strings, and `read_back` undoes it.

Defined results: null text and role are empty; null kind is a delta; events of equal seq apply edits and regenerations first
(of several, the greatest text wins), then deltas by text; messages order by their number, null first; a message of which
nothing but regenerations remains is an empty text. A null conv_id is a conversation of its own. Extra columns are ignored. Empty input
gives no rows.

Scale: a log is folded to messages by (conv_id, message), so a hot conversation's deltas are spread by message, and only finished
messages are gathered by conversation, whose formatted text is one row by definition. Where the log is made from a table of turns, its
numbering has dealt the rows by conv_id already, and Spark keeps that single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|n|>"


def escape(text: Column) -> Column:
    """Every `<|` of a text becomes `<||`; the template's own marks never have `|` there, so none can occur in the result."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    """As escape; a line break, which ends the role in the template, becomes a mark."""
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of a log."""
    kind, text = F.coalesce("kind", F.lit("delta")), F.coalesce("text", F.lit(""))
    resets = kind.isin("edit", "regenerate")
    reset = F.when(resets, F.struct("seq", F.when(kind == "edit", text).otherwise("").alias("text")))
    delta = F.when(~resets, F.struct("seq", text.alias("text")))
    last = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))
    folded = events.groupBy("conv_id", "message").agg(F.max(reset).alias("reset"), F.sort_array(F.collect_list(delta)).alias("deltas"), last.alias("last"))
    later = F.filter("deltas", lambda d: F.col("reset").isNull() | F.col("reset.seq").isNull() | (d["seq"] >= F.col("reset.seq")))
    final = F.concat(F.coalesce("reset.text", F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    return folded.select("conv_id", "message", F.coalesce("last.role", F.lit("")).alias("role"), final.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the template's text and the spans (start, length in code points) of assistants' texts."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    parts = messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body")).withColumn("out", F.concat("head", "body", F.lit(END + "\n")))
    upto = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.char_length("out")).over(upto) - F.char_length("out") + F.char_length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.char_length("body").alias("length")))
    spans = parts.select("conv_id", "message", "out", span.alias("span"))
    gathered = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "out", "span"))).alias("all"))
    loss = F.filter(F.transform("all", lambda m: m["span"]), lambda s: s.isNotNull())
    return gathered.select("conv_id", F.array_join(F.transform("all", lambda m: m["out"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns (role, text) and the text under the loss mask, unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 2 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1, s["length"])))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: each row one message of one delta; repeated turns order by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    number = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", number.alias("message"), "role", "text").selectExpr("conv_id", "message", "message seq", "'delta' kind", "role", "text")
