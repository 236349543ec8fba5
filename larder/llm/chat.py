"""Chat formatting by event-sourced reconstruction.

A log has one row per event: conv_id, seq, msg_id, kind, role, text. The log is dealt by conversation, sorted by seq and
folded per message:

* `message`, `edit` and `regenerate` set the message's text (dropping what it had),
* `delta` appends a streamed piece,
* `delete` removes the message.

A message stands where its first event stands; its role is the latest one given. Messages are then rendered as
`<|im_start|>role\\ntext<|im_end|>\\n`. Inside texts a backslash goes between `<` (and any backslashes) and `|`, so no
control string can come from a text and the escape can be undone exactly; roles are percent-encoded.

One exchange by conv_id serves every step. A conversation becomes one row, so a very long one must fit a row (2 GB) and its
task's memory; turns of other conversations don't matter to it.

Defined cases: null text is empty, null role is "", null kind is `message`. Events with equal seq are ordered by msg_id,
kind, role and text. A conversation whose messages were all deleted gives no row. Repeated rows of a turn table are
turns of their own. Null conv_id is a conversation of its own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import let

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log in which each row of a turn table (conv_id, turn, role, text) is one whole message."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text").select(
        "conv_id", "seq", F.col("seq").alias("msg_id"), F.lit("message").alias("kind"), "role", "text"
    )


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, first_seq, msg_id, role, text): the final messages."""
    log = events.select("conv_id", "seq", "msg_id", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    # partitioned by conversation first, so that the groups below need no exchange of their own
    per_message = log.repartition("conv_id").groupBy("conv_id", "msg_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("e"))
    latest = F.array_max(F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i)))
    live = F.slice(F.col("e"), F.coalesce(latest, F.lit(0)) + 1, F.size("e"))
    role = F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("e", lambda x: x["role"].isNotNull()), lambda x: x["role"])), -1)
    return per_message.filter(F.coalesce(F.get("e", latest)["kind"], F.lit("delta")) != "delete").select(
        "conv_id", F.get("e", F.lit(0))["seq"].alias("first_seq"), "msg_id", role.alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text")
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (UTF-8 byte offsets of the texts to learn)."""
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    pieces = messages.select("conv_id", "first_seq", "msg_id", (F.col("role") == loss_role).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    tail = END + "\n"
    order = Window.partitionBy("conv_id").orderBy("first_seq", "msg_id")
    whole = F.octet_length("head") + F.octet_length("body") + len(tail)
    end = F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(tail)
    placed = pieces.withColumn("end", end).withColumn("start", F.col("end") - F.octet_length("body"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "loss", "head", "body"))).alias("p"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a rendered conversation holds."""
    return F.transform(
        F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda m: m != ""),
        lambda m: F.struct(F.url_decode(F.substring_index(m, "\n", 1)).alias("role"), unescape(F.regexp_replace(F.regexp_replace(m, r"\A[^\n]*\n", ""), r"<\|im_end\|>\n\z", "")).alias("text")),
    )


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped. `formatted` is read as bytes, so a span costs its own length."""
    return let(formatted, lambda b: F.transform(spans, lambda s: unescape(F.decode(F.substring(b, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "utf-8"))))
