"""Chat formatting from event logs, in SQL expressions.

A log has one row per event of a conversation: its sequence number, the turn it
concerns, and what it does (``append`` a streamed delta, ``replace`` the text by
an edit, ``regenerate`` it: what came before is dropped, and deltas follow).
Logs are partitioned by conversation and folded in order; a turn's text is all
deltas since its last edit or regeneration. Messages are then rendered.

The template marks turns by ``<|turn|>role<|text|>...<|end|>`` and a line feed.
Inside roles and texts, a backslash is doubled, and one is put after the first
character of every control string; taking the character after each backslash
undoes both. A conversation is a list of segments, each under the loss mask or
not; joined, they are the formatted text.

A conversation's events meet in runs of turns first and as rendered runs then,
so a very long one is not sorted and rendered row by row in one task.

Nulls: a null text or role is empty; a null sequence number or turn comes first,
and a null conversation is one of its own. Ties in order go by turn, role and text;
repeated turns of a table are kept (``log_of``), repeated events of a log are events
each. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that common chat templates give a meaning.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
#: Turns in a run.
RUN = 256


def escape(text: Column) -> Column:
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({heads})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def log_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The event log of a table with one row a turn: ``conv, turn, message, copy, seq, role, text, op``.

    A message is streamed in two deltas; those of the assistant begin with a draft that is regenerated. Repeated
    turns are messages of their own, told apart by ``message`` (a hash of role and text, and of which is null) and ``copy``.
    """
    rows = turns.groupBy(F.col(conv).alias(conv), F.col(turn).alias(turn), F.col(role).alias(role), F.col(text).alias(text)).agg(F.count("*").cast("int").alias("copy"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copy")))).withColumn("message", F.xxhash64(F.col(role).isNull(), role, F.col(text).isNull(), text))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda seq, text, op: F.struct(F.lit(seq).cast("long").alias("seq"), text.alias("text"), F.lit(op).alias("op"))
    deltas = F.array(event(3, F.left(text, half), "append"), event(4, F.substring(text, half + 1, F.length(text)), "append"))
    events = F.when(F.col(role) == "assistant", F.concat(F.array(event(1, F.left(text, half), "append"), event(2, F.lit(""), "regenerate")), deltas)).otherwise(deltas)
    return rows.withColumn("_e", F.explode(events)).select(conv, turn, "message", "copy", role, "_e.seq", F.col("_e.text").alias(text), "_e.op")


def fold_events(
    events: DataFrame, conv: str = "conv_id", seq: str = "seq", turn: str = "turn", role: str = "role", text: str = "text", op: str = "op", parts: tuple[str, ...] = (),
) -> DataFrame:
    """The final messages: ``conv, turn, role, text``, one row a message.

    A message is a turn, or what ``parts`` tell apart in one. A regeneration or an edit starts its text anew; its role is the last one given.
    """
    message = [conv, turn, *parts]
    order = Window.partitionBy(*message).orderBy(F.asc_nulls_first(seq), F.asc_nulls_first(role), F.asc_nulls_first(text))
    starts = F.sum(F.col(op).isin("replace", "regenerate").cast("int"))
    names = dict.fromkeys([*message, seq, role, text, op])
    marked = events.select(*names).withColumn("_at", F.row_number().over(order)).withColumn("_life", F.coalesce(starts.over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    lives = marked.groupBy(*message, "_life").agg(
        F.sort_array(F.collect_list(F.struct("_at", F.coalesce(text, F.lit("")).alias("t")))).alias("parts"), F.max_by(role, F.when(F.col(role).isNotNull(), F.col("_at"))).alias("_role"),
    )
    final = lives.groupBy(*message).agg(F.max_by("parts", "_life").alias("parts"), F.max_by("_role", F.when(F.col("_role").isNotNull(), F.col("_life"))).alias("_role"))
    return final.select(conv, turn, F.col("_role").alias(role), F.array_join(F.transform("parts", lambda p: p.t), "").alias(text))


def render(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``conv, segments``: runs of formatted text, each with ``text`` and ``loss`` (under the loss mask)."""
    safe_role, safe = escape(F.coalesce(F.col(role), F.lit(""))), escape(F.coalesce(F.col(text), F.lit("")))
    head, loss = F.concat(F.lit(TURN), safe_role, F.lit(TEXT)), F.coalesce(F.col(role) == loss_role, F.lit(False))
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), safe.alias("text"), head.alias("head"), loss.alias("loss"))
    runs = messages.groupBy(F.col(conv).alias(conv), F.floor(F.col(turn).cast("double") / RUN).alias("_run")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    segments = lambda r: F.when(
        r.loss, F.array(F.struct(r["head"].alias("text"), F.lit(False).alias("loss")), F.struct(r["text"].alias("text"), F.lit(True).alias("loss")), F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
    ).otherwise(F.array(F.struct(F.concat(r["head"], r["text"], F.lit(END + "\n")).alias("text"), F.lit(False).alias("loss"))))
    runs = runs.select(conv, "_run", F.flatten(F.transform("rows", segments)).alias("segments"))
    whole = runs.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("_run", "segments"))).alias("runs"))
    return whole.select(conv, F.flatten(F.transform("runs", lambda r: r.segments)).alias("segments"))


def format_chats(events: DataFrame, parts: tuple[str, ...] = (), **names: str) -> DataFrame:
    """Fold a log and render it."""
    conv, turn, role, text = (names.get(k, d) for k, d in (("conv", "conv_id"), ("turn", "turn"), ("role", "role"), ("text", "text")))
    return render(fold_events(events, parts=parts, **names), conv, turn, role, text)


def read_back(rendered: DataFrame, conv: str = "conv_id") -> DataFrame:
    """From the output alone: turns as they were, the text under the loss mask, and digests of both."""
    formatted = F.array_join(F.transform("segments", lambda s: s.text), "")
    turns = F.filter(F.split("formatted", f"{re.escape(END)}\n"), lambda t: t != "")
    parts = F.transform(turns, lambda t: F.split(F.substr(t, F.lit(len(TURN) + 1)), re.escape(TEXT)))
    said = F.transform(parts, lambda p: F.concat(unescape(p[0]), F.lit("\n"), unescape(p[1]), F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), "")
    read = rendered.select(conv, "segments", formatted.alias("formatted"), loss.alias("loss_text")).withColumn("turns", said)
    return read.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
