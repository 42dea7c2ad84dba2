"""Chat formatting from event logs: fold a conversation's events into messages, then render them.

Events are rows (conv_id, message, seq, kind, role, text).  `message` names a
message of the conversation and orders the messages; `seq` orders the events.
Kinds:

* `open`        starts the message and gives its role;
* `delta`       appends text;
* `edit`        replaces all text so far;
* `regenerate`  drops all text so far; the deltas that follow are the new draft;
* `delete`      withdraws the message.

The fold keeps, per message, what stands from its last edit or regeneration on,
joined in the order of seq.  Events are combined per message first and messages
per conversation next, so that a long conversation is split as far as its one
rendered text allows.  All of it is column functions.

Rendering.  A turn is `<|turn|>` role `<|text|>` text `<|end|>` and a line break.
Control strings (these and those of other common templates) are broken inside
roles and texts by a backslash after their first character; backslashes are
doubled.  Removing one backslash before every character gives the text back.
`loss_spans` are the code point ranges of the assistant texts.

Defined results: null roles and texts are empty; a null conv_id is a conversation
of its own.  Messages without `open` have an empty role.  Events of one message
with equal seq are ordered by kind and text; repeated events count again (logs
that deliver twice are to be deduplicated by their event id before).  Unknown
kinds are ignored.  Empty tables give empty results; other columns are ignored.
A rendered conversation is one value, so it is bounded by what a row can hold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: control strings of this template and of other common ones -------
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
            "<|system|>", "<|user|>", "<|assistant|>", "<start_of_turn>", "<end_of_turn>"]
# --- end of fixed values ------------------------------------------------------------
LEARNED_ROLE = "assistant"


def _escape_pattern() -> str:
    by_first: dict[str, list[str]] = {}
    for c in CONTROLS:
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(rf"{re.escape(first)}(?={'|'.join(rest)})" for first, rest in by_first.items())


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_escape_pattern()})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_messages(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: one row per message that stands."""
    resets = F.col("kind").isin("edit", "regenerate")
    texts = F.col("kind").isin("delta", "edit", "regenerate")
    opened = F.col("kind") == "open"
    per_message = events.groupBy("conv_id", "message").agg(
        F.max_by("role", F.when(opened, F.struct("seq", "role"))).alias("role"),
        F.max(F.when(resets, F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("reset"),
        F.max(F.col("kind") == "delete").alias("gone"),
        F.collect_list(F.when(texts, F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("pieces"))
    since = F.filter(F.array_sort("pieces"), lambda e: F.col("reset").isNull() | (e >= F.col("reset")))
    said = F.transform(since, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
    return per_message.filter("NOT gone").select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(said, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start and length in code points) of messages(conv_id, message, role, text)."""
    turns = messages.select(
        "conv_id", "message", (F.col("role") == LEARNED_ROLE).alias("learned"),
        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)).alias("head"), escaped(F.col("text")).alias("body"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("message", "learned", "head", "body"))).alias("turns"))
    tail = END + "\n"
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    # Each span starts after all earlier turns and its own head.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.char_length(t["head"])
        length = F.char_length(t["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), length.alias("length")))
        return F.struct((begin + length + len(tail)).alias("at"),
                        F.when(t["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("turns", start, step)["spans"]
    return listed.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation as an array of (role, text)."""
    pattern = rf"(?s){re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}\n"
    roles = F.regexp_extract_all(formatted, F.lit(pattern), 1)
    texts = F.regexp_extract_all(formatted, F.lit(pattern), 2)
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescaped(r).alias("role"), unescaped(t).alias("text")))


def format_events(events: DataFrame) -> DataFrame:
    return render(fold_messages(events))


def conversation_events(rows: DataFrame) -> DataFrame:
    """An event log whose fold gives rows(conv_id, turn, role, text) back, streamed the way a chat server would.

    Each message is opened, a first half is streamed, then an assistant's draft is
    regenerated and a user's is edited, and the text is streamed again in pieces.
    Rows of one turn are ordered by role and digest; equal rows are separate messages.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    counted = rows.groupBy("conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest")).agg(
        F.count("*").alias("copies"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    message = F.struct("turn", "role", "digest", "copy").alias("message")
    n = F.char_length("text")
    piece = F.greatest(F.lit(1), F.ceil(n / 4).cast("int"))
    event = lambda seq, kind, said: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))
    none = F.lit("")
    learned = F.col("role") == LEARNED_ROLE
    opening = F.array(event(F.lit(0), "open", none), event(F.lit(1), "delta", F.substr("text", F.lit(1), n / 2)))
    again = F.when(learned, F.array(event(F.lit(2), "regenerate", none))).otherwise(
        F.array(event(F.lit(2), "edit", F.substr("text", F.lit(1), piece))))
    first = F.when(learned, F.lit(0)).otherwise(F.lit(1))
    stream = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: (i >= first) & (i * piece < n)),
                         lambda i: event(i + 3, "delta", F.substr(F.col("text"), i * piece + 1, piece)))
    log = each.select("conv_id", message, "role", F.inline(F.concat(opening, again, stream)))
    return log.select("conv_id", "message", "seq", "kind", F.when(F.col("kind") == "open", F.col("role")).alias("role"), "text")
