"""Chat formatting from event logs, with DataFrame functions only.

A log holds events of conversations in sequence: a delta adds text to a message, an edit replaces what the
message holds, a regeneration empties it for the deltas that follow. The fold keeps, for each message, the events
from its last edit or regeneration on. Rendering marks turns with control strings and escapes them inside texts,
so that parse() gives back every role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"
#: Code points of a streamed delta at least, and deltas of a text at most.
PIECE, PIECES = 256, 64


def escape(text: Column) -> Column:
    """Backslashes are doubled and "<|" becomes "<\\|", so that no control string is left; unescape() undoes it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As escape(); line feeds, which end a role, become "<\\n"."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the final messages of an event log (conv_id, seq, message, role, kind, text).

    Events of one message are applied in the order of seq, a number or anything else with an order; events with the same
    seq in the order of kind and text. Null texts are empty and null roles stay null; the
    role is that of the message's last event with one. A null conv_id or message is a key like any other. A
    message whose last event empties it stays, with an empty text. Kinds other than the three count as deltas.
    """
    event = F.struct("seq", F.coalesce("kind", F.lit(DELTA)).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"))
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["kind"].isin(EDIT, REGENERATE), i + 1).otherwise(0)), lambda i: i > 0)
    first = F.coalesce(F.array_max(resets), F.lit(1))
    live = F.slice("log", first, F.size("log"))
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"] == REGENERATE, "").otherwise(e["text"])), "")
    return grouped.select("conv_id", "message", "role", text.alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one row for each conversation, its messages in the order of `message`.

    loss_spans are the (start, end) of the trained role's texts in formatted, in code points, end exclusive. A
    null role is written as an empty one.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turn = F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))
    lines = messages.select("conv_id", "message", turn.alias("turn"), (F.coalesce("role", F.lit("")) == trained).alias("loss"), F.length(text).cast("long").alias("n"))
    order = Window.partitionBy("conv_id").orderBy("message", "turn")
    end = F.sum(F.length("turn").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE)
    placed = lines.select("conv_id", F.row_number().over(order).alias("k"), "turn", "loss", (end - F.col("n")).alias("start"), end.alias("end"))
    log = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "turn", "loss", "start", "end"))).alias("log"))
    spans = F.transform(F.filter("log", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return log.select("conv_id", F.array_join(F.transform("log", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text), read back from the formatted string."""
    parts = F.filter(F.split("formatted", "\\Q" + CLOSE + "\\E", -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    at = lambda p: F.instr(body(p), "\n")
    turns = F.transform(parts, lambda p: F.struct(unescape_role(F.substr(body(p), F.lit(1), at(p) - 1)).alias("role"), unescape(F.substr(body(p), at(p) + 1)).alias("text")))
    return formatted.withColumn("turns", turns)


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log, as a chat service keeps it, of a table with a row for each turn; folding it gives the turns back.

    Every row is a message. Its text streams in as deltas of PIECE code points (more in texts above PIECES such), the
    first of which bears the role. A conversation's first message is sent as a draft and then edited to its text; its
    second is begun, regenerated, and streamed anew. Rows of a conversation are ordered by turn, then role and text;
    rows that repeat stay turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("message"), "role", text.alias("text"))
    size = F.greatest(F.lit(PIECE), F.ceil(F.length("text") / PIECES)).cast("int")
    count = F.greatest(F.ceil(F.length("text") / size), F.lit(1)).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.transform(F.sequence(F.lit(0), count - 1), lambda i: event(DELTA, F.substr("text", i * size + 1, size)))
    draft = event(DELTA, F.concat(F.lit("draft "), F.reverse(F.substr("text", F.lit(1), F.lit(PIECE)))))
    edited = F.array(draft, event(EDIT, F.col("text")))
    again = F.concat(F.array(draft, event(REGENERATE, F.lit(None).cast("string"))), deltas)
    sent = F.when(F.col("message") == 1, edited).when(F.col("message") == 2, again).otherwise(deltas)
    log = turns.select("conv_id", "message", "role", F.posexplode(sent).alias("k", "event"))
    role = F.when(F.col("k") == 0, F.col("role")).alias("role")
    return log.select("conv_id", (F.shiftleft("message", 32) + F.col("k")).alias("seq"), "message", role, "event.kind", "event.text")


def format_conversations(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans of a table with columns conv_id, turn, role, text.

    Null texts are empty; null turns come first; a null conv_id makes a conversation of its own; rows that
    repeat are turns each; an empty table gives an empty result; other columns aren't read.
    """
    return render(fold_events(log_of(conversations)), trained)


def digest(formatted: DataFrame, trained: str = "assistant") -> DataFrame:
    """What is read back from the formatted strings: turns, their digest, and all text under the loss mask."""
    lines = F.concat(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"])), "\n"), F.when(F.size("turns") > 0, "\n").otherwise(""))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    read = parse(formatted).select("conv_id", "formatted", "turns", lines.alias("lines"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
