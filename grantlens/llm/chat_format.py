"""Chat formatting by prefix-target expansion: every reply becomes an example of its own.

An example holds all turns up to an assistant turn, and only that turn's text is trainable. Turns are marked
by control strings; what looks like one inside a text is escaped, so that every example can be read back. All
of it is built-in expressions. A conversation is one row while it is expanded, as its last example must be; it
is repeated for one example at a time.

Defined results: a null text is empty, a null role is an empty one; a null turn comes first, and rows of one
turn go by role and then by text, each as often as it occurs; rows without conv_id form one conversation. Only
the role ``assistant``, in these letters, has replies. Turns after the last reply, or all of a conversation
without one, follow in an example that trains nothing, so that no turn is lost. Without rows there are no
examples. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY = "assistant"

# Marks of a turn: before and after its text. A control string starts with a bracket it has nowhere else, so
# that no text and mark can run together into one.
BEGIN = "<s>"
END = "</s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]")}
ROLE, ROLE_TEXT, ROLE_END = "[ROLE]", "[TEXT]", "[/ROLE]"

# A control string, as its bracket and the rest of it.
CONTROL = r"([\[<])(/?(?:INST|SYS|ROLE)\]|TEXT\]|/?s>)"

TURN = (
    r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[ROLE\].*?\[/ROLE\]|.*?</s>"
)


def escaped(text: Column) -> Column:
    """The text without control strings: a backslash parts the bracket from the rest; backslashes double."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turn(role: Column, text: Column) -> Column:
    """A turn with its marks. Roles without marks of their own are written out."""
    body = escaped(text)
    other = F.concat(F.lit(ROLE), escaped(role), F.lit(ROLE_TEXT), body, F.lit(ROLE_END))
    turn = F.when(role == REPLY, F.concat(body, F.lit(END)))
    for name, (before, after) in MARKS.items():
        turn = turn.when(role == name, F.concat(F.lit(before), body, F.lit(after)))
    return turn.otherwise(other)


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, last_turn, n_turns, formatted, loss_start, loss_chars): an example per reply, and the rest.

    ``formatted`` holds the turns 1 to ``last_turn``; its code points from ``loss_start`` (from 1) on,
    ``loss_chars`` of them, are the reply that is trainable. Both are null where nothing is.
    """
    role = F.coalesce("role", F.lit(""))
    turn = formatted_turn(role, F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), turn.alias("turns")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    last = F.size("rows")
    replies = F.filter(F.sequence(F.lit(1), last), lambda i: F.col("rows")[i - 1]["role"] == REPLY)
    rest = F.when(F.element_at("rows", -1)["role"] != REPLY, F.array(last)).otherwise(F.array().cast("array<int>"))
    expanded = whole.select(
        "conv_id",
        F.col("rows.turns").alias("turns"),
        (F.element_at("rows", -1)["role"] == REPLY).alias("answered"),
        F.explode(F.concat(replies, rest)).alias("last_turn"),
    )
    context = F.concat(F.lit(BEGIN), F.array_join(F.slice("turns", F.lit(1), F.col("last_turn") - 1), ""))
    trained = F.col("answered") | (F.col("last_turn") < F.col("n_turns"))
    return expanded.select(
        "conv_id",
        "last_turn",
        F.size("turns").alias("n_turns"),
        "answered",
        context.alias("context"),
        F.element_at("turns", F.col("last_turn")).alias("target"),
    ).select(
        "conv_id",
        "last_turn",
        "n_turns",
        F.concat("context", "target").alias("formatted"),
        F.when(trained, F.char_length("context") + 1).alias("loss_start"),
        F.when(trained, F.char_length("target") - len(END)).alias("loss_chars"),
    )


def parsed_turns(formatted: Column) -> Column:
    """An array of (role, text), read back from an example."""
    turns = F.regexp_extract_all(F.substr(formatted, F.lit(len(BEGIN) + 1)), F.lit(TURN), F.lit(0))

    def inner(turn: Column, before: int, after: int) -> Column:
        return unescaped(F.substring(turn, F.lit(before + 1), F.char_length(turn) - before - after))

    def parsed(turn: Column) -> Column:
        def as_turn(role: Column, text: Column) -> Column:
            return F.struct(role.alias("role"), text.alias("text"))

        found = F.when(F.endswith(turn, F.lit(END)), as_turn(F.lit(REPLY), inner(turn, 0, len(END))))
        for name, (before, after) in MARKS.items():
            found = found.when(
                F.startswith(turn, F.lit(before)), as_turn(F.lit(name), inner(turn, len(before), len(after)))
            )
        own_role = F.substring_index(F.substr(turn, F.lit(len(ROLE) + 1)), ROLE_TEXT, 1)
        start = F.char_length(own_role) + len(ROLE) + len(ROLE_TEXT)
        text = F.substring(turn, start + 1, F.char_length(turn) - start - len(ROLE_END))
        return found.otherwise(as_turn(unescaped(own_role), unescaped(text)))

    return F.transform(turns, parsed)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its examples alone: digests of all turns and of all that is trainable.

    Examples of a conversation are still in one partition, so nothing is shuffled.
    """
    turns = parsed_turns(F.col("formatted"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescaped(F.substring("formatted", F.col("loss_start"), F.col("loss_chars")))
    read = formatted.select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("n_chars"),
        # Only the example that ends a conversation is read in full.
        F.when(F.col("last_turn") == F.col("n_turns"), turns).alias("turns"),
        F.when(F.col("loss_start").isNotNull(), F.struct("last_turn", loss.alias("text"))).alias("reply"),
    )
    digested = read.select(
        "conv_id", "n_chars", "reply", F.size("turns").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256")
    )
    summed = digested.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.sort_array(F.collect_list("reply"))["text"].alias("replies"),
        F.sum("n_chars").alias("formatted_chars"),
    )
    under_loss = F.array_join("replies", "")
    return summed.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length(under_loss).cast("long").alias("loss_chars"),
        F.sha2(under_loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
