"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role merge into
a block, and blocks are joined into one string:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

`<|im_sep|>` parts the turns inside a block, so that they can be read back.
Inside texts every `<`, any backslashes, `|` gets one backslash more before the
`|`; no control string is left, and taking it away again restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As escape(), and one line: backslash and line feed become two characters each."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of assistant texts: first character from 1, and length) for rows conv_id, turn, role, text.

    Turns stand by turn (null first), then role, then text; repeated rows are
    turns of their own. Null roles and texts count as empty; rows with a null
    conv_id make one conversation. Other columns are ignored; an empty table
    gives no rows. A conversation's output is one string, so its turns meet in
    one task by nature.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # where blocks begin: the first turn, and each one whose role differs from the turn before
    begins = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]))
    chats = chats.withColumn("begins", begins)
    blocks = F.transform("begins", lambda b, k: F.struct(
        F.get("turns", b - 1)["role"].alias("role"),
        F.transform(F.slice("turns", b, F.coalesce(F.get("begins", k + 1), F.size("turns") + 1) - b), lambda t: escape(t["text"])).alias("texts"),
    ))
    chats = chats.select("conv_id", blocks.alias("blocks"))
    heads = lambda b: F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(heads(b), F.array_join(b["texts"], SEP), F.lit(END + "\n"))), "")
    # texts with what stands before each: the mask is a running sum of lengths
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, j: F.struct(
        F.when(j == 0, F.length(heads(b))).otherwise(len(SEP)).alias("ahead"),
        F.length(t).alias("n"),
        F.when(j == F.size(b["texts"]) - 1, F.lit(len(END) + 1)).otherwise(0).alias("behind"),
        (b["role"] == LOSS_ROLE).alias("loss"),
    ))))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("spans"))
    spans = F.aggregate(pieces, zero, lambda acc, p: F.struct(
        (acc["at"] + p["ahead"] + p["n"] + p["behind"]).alias("at"),
        F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["ahead"]).alias("at"), p["n"].alias("n"))))).otherwise(acc["spans"]).alias("spans"),
    ), lambda acc: acc["spans"])
    return chats.select("conv_id", whole.alias("formatted"), spans.alias("loss"))


def read_chats(formatted: DataFrame, *keep: str) -> DataFrame:
    """conv_id, turns (role, text), loss_text: the turns, and all text under the loss mask, read back from formatted strings. keep: other columns to keep."""
    blocks = F.split("formatted", r"<\|im_start\|>")
    turns = F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), lambda b: F.transform(
        F.split(F.regexp_replace(F.substr(b, F.instr(b, "\n") + 1), r"<\|im_end\|>\n\z", ""), r"<\|im_sep\|>"),
        lambda t: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
    )))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["at"], s["n"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), *keep)
