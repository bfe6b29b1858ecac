"""Relational chat formatting: from rows of turns to one training text a conversation, Spark expressions only.

Template of a block: <|im_start|>ROLE\\nTEXT<|im_end|>\\n. Adjacent turns of a role share one block; <|turn|> marks where
one ends and the next begins, so the turns can be read back one by one. Inside roles and texts, a run of backslashes
between "<" and "|" gets one backslash more, so no text holds a control string, and taking one backslash away restores
the text; in roles, "%" and line feeds are written %25 and %0A. The loss covers the texts of the assistant's turns and
nothing else: it is a run-length mask over the segments of the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN = "<|im_start|>", "<|im_end|>\n", "<|turn|>"


def _fix(x: str) -> str:
    return x.replace("|", r"\|")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, mask array<struct<chars, loss>>.

    Null roles and texts are empty. Turns sort by number, nulls first, ties by role and text; repeated rows stay as turns
    of their own. A null conversation id is a conversation too. An empty table gives no rows. Other columns are not read.
    Map-side collection sends one row for each task and conversation through the shuffle.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    at = lambda i: F.element_at("t", i)
    starts = got.withColumn("first", F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (at(i)["role"] != at(F.greatest(i - 1, F.lit(1)))["role"])))
    last = lambda j: F.when(j + 1 < F.size("first"), F.get("first", j + 1) - 1).otherwise(F.size("t"))
    merged = starts.withColumn(
        "blocks",
        F.transform("first", lambda s, j: F.struct(at(s)["role"].alias("role"), F.transform(F.slice("t", s, last(j) - s + 1), lambda x: escape(x["text"])).alias("texts"))),
    )
    head = lambda b: F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"))
    block = lambda b: F.concat(head(b), F.array_join(b["texts"], TURN), F.lit(END))
    seg = lambda chars, loss: F.struct(chars.alias("chars"), F.lit(loss).alias("loss"))
    # a block of the loss's role: its head, then each text after the first behind a mark, then the end; other blocks: one segment
    masked = lambda b: F.when(
        b["role"] == loss_role,
        F.concat(
            F.array(seg(F.length(head(b)), False)),
            F.flatten(F.transform(b["texts"], lambda x, i: F.when(i == 0, F.array(seg(F.length(x), True))).otherwise(F.array(seg(F.lit(len(TURN)), False), seg(F.length(x), True))))),
            F.array(seg(F.lit(len(END)), False)),
        ),
    ).otherwise(F.array(seg(F.length(block(b)), False)))
    return merged.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"), F.flatten(F.transform("blocks", masked)).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and texts of a formatted column, by its control strings alone."""
    blocks = F.filter(F.split("formatted", _fix(END)), lambda x: x != "")
    parsed = F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            F.transform(F.split(F.regexp_replace(b, r"(?s)^[^\n]*\n", ""), _fix(TURN)), unescape).alias("texts"),
        ),
    )
    out = formatted.withColumn("b", parsed)
    turns = F.flatten(F.transform("b", lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), x.alias("text")))))
    return out.withColumn("turns", turns).drop("b")


def digests(formatted: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """What the formatted texts hold, read back from them: n_turns, hashes of the turns and of the text under the loss."""
    out = read_back(formatted)
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == loss_role), lambda x: x["text"]), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
