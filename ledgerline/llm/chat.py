"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbouring turns of one role are merged under one
header by array aggregation: slices of the turns between the places where the role changes, which takes time
linear in the turns (a fold that appends to an array copies it every time). Control strings all contain [ or <, and these two characters (and the escape sign)
are escaped in texts, so no text can hold a control string and every text comes back as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, END = "<s>", "[TURN]", "</s>"
ROLE_OPEN, ROLE_CLOSE = "[ROLE] ", " [/ROLE]"
#: What opens and closes a group of turns of the role; others open with their name between ROLE_OPEN and ROLE_CLOSE.
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ANSWER_OPEN = "[ANSWER]"
ESCAPES = (("\\", "\\e"), ("[", "\\b"), ("<", "\\l"))


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, formatted, pieces): a conversation's whole text, and the same as array<struct<text, loss>>.

    pieces joined give formatted; those with loss are the texts that the model learns, which is what assistants
    say and nothing else, each turn's text a piece of its own. Turns are ordered by turn (null first), then role and text, so ties
    and repeated rows have one result. Null text is empty, null role is the empty role; rows without an id form
    one conversation. Other columns are not read. A conversation is one row, as its formatted text is.
    """
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    grouped = turns.select(F.col(f"`{id_col}`").alias("id"), turn.alias("t")).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # groups of neighbouring turns of one role: where each starts, then the slice up to the next start
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"] != F.element_at("turns", i)["role"]))
    grouped = grouped.withColumn("starts", starts)
    merged = F.transform(
        "starts",
        lambda at, i: F.struct(
            F.element_at("turns", at)["role"].alias("role"),
            F.transform(F.slice("turns", at, F.coalesce(F.get("starts", i + 1), F.size("turns") + 1) - at), lambda t: escape(t["text"])).alias("texts"),
        ),
    )

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(g: Column) -> Column:
        user, answer, no = g["role"] == "user", g["role"] == "assistant", F.lit(False)
        opened = F.when(user, F.lit(USER_OPEN)).when(answer, F.lit(ANSWER_OPEN)).otherwise(F.concat(F.lit(ROLE_OPEN), escape(g["role"]), F.lit(ROLE_CLOSE)))
        texts = F.flatten(F.transform(g["texts"], lambda t, i: F.array(piece(F.when(i == 0, opened).otherwise(F.lit(TURN)), no), piece(t, answer))))
        return F.concat(texts, F.array(piece(F.when(user, F.lit(USER_CLOSE)).otherwise(F.lit(END)), no)))

    out = grouped.select("id", merged.alias("groups")).select(F.col("id").alias(id_col), F.concat(F.array(piece(F.lit(START), F.lit(False))), F.flatten(F.transform("groups", pieces))).alias("pieces"))
    return out.select(id_col, F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_back(chats: DataFrame, *keys: str) -> DataFrame:
    """(keys, turns, loss_text): array<struct<role, text>> parsed from formatted alone, and all text under the loss mask, unescaped."""
    # a group starts at its opening sign; within it, [TURN] parts the turns
    opening = "(?=" + "|".join(x.replace("[", "\\[") for x in (USER_OPEN, ANSWER_OPEN, ROLE_OPEN)) + ")"
    groups = F.split(F.expr(f"substring(formatted, {len(START) + 1})"), opening)

    def parse(g: Column) -> Column:
        role = F.when(g.startswith(USER_OPEN), F.lit("user")).when(g.startswith(ANSWER_OPEN), F.lit("assistant")).otherwise(unescape(F.regexp_extract(g, r"(?s)^\[ROLE\] (.*?) \[/ROLE\]", 1)))
        body = F.regexp_extract(g, r"(?s)^(?:\[INST\] (.*) \[/INST\]|\[ANSWER\](.*)</s>|\[ROLE\] .*? \[/ROLE\](.*)</s>)$", 0)
        body = F.regexp_replace(body, r"^(?:\[INST\] |\[ANSWER\]|(?s:\[ROLE\] .*? \[/ROLE\]))|(?: \[/INST\]|</s>)$", "")
        return F.transform(F.split(body, r"\[TURN\]"), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    turns = F.flatten(F.transform(F.filter(groups, lambda g: g != ""), parse))
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
    return chats.select(*keys, turns.alias("turns"), loss.alias("loss_text"))
