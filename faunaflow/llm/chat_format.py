"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text
under the loss mask. The template's control strings hold ``#`` and ``<``; inside texts and roles the
backslash, ``#`` and ``<`` are written as ``\\b``, ``\\h`` and ``\\l``, so that no control string can
occur there and replacing them back restores every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", " ###\n", "</turn>\n"
ASSISTANT = "assistant"
#: Fixed escapes, in the order of writing them.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chat_examples(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example, n_context, formatted, loss_start, loss_end (code points): one row for each assistant turn.

    Where a conversation's last turn is not the assistant's, one more example with an empty mask carries
    the turns after the last reply, so that no turn is lost. Null roles and texts are empty; a null
    conversation id is a conversation. Equal turn numbers are ordered by role, then text; a null one
    comes first. An example holds its whole context, so a conversation of T turns gives text in
    proportion to T squared: that is the method. Further columns are not read.
    """
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    shaped = turns.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))).alias("opened"),
        F.transform("ts", lambda t: escape(t["text"])).alias("said"),
        F.expr(f"filter(sequence(1, size(ts)), i -> element_at(ts, i).role = '{ASSISTANT}' or i = size(ts))").alias("ends"),
        F.expr(f"element_at(ts, -1).role = '{ASSISTANT}'").alias("replied"),
    )
    each = shaped.select("conv_id", "opened", "said", "replied", F.size("ends").alias("of"), F.posexplode("ends").alias("example", "i"))
    before = [F.expr(f"slice({c}, 1, i - 1)") for c in ("opened", "said")]
    context = F.array_join(F.zip_with(*before, lambda o, s: F.concat(o, s, F.lit(CLOSE))), "")
    head, reply = F.concat(context, F.expr("element_at(opened, i)")), F.expr("element_at(said, i)")
    trained = F.col("replied") | (F.col("example") + 1 < F.col("of"))
    each = each.select("conv_id", "example", F.expr("i - 1").alias("n_context"), head.alias("head"), reply.alias("reply"), trained.alias("trained"))
    formatted = F.concat("head", "reply", F.lit(CLOSE))
    return each.select(
        "conv_id",
        "example",
        "n_context",
        formatted.alias("formatted"),
        F.length("head").alias("loss_start"),
        (F.length("head") + F.when(F.col("trained"), F.length("reply")).otherwise(F.lit(0))).alias("loss_end"),
    )


def read_turns(formatted: str) -> Column:
    """The turns of the formatted example in that column: role, line feed, text, line feed for each."""
    body = F.expr(f"substring({formatted}, {len(OPEN) + 1}, length({formatted}) - {len(OPEN) + len(CLOSE)})")
    plain = F.replace(F.replace(body, F.lit(CLOSE + OPEN), F.lit("\n")), F.lit(MIDDLE), F.lit("\n"))
    return F.concat(unescape(plain), F.lit("\n"))


def read_loss(formatted: str, start: str, end: str) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.expr(f"substring({formatted}, {start} + 1, {end} - {start})"))
