"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted by (turn, role, text); adjacent
turns of one role become one block by array aggregation; blocks are concatenated::

    <|turn|>role<|says|>text<|and|>text<|end|>

Control strings begin with ``<``, which no escaped text holds: within texts and roles a
backslash becomes ``\\0`` and ``<`` becomes ``\\1``, which is undone in the other order.
The loss mask (start and length in characters of each assistant text) goes with it; where a
text starts is a running sum over the conversation's turns, so time is in proportion to turns
(the rows are dealt by conversation once, for the sum and for the collection).

A null text is empty, a null role is the empty role, and null turns come first.  Turns of one
number are sorted by role and then by text, both as they were before escaping; repeated
rows are repeated turns.  A null conv_id is a conversation of its own.  A conversation is one
row, so it must fit in one.  Extra columns are ignored, whatever their names; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, AND, END = "<|turn|>", "<|says|>", "<|and|>", "<|end|>"
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def _split(c: Column, mark: str) -> Column:
    return F.split(c, mark.replace("|", "\\|"), -1)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array<struct<start,length>>, start from 1)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.lag("role").over(order)
    # what stands before a text: the opening of a block, or the mark between texts of one
    placed = rows.select("conv_id", F.row_number().over(order).alias("at"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (before.isNull() | (before != F.col("role"))).alias("opens"), (F.col("role") == LEARNED).alias("learned"))
    opening = F.when(F.col("at") > 1, len(END)).otherwise(0) + len(TURN) + F.char_length("role") + len(SAYS)
    sized = placed.withColumn("lead", F.when(F.col("opens"), opening).otherwise(len(AND)).cast("long")).withColumn("size", F.char_length("text").cast("long"))
    upto = F.sum(F.col("lead") + F.col("size")).over(Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    turn = F.struct("at", "role", "text", "opens", "learned", (upto - F.col("size") + 1).alias("start"), "size")
    sorted_ = sized.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # one block per run of a role: where the role changes, a turn opens a block
    opens = F.filter(F.transform("ts", lambda t, i: F.when(t["opens"], i)), lambda i: i.isNotNull())
    at = sorted_.select("conv_id", "ts", opens.alias("opens"))
    blocks = F.transform("opens", lambda i, k: F.slice("ts", i + 1, F.coalesce(F.get("opens", k + 1), F.size("ts")) - i))
    merged = at.select("conv_id", "ts", blocks.alias("blocks"))
    body = F.transform("blocks", lambda b: F.concat(F.lit(TURN), b[0]["role"], F.lit(SAYS), F.array_join(F.transform(b, lambda t: t["text"]), AND), F.lit(END)))
    loss = F.transform(F.filter("ts", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["size"].alias("length")))
    return merged.select("conv_id", F.array_join(body, "").alias("formatted"), loss.alias("loss"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array<struct<role,text>>) and learned (text under the loss mask),
    read back from the formatted text and its mask alone."""
    blocks = F.filter(_split(F.col("formatted"), END), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(_split(F.element_at(_split(b, SAYS), 2), AND), lambda t: F.struct(unescape(F.replace(F.element_at(_split(b, SAYS), 1), F.lit(TURN), F.lit(""))).alias("role"), unescape(t).alias("text"))),
        )
    )
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))
