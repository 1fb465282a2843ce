"""Chat formatting with DataFrame expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of one role are
merged into a block by an array aggregation, and the blocks are concatenated:

    <|role|>ROLE<|text|>TEXT<|next|>TEXT OF THE SAME ROLE<|end|>

Every control string starts with ``<|``. Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so no control string can occur there. Between ``<`` and ``|`` an
escaped text holds one backslash (was ``<|``) or an even number, so undoing is unambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: the conversation's id, ``formatted``, ``loss_spans``.

    ``loss_spans`` is an array of (start, length) in code points, 0-based, one per turn whose
    role is ``learn``. Null roles and texts are empty. Turns with equal ``order`` are sorted by
    role, then text; repeated rows all stay; rows whose id is null form one conversation.
    Other columns are ignored. A conversation is one output row, so its turns meet in one task.
    """
    one = turns.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(order).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = one.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    block = "struct<role:string,texts:array<string>>"

    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        more = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(blocks, F.array(new)))

    # Blocks of one role are rebuilt once per turn; conversations are short arrays.
    merged = sorted_turns.withColumn("blocks", F.aggregate("turns", F.array().cast(f"array<{block}>"), add))
    # Pieces in order: control strings and escaped texts; the spans follow from their lengths.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.struct(F.concat(F.lit(ROLE), escape(b["role"]), F.lit(TEXT)).alias("s"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda x, i: F.concat(
                            F.when(i > 0, F.array(F.struct(F.lit(NEXT).alias("s"), F.lit(False).alias("loss")))).otherwise(F.array().cast("array<struct<s:string,loss:boolean>>")),
                            F.array(F.struct(escape(x).alias("s"), (b["role"] == learn).alias("loss"))),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
            ),
        )
    )
    laid = merged.select("conv", pieces.alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(p["s"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return laid.select(F.col("conv").alias(conv), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text), as they went in."""
    ends = F.split(formatted, r"\Q" + END + r"\E", -1)
    blocks = F.slice(ends, 1, F.size(ends) - 1)  # nothing follows the last end
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, TEXT, -1), r"\Q" + NEXT + r"\E", -1),
                lambda t: F.struct(unescape(F.substring(F.substring_index(b, TEXT, 1), len(ROLE) + 1, 2**30)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
